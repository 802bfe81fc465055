"""Relevance measures of ranked results against labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(results: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, precision, recall, reciprocal_rank, no_match) at each query's k.

    results holds (query, rank, id), relevant (query, id), queries (query, k). A query without
    relevant items is right if it finds nothing.
    """
    top = results.join(queries, "query").filter(F.col("rank") <= F.col("k"))
    hits = top.join(relevant.withColumn("hit", F.lit(1)), ["query", "id"], "left")
    found = hits.groupBy("query").agg(F.count("*").alias("returned"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    wanted = relevant.groupBy("query").agg(F.count_distinct("id").alias("wanted"))
    all_ = queries.join(found, "query", "left").join(wanted, "query", "left").fillna(0, ["returned", "hits", "wanted"])
    return all_.select(
        "query", F.when(F.col("wanted") > 0, F.col("hits") / F.col("k")).alias("precision"), F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).alias("recall"),
        F.when(F.col("wanted") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"), F.when(F.col("wanted") == 0, F.col("returned") == 0).alias("no_match"),
    )


def same_results(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs gave the same (query, rank, id)."""
    a, b = a.select("query", "rank", "id"), b.select("query", "rank", "id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
