"""Putting ranked lists together, folding groups, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.plans.request import RRF_K


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score, kind, evidence) of two lists (id, rank, kind, evidence), ranks from 1.

    An item's score is the sum of 1 / (k + rank); its kind is that of the first list it is in.
    """
    part = lambda df, order: df.select("id", F.lit(order).alias("list"), (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"), "kind", "evidence")
    both = part(first, 0).unionByName(part(second, 1))
    lists = both.groupBy("id").agg(F.sum("part").alias("score"), F.array_sort(F.collect_list(F.struct("list", "kind", "evidence"))).alias("seen"))
    evidence = F.array_distinct(F.flatten(F.transform("seen", lambda s: s["evidence"])))
    return lists.select("id", "score", F.col("seen")[0]["kind"].alias("kind"), evidence.alias("evidence"))


def merge_by_best(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, score): the larger score of two lists."""
    return first.select("id", "score").unionByName(second.select("id", "score")).groupBy("id").agg(F.max("score").alias("score"))


def fold_groups(hits: DataFrame, order: list[Column], enabled: bool = True) -> DataFrame:
    """hits with group_size; of each group the first row in the order stays, with all evidence.

    The size counts matching members only. Rows without a group stand alone and are not moved.
    Groups are bursts of near-duplicates within minutes, so they are small.
    """
    if not enabled:
        return hits.withColumn("group_size", F.lit(1).cast("long"))
    alone = hits.filter(F.col("group_id").isNull()).withColumn("group_size", F.lit(1).cast("long"))
    whole = Window.partitionBy("group_id")
    marked = hits.filter(F.col("group_id").isNotNull()).withColumns({"_place": F.row_number().over(whole.orderBy(*order)), "group_size": F.count("*").over(whole)})
    marked = marked.withColumn("_all", F.array_sort(F.collect_list(F.struct("_place", "evidence")).over(whole)))
    every = F.array_distinct(F.flatten(F.transform("_all", lambda x: x["evidence"])))
    folded = marked.filter(F.col("_place") == 1).withColumn("evidence", every).drop("_place", "_all")
    return alone.unionByName(folded.select(alone.columns))
