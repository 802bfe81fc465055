"""A full-text index: postings of trigrams by row, kept in folders of buckets, with each row's length.

The index answers which rows may hold a phrase, by the rows that have all its trigrams; those rows'
texts then decide. Documents' lengths and the number of rows stand beside the postings, so scores
need no scan of all texts. A lookup reads the buckets of its trigrams only.

A version is written whole, then a numbered pointer names it, so readers never see half of one. An
update takes changed rows out and puts their new postings in; only buckets that a changed row is or
was in are written anew, the others are kept where they are.
"""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.checkpoints import checkpoint_folder
from sparkseek.operators.lexical import contains_phrase, text_hits, trigrams
from sparkseek.plans.filters import TEXT_COLUMNS
from sparkseek.sources.pointers import Pointers

BUCKETS = 32
#: Files of a bucket at most.
SLICES = 16


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text, in one pass over its characters."""
    def three(chars: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.when(F.size(chars) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(text, "")), three), F.lit(0))  # so that the text is split once


def postings(catalog: DataFrame) -> DataFrame:
    """(gram, id) of every row's indexed columns; trigrams don't cross columns."""
    every = F.array_distinct(F.concat(*(grams_of(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in TEXT_COLUMNS)))
    return catalog.select("id", F.explode(every).alias("gram")).select("gram", "id")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class TextIndex:
    """Postings under a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.pointers = Pointers(spark, self.folder)

    def build(self, catalog: DataFrame) -> None:
        self._write(postings(catalog), catalog.select("id", trigrams().cast("long").alias("length")), {}, None)

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Takes in changed and new rows whole, and takes out the rows whose ids are gone."""
        ids = changed.select("id") if gone is None else changed.select("id").unionByName(gone.select("id"))
        ids = ids.distinct()
        old, new = self.postings(), postings(changed)
        touched = old.join(ids, "id", "left_semi").select("gram").unionByName(new.select("gram")).select(_bucket(F.col("gram"), self.buckets).alias("b")).distinct()
        buckets = sorted(r["b"] for r in touched.collect())  # at most as many as there are buckets
        kept = old.filter(F.col("bucket").isin(buckets)).join(ids, "id", "left_anti").select("gram", "id")
        lengths = self.rows().join(ids, "id", "left_anti").unionByName(changed.select("id", trigrams().cast("long").alias("length")))
        self._write(kept.unionByName(new), lengths, self.pointers.read()["buckets"], buckets)

    def _write(self, rows: DataFrame, lengths: DataFrame, places: dict[str, str], buckets: list[int] | None) -> None:
        """Writes the postings of these buckets (of all, if not named); places says where the others are."""
        version = f"{self.folder}/{uuid4().hex}"
        spread = rows.withColumn("bucket", _bucket(F.col("gram"), self.buckets)).repartition("bucket", F.pmod(F.xxhash64("gram"), F.lit(SLICES)))
        spread.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{version}/postings")
        lengths.write.parquet(f"{version}/rows")
        n, total = self.spark.read.parquet(f"{version}/rows").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        written = range(self.buckets) if buckets is None else buckets
        now = {b: p for b, p in places.items() if int(b) not in written}
        now |= {str(b): p for b in written if self.pointers.exists(p := f"{version}/postings/bucket={b}")}
        self.pointers.write({"rows": f"{version}/rows", "n": n, "length": total, "buckets": now})

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(gram, id, bucket) of these buckets, or all."""
        places = self.pointers.read()["buckets"]
        paths = [p for b, p in places.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], "gram string, id long, bucket int")
        return self.spark.read.schema("gram string, id long").parquet(*paths).withColumn("bucket", _bucket(F.col("gram"), self.buckets))

    def rows(self) -> DataFrame:
        """(id, length)."""
        return self.spark.read.parquet(self.pointers.read()["rows"])

    def candidates(self, phrase: str) -> DataFrame:
        """(id) of rows that have every trigram of a phrase of three characters or more."""
        grams = list(dict.fromkeys(phrase[i : i + 3] for i in range(len(phrase) - 2)))
        spark = self.spark
        buckets = [r[0] for r in spark.sql("SELECT explode(from_json(:grams, 'array<string>')) AS g", {"grams": json.dumps(grams)}).select(_bucket(F.col("g"), self.buckets)).distinct().collect()]
        found = self.postings(buckets).filter(F.col("gram").isin(grams))
        return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("id")

    def statistics(self, catalog: DataFrame, phrases: list[str]) -> tuple[int, float, dict[str, int]]:
        """What BM25 needs: rows, mean length, and how many rows hold each phrase, from the texts of candidates alone."""
        pointer = self.pointers.read()
        holding = {p: catalog.join(self.candidates(p), "id", "left_semi").filter(contains_phrase(p)).count() for p in phrases}
        return pointer["n"], pointer["length"] / max(1, pointer["n"]), holding


def temporary(spark: SparkSession) -> TextIndex:
    """An index in the shared checkpoint folder."""
    return TextIndex(spark, f"{checkpoint_folder(spark)}/index-{uuid4().hex}")


def hits(index: TextIndex, catalog: DataFrame, eligible: DataFrame, groups: list[list[str]], short: list[str], near: bool = False) -> DataFrame:
    """text_hits from the texts of the index's candidates alone. Queries without a long term read all rows."""
    if not groups:
        return text_hits(catalog, eligible, groups, short, near)
    for group in groups:
        eligible = eligible.join(reduce(DataFrame.union, [index.candidates(t) for t in group]).distinct(), "id", "left_semi")
    phrases = list(dict.fromkeys(t for g in groups for t in g))
    return text_hits(catalog, eligible, groups, short, near, index.statistics(catalog, phrases))
