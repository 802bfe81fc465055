"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.checkpoints import checkpoint_folder, cut

__all__ = ["checkpoint_folder", "cut", "free_prefix", "join_split", "load", "training_row", "unit"]

#: Keys that are joined by a broadcast at most: those with more than this share of all rows.
HOT_KEYS = 10_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_prefix(df: DataFrame, wish: str) -> str:
    """The wish, with as many underscores before it as it takes for no column of df to begin with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(wish.lower()) for c in taken):
        wish = f"_{wish}"
    return wish


def join_split(rows: DataFrame, table: DataFrame, key: str, weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The inner join of rows with a table of distinct keys, where weight says how many rows have the key.

    A key with more than a share 1 / hot_keys of all rows is hot. There are fewer than hot_keys of
    them, so they are broadcast and their rows stay where they are; the others are joined by a
    shuffle, to which no key brings more than that share. Both inputs are read several times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    most = max(1000, -(-total // hot_keys))
    hot = table.filter(F.col(weight) > most)
    if total <= most or hot.isEmpty():
        return rows.join(table.drop(weight), key)
    few = F.broadcast(cut(hot.drop(weight)))
    cold = table.filter(F.col(weight) <= most).drop(weight)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(cold, key))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that the parts alone decide: the upper 53 bits of their XXH64."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def training_row(doc_id: Column) -> Column:
    """True for rows whose labels may be learnt from: crc32 of the id as text, mod 5, is not 0.

    A null id counts as held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))
