"""Orders of results, and ranks over a whole result without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.text import ascii_lower
from sparkseek.operators.checkpoints import cut


def sort_columns(sort: str, browsing: bool = False) -> list[Column]:
    """The order of an explicit sort. Only while browsing, ties of newest go to the larger id and names fold ASCII letters alone."""
    ties = F.asc("id")
    return {
        "newest": [F.desc("mtime"), F.desc("id") if browsing else ties],
        "oldest": [F.asc("mtime"), ties],
        "largest": [F.desc("size"), ties],
        "smallest": [F.asc("size"), ties],
        "name": [(ascii_lower(F.col("name")) if browsing else F.lower("name")).asc(), ties],
    }.get(sort, [ties])


def shuffle_columns() -> list[Column]:
    """A fixed shuffle of ids, the same on every page."""
    mixed = (F.col("id") * F.lit(1103515245) + F.lit(12345)).bitwiseAND(F.lit(2147483647))
    return [mixed.asc(), F.asc("id")]


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its 1-based place in the order.

    Rows are dealt by range and sorted within partitions; only the partitions' row counts meet, to
    say where each one begins. The order must be total, or equal rows may swap places.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).count()  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_begin"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return ranked.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_begin")


def append_page(shown: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of the pages so far and the new ones of the next, which may repeat some: of one id the first stays."""
    return shown.unionByName(more.join(shown.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(shown.columns))


def page(df: DataFrame, offset: int, limit: int, order: list[Column]) -> DataFrame:
    """One page and one row more, which tells that another page follows."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)
