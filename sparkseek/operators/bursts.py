"""Bursts: near-duplicates of one folder within minutes of each other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.operators.components import connected_components

# Fixed values of the burst rule.
WINDOW_MS = 600_000
MIN_LINES = 4
LINE_SHARE = 0.7
MAX_BITS = 6


def distinct_lines(text: Column) -> Column:
    """The distinct lines of a text; a closing line break begins no line."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(body, r"\r?\n")))


def similarity(a: Column, b: Column, hash_a: Column, hash_b: Column) -> Column:
    """How alike two rows are, or null if not enough: shared lines where both have four, else hash bits."""
    longest = F.greatest(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / longest
    bits = F.bit_count(hash_a.bitwiseXOR(hash_b))
    by_lines = F.when(share >= LINE_SHARE, share)
    by_hash = F.when(bits <= MAX_BITS, 1 - bits / 64)
    return F.when(F.least(F.size(a), F.size(b)) >= MIN_LINES, by_lines).otherwise(by_hash)


def candidates(catalog: DataFrame) -> DataFrame:
    """Rows that may be in a burst: shown, read, with a perceptual hash."""
    return catalog.filter(~F.col("hidden") & (F.col("stage") >= 1) & F.col("dhash").isNotNull())


def burst_pairs(catalog: DataFrame) -> DataFrame:
    """(a, b, score) of alike rows of a folder within ten minutes; every pair both ways.

    Time is cut into windows and a row meets the rows of its own and the next window only, so the
    join is by equality and a long-lived folder is many keys.
    """
    rows = candidates(catalog).select("id", "folder", "mtime", "dhash", distinct_lines(F.col("text")).alias("said"), F.floor(F.col("mtime") / WINDOW_MS).alias("slot"))
    left = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns)).withColumn("slot", F.explode(F.array(F.col("a_slot"), F.col("a_slot") + 1)))
    right = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
    pair = (F.col("a_folder") == F.col("b_folder")) & (F.col("slot") == F.col("b_slot"))
    near = F.abs(F.col("a_mtime") - F.col("b_mtime")) <= WINDOW_MS
    once = (F.col("a_slot") < F.col("b_slot")) | (F.col("a_id") < F.col("b_id"))
    score = similarity(F.col("a_said"), F.col("b_said"), F.col("a_dhash"), F.col("b_dhash"))
    found = left.join(right, pair & near & once & (F.col("a_id") != F.col("b_id"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), score.alias("score")).filter(F.col("score").isNotNull())
    ways = F.array(F.struct("a", "b", "score"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return found.select(F.explode(ways).alias("p")).select("p.*")


def best_neighbours(catalog: DataFrame) -> DataFrame:
    """(id, neighbour, score): the most alike row; ties go to the earlier one, then the smaller id."""
    times = catalog.select(F.col("id").alias("b"), F.col("mtime").alias("b_mtime"))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b_mtime", "b")
    ranked = burst_pairs(catalog).join(times, "b").withColumn("_n", F.row_number().over(best))
    return ranked.filter(F.col("_n") == 1).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "score")


def burst_components(catalog: DataFrame) -> DataFrame:
    """(id, group_id): rows that chains of alike pairs connect; the group has its smallest id.

    Pairs are contracted until none is left, which shrinks long chains by a constant factor a round.
    """
    roots = connected_components(burst_pairs(catalog).filter(F.col("a") < F.col("b")).select("a", "b"))
    smallest = roots.groupBy("root").agg(F.min("node").alias("group_id"))
    return roots.join(smallest, "root").select(F.col("node").alias("id"), "group_id")


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """One folder, as ingest meets it: newest first, each row joining its most alike earlier row."""
    rows = rows.sort_values(["mtime", "id"], ascending=[False, True])
    groups: dict[int, int | None] = {}
    seen: list[tuple] = []
    for r in rows.itertuples():
        said = set(r.said)
        best = None
        for other, mtime, dhash, theirs in sorted(seen, key=lambda s: (s[1], s[0])):
            if abs(mtime - r.mtime) > WINDOW_MS:
                continue
            if len(said) >= MIN_LINES and len(theirs) >= MIN_LINES:
                score = len(said & theirs) / max(len(said), len(theirs))
                score = score if score >= LINE_SHARE else None
            else:
                bits = ((r.dhash ^ dhash) & (1 << 64) - 1).bit_count()
                score = 1 - bits / 64 if bits <= MAX_BITS else None
            if score is not None and (best is None or score > best[0]):
                best = (score, other)
        groups[r.id] = None
        if best:
            other = best[1]
            if groups[other] is None:
                groups[other] = other
            groups[r.id] = groups[other]
        seen.append((r.id, r.mtime, r.dhash, said))
        seen = [s for s in seen if s[1] - r.mtime <= WINDOW_MS]
    return pd.DataFrame({"id": list(groups), "group_id": pd.array(list(groups.values()), dtype="Int64")})


def group_bursts(catalog: DataFrame, order: str = "components") -> DataFrame:
    """(id, group_id) of rows in bursts.

    order="components" does not depend on any order and is the mode for large catalogs. order="ingest"
    is there for parity only: it follows the order in which files are read, which is sequential, one
    session of a folder (rows with no gap above ten minutes) at a time in one task, and compares each
    row with those of the ten minutes after it.
    """
    if order == "components":
        return burst_components(catalog)
    if order != "ingest":
        raise ValueError(f"unknown order {order!r}")
    rows = candidates(catalog).select("id", "folder", "mtime", "dhash", distinct_lines(F.col("text")).alias("said"))
    by_time = Window.partitionBy("folder").orderBy("mtime", "id")
    gap = F.coalesce((F.col("mtime") - F.lag("mtime").over(by_time) > WINDOW_MS).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", gap).withColumn("session", F.sum("_new").over(by_time)).drop("_new")
    alone = F.count("*").over(Window.partitionBy("folder", "session")) == 1
    rows = rows.withColumn("_alone", alone).filter(~F.col("_alone")).drop("_alone")
    return rows.groupBy("folder", "session").applyInPandas(lambda rows: _in_order(rows), "id long, group_id long").filter(F.col("group_id").isNotNull())
