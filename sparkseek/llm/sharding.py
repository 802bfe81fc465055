"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

Every node draws ``-ln(u) / weight`` with u from the XXH64 of the key and the node's path, and
the child with the smallest draw takes the row (a weighted rendezvous). A draw depends on that
node alone, so a change of one weight moves rows only between that node and its siblings, and
only inside their parent; everything outside keeps its place.

A tree for a number of shards is a base tree (regions x racks x shards, all of weight 1) and a
region of its own for each shard beyond the base. One more shard is thus one more region: it
takes rows from the others and no other row moves.

Defined cases: a null key counts as one key of its own; a null text has size 1 (no bytes plus
one) and a null checksum; repeated rows are placed alike and get different slots; a very long text
is only measured; an empty table gives an empty result; an input column named as an output column is
replaced, and others are kept, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import cut, free_prefix, load, unit

SHARDS = 16
ROWS_PER_BLOCK = 4_096
#: How many times as large as meant a block may be.
UNEVEN = 4


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree_for(shards: int, base: tuple[int, int, int] = (4, 2, 2)) -> tuple[Leaf, ...]:
    """The leaves for this many shards: the base tree, then a region for each further shard."""
    regions, racks, each = base
    full = regions * racks * each
    if shards < full:
        raise ValueError(f"the base tree has {full} shards, more than {shards}")
    leaves = [Leaf(f"region{s // (racks * each)}", f"rack{s // each % racks}", s) for s in range(full)]
    return (*leaves, *(Leaf(f"region{regions + s - full}", "rack0", s) for s in range(full, shards)))


def _draw(key: Column, options: Column) -> Column:
    """The name of the option (path, weight, name) with the smallest weighted draw; ties go to the smaller name."""
    drawn = F.transform(options, lambda o: F.struct((-F.log(unit(key, o["path"])) / o["weight"]).alias("draw"), o["name"].alias("name")))
    return F.array_min(drawn)["name"]


def place(df: DataFrame, key: str, leaves: tuple[Leaf, ...], prefix: str = "") -> DataFrame:
    """df with the columns region, rack and shard (each after the prefix) of the leaf that takes the row."""
    below: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        if leaf.weight <= 0:
            raise ValueError("weights must be positive")
        path = ""
        for name in (leaf.region, leaf.rack, str(leaf.shard)):
            siblings = below.setdefault(path, {})
            siblings[name] = siblings.get(name, 0.0) + leaf.weight
            path = f"{path}/{name}"

    def options(parent: str) -> Column:
        return F.array(*(F.struct(F.lit(f"{parent}/{n}").alias("path"), F.lit(w).alias("weight"), F.lit(n).alias("name")) for n, w in below[parent].items()))

    tree = F.create_map(*(x for parent in below for x in (F.lit(parent), options(parent))))
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    parent = F.lit("")
    for level in ("region", "rack", "shard"):
        df = df.withColumn(f"{prefix}{level}", _draw(k, F.element_at(tree, parent)))
        parent = F.concat(parent, F.lit("/"), F.col(f"{prefix}{level}"))
    return df.withColumn(f"{prefix}shard", F.col(f"{prefix}shard").cast("int"))


def with_slots(df: DataFrame, shard: str, order: list[str], shards: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """df with a column slot that numbers the rows of each shard from 0 without gaps.

    A shard is cut into blocks by a hash of the order columns, the rows of a block are numbered
    in one task, and a running sum of block counts gives where each block begins. So no task sees
    a whole shard. A block many times as large as meant holds a great many rows that agree in every
    order column; then rows are dealt to blocks at random instead, once and for all, as they are kept.
    """
    blocks = max(1, math.ceil(df.count() / shards / rows_per_block))
    p = free_prefix(df, "_slot_")
    columns = [c for c in df.columns if c != "slot"]
    count = lambda rows: cut(rows.groupBy(F.col(shard).alias(f"{p}shard"), F.col(f"{p}block").alias(f"{p}b")).agg(F.count("*").alias(f"{p}count")))
    df = df.select(*columns, F.pmod(F.xxhash64(*order), F.lit(blocks)).alias(f"{p}block"))
    sizes = count(df)
    if blocks > 1 and sizes.agg(F.max(f"{p}count")).first()[0] > UNEVEN * rows_per_block:
        df = cut(df.withColumn(f"{p}block", F.floor(F.rand() * blocks)))
        sizes = count(df)
    before = Window.partitionBy(f"{p}shard").orderBy(f"{p}b").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(f"{p}shard", f"{p}b", F.coalesce(F.sum(f"{p}count").over(before), F.lit(0)).alias(f"{p}begin"))
    within = Window.partitionBy(shard, f"{p}block").orderBy(*order)
    numbered = df.withColumn(f"{p}n", F.row_number().over(within))
    placed = numbered.join(begins, (F.col(shard) == F.col(f"{p}shard")) & (F.col(f"{p}block") == F.col(f"{p}b")))
    return placed.select(*columns, (F.col(f"{p}begin") + F.col(f"{p}n") - 1).cast("long").alias("slot"))


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """df with size, text_crc32, law, shard, region, rack, slot and grown_shard for this many shards."""
    df = df.withColumns(
        {
            "size": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(1).cast("long"),
            "text_crc32": F.crc32(F.col(text).cast("binary")).cast("long"),
            "law": F.lit("key"),
        }
    )
    df = place(df, key, tree_for(shards))
    p = free_prefix(df, "_grown_")
    df = place(df, key, tree_for(shards + 1), p).withColumn("grown_shard", F.col(f"{p}shard")).drop(f"{p}region", f"{p}rack", f"{p}shard")
    return with_slots(df, "shard", [key, "text_crc32", "size"], shards)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shard_rows(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
