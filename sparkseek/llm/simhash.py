"""SimHash near-duplicates: tiled exact comparison of fingerprints in numpy.

Distinct fingerprints are laid into tiles by the population counts of their four 16-bit parts.
Two fingerprints within radius r differ by at most r in the sum of the differences of these
counts, so pairs of tiles that differ by more are skipped, and every other pair is compared
whole: exclusive-or and bit counts over blocks of a matrix. Nothing is sampled or capped, so the
links are all links. A tile task keeps a spanning forest of the links it finds, which is all that
components need; copies of one fingerprint are one entry and never meet as pairs.

Large tiles are split: a task gets at most about TILE_ROWS rows of either side, and both sides
are dealt by hash to a grid of such tasks. The table of tile sizes has at most 17**4 rows.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; a
null doc_id is grouped by its text but never the smallest id of a group (null if a group has no
other); repeated rows are in one group; a very long text is read whole, with memory in proportion
to its words; an empty table gives an empty result; other columns are ignored or kept as they are.

Rows of one fingerprint, such as a great many copies, get their group by a broadcast of the few
fingerprints with so many rows; the others are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkseek.llm.common import cut, free_prefix, join_split, load
from sparkseek.operators.components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE_ROWS = 32_768
#: Cells of the matrix compared at once: 8 bytes each.
CELLS = 1 << 21

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLANE = np.arange(8, dtype=np.uint16) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, as an unsigned number."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype="<u8", count=n)
    planes = np.zeros(2048, dtype=np.int64)
    for i in range(0, n, CELLS // 8):
        planes += np.bincount((hashes[i : i + CELLS // 8, None].view(np.uint8) + _PLANE).ravel(), minlength=2048)
    set_in = (planes.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype="<u8", count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b at Hamming distance 1 to radius: (node, root).

    Blocks of CELLS pairs are compared in turn and their links joined to the forest so far, so no
    more links than a block's are held.
    """
    step = max(1, CELLS // max(1, len(b)))
    nodes, roots = a[:0], a[:0]
    for at in range(0, len(a), step):
        part = a[at : at + step]
        bits = np.bitwise_count(part[:, None] ^ b[None, :])
        i, j = np.nonzero((bits <= radius) & (bits > 0))
        if len(i):
            nodes, roots = _spanned(np.concatenate([nodes, part[i]]), np.concatenate([roots, b[j]]))
    return nodes, roots


def _spanned(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links left-right as (node, root), without the roots themselves."""
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _comparison(radius: int):
    def compare(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy().astype(bool)
        fp = table.column("fp").to_numpy().view(np.uint64)
        a, b = forest(fp[own], fp[~own], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return compare


def _part(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): per tile task a spanning forest of the links between the distinct values of prints.fp."""
    counts = F.array(*(_part(F.col("fp"), i) for i in range(4)))
    tiled = prints.select("fp").distinct().withColumn("p", counts)
    code = lambda p: reduce(lambda x, i: x * 17 + p[i], range(4), F.lit(0)).cast("int")
    tiled = cut(tiled.select("fp", "p", code(F.col("p")).alias("tile")))
    axis = range(-radius, radius + 1)
    steps = [(w, x, y, z) for w in axis for x in axis for y in axis for z in axis if abs(w) + abs(x) + abs(y) + abs(z) <= radius]
    steps = [s for s in steps if s >= (0, 0, 0, 0)]  # of each pair of tiles, the one later in order has the task
    inside = lambda s: reduce(lambda x, y: x & y, [(F.col("p")[i] + d).between(0, 16) for i, d in enumerate(s) if d] or [F.lit(True)])
    others = F.filter(F.array(*(F.when(inside(s), code([F.col("p")[i] + d for i, d in enumerate(s)])) for s in steps)), lambda c: c.isNotNull())
    near = tiled.select("fp", F.explode(others).alias("task"))
    sizes = tiled.groupBy(F.col("tile").alias("task")).agg(F.count("*").alias("n_own"))  # at most 17**4 rows
    near_sizes = tiled.groupBy("tile", "p").agg(F.count("*").alias("n")).select("n", F.explode(others).alias("task")).groupBy("task").agg(F.sum("n").alias("n_near"))
    grid = sizes.join(near_sizes, "task").select("task", *(F.ceil(F.col(n) / tile_rows).cast("int").alias(g) for n, g in (("n_own", "rows"), ("n_near", "cols"))))
    grid = F.broadcast(cut(grid))
    slot = F.xxhash64("fp", F.lit("grid"))
    own = (
        tiled.select("fp", F.col("tile").alias("task")).join(grid, "task")
        .select("task", F.pmod(slot, F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(True).alias("own"), "fp")
    )
    near = near.join(grid, "task").select("task", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(slot, F.col("cols")).cast("int").alias("col"), F.lit(False).alias("own"), "fp")
    return own.unionByName(near).groupBy("task", "row", "col").applyInArrow(_comparison(radius), "a long, b long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, rows, root, component_id) of each distinct fp: its rows, its group, and the smallest id in that."""
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    roots = connected_components(links(classes, radius)).select(F.col("node").alias("fp"), "root")
    linked = cut(classes.join(roots, "fp"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    linked = join_split(linked.select("fp", "root"), smallest, "root", "prints").select("fp", "root", "component_id")
    return classes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id that links reach."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = cut(_grouped(prints, radius).select("fp", "rows", "component_id"))
    return join_split(prints, groups, "fp", "rows").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: the one with the smallest id.

    Of rows that share that id, one stays; of a group without any id, one row stays. Columns come
    back as they are, whatever they are called.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    groups = cut(_grouped(prints, radius))
    kept = groups.select(F.col("component_id").alias(id_col)).filter(F.col(id_col).isNotNull()).distinct()
    stay = docs.join(kept, id_col, "left_semi")
    ids = prints.agg(F.count("id").alias("n"), F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first()
    if ids["n"] > ids["ids"]:
        stay = stay.dropDuplicates([id_col])
    if ids["rows"] > ids["n"]:
        fp, root = (free_prefix(docs, p) for p in ("_fp", "_root"))
        nameless = groups.filter(F.col("component_id").isNull()).select(F.col("fp").alias(fp), F.col("root").alias(root))
        rows = docs.filter(F.col(id_col).isNull()).withColumn(fp, F.pandas_udf(_fingerprint_column, LongType())(F.col(text_col).cast("string")))
        stay = stay.unionByName(rows.join(nameless, fp).dropDuplicates([root]).select(docs.columns))
    return stay.select(docs.columns)


def _fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series([int(np.uint64(fingerprint(t.encode() if t else None)).astype(np.int64)) for t in texts])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
