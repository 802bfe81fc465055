"""Reading files by a reader that the caller gives: batches with errors of their own, storing, and second readings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.operators import bursts, lines, mutations
from sparkseek.operators.components import connected_components

READ = f"id long, ok boolean, message string, text string, lines {lines.LINES}, dhash long, colors array<string>, tags array<string>"

#: From a path and its bytes to what was read of it: any of lines (t, x, y, w, h), dhash, colors and tags.
Reader = Callable[[str, bytes], dict]


def read_batch(files: DataFrame, reader: Reader) -> DataFrame:
    """Rows of READ from files (id, path, content). What a reader raises becomes the message of that file alone."""

    def one(item: int, path: str, content: bytes) -> dict:
        try:
            got = reader(path, bytes(content))
            said = [dict(x) for x in got.get("lines", [])]
            return {"id": item, "ok": True, "message": None, "text": "\n".join(x["t"] for x in said), "lines": said, **{c: got.get(c, [] if c != "dhash" else None) for c in ("dhash", "colors", "tags")}}
        except Exception as e:  # whatever a reader raises is about its file
            return {"id": item, "ok": False, "message": f"{type(e).__name__}: {e}"[:500], "text": None, "lines": None, "dhash": None, "colors": None, "tags": None}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = pd.DataFrame([one(*r) for r in zip(rows["id"], rows["path"], rows["content"])], columns=["id", "ok", "message", "text", "lines", "dhash", "colors", "tags"])
            yield got.astype({"dhash": "Int64"})

    return files.select("id", "path", "content").mapInPandas(read, READ)


def store(catalog: DataFrame, read: DataFrame) -> DataFrame:
    """The catalog with what was read, each row that was read in the group of its most alike neighbour.

    Rows of the batch that lead to each other share a group: the smallest that one of them or of
    their neighbours is in, or else a new one under the smallest id. Rows that are alike nothing,
    and rows that were not read, keep the group they have.
    """
    new = mutations.stored(catalog, read)
    fresh = read.filter("ok").select("id")
    best = bursts.best_neighbours(new).join(fresh, "id", "left_semi")
    roots = connected_components(best.select(F.col("id").alias("a"), F.col("neighbour").alias("b")))
    nodes = roots.select(F.col("node").alias("id"), "root").join(new.select("id", "group_id"), "id")
    groups = nodes.groupBy("root").agg(F.coalesce(F.min("group_id"), F.min("id")).alias("joined"))
    joins = nodes.join(groups, "root").select("id", "joined")
    rows = new.join(joins, "id", "left").withColumn("group_id", F.when(F.col("group_id").isNull() | F.col("joined").isNotNull(), F.col("joined")).otherwise(F.col("group_id")))
    return rows.select(catalog.columns)


def sharpened(catalog: DataFrame, read: DataFrame) -> DataFrame:
    """The catalog after second readings: their lines come first, earlier ones fill in what they don't cover.

    Colour tags stay as they are, others are taken anew; a failed second reading is marked and changes nothing else.
    """
    from sparkseek.functions.text import fold, folded_length

    fresh = read.select("id", F.col("ok").alias("r_ok"), F.col("lines").alias("r_lines"), F.col("tags").alias("r_tags"))
    rows = catalog.join(fresh, "id", "left")
    ok = F.coalesce("r_ok", F.lit(False))
    merged = lines.merge_lines(F.col("r_lines"), F.col("lines"))
    rows = rows.withColumn("lines", F.when(ok, merged).otherwise(F.col("lines")))
    text = lines.line_text(F.col("lines"))
    kept = F.filter("tags", lambda t: t.startswith("c:"))
    values = {
        "text": F.when(ok, text).otherwise(F.col("text")),
        "norm": F.when(ok, fold(text)).otherwise(F.col("norm")),
        "norm_length": F.when(ok, folded_length(text)).otherwise(F.col("norm_length")),
        "tags": F.when(ok, F.array_distinct(F.concat(kept, F.filter("r_tags", lambda t: ~t.startswith("c:"))))).otherwise(F.col("tags")),
        "ocr": F.when(ok, 1).when(F.col("r_ok").isNotNull(), -1).otherwise(F.col("ocr")),
    }
    return rows.withColumns({c: v for c, v in values.items() if c in catalog.columns}).select(catalog.columns)
