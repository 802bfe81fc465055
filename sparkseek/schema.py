"""The catalog's schema, and old tables brought up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.text import fold, folded_length
from sparkseek.operators.lines import LINES

#: Column, type, and the value that a table without the column gets.
COLUMNS = {
    "id": ("long", None), "path": ("string", None), "folder": ("string", ""), "name": ("string", ""), "mtime": ("long", 0), "size": ("long", 0),
    "width": ("int", 0), "height": ("int", 0), "stage": ("int", 0), "error": ("string", None), "text": ("string", ""), "norm": ("string", None),
    "lines": (LINES, []), "dhash": ("long", None), "colors": ("array<string>", []), "tags": ("array<string>", []), "group_id": ("long", None),
    "pinned": ("boolean", False), "hidden": ("boolean", False), "embedding": ("array<float>", None), "embedding_version": ("string", None),
    "ocr": ("int", 0), "note": ("string", ""), "user_tags": ("array<string>", []), "collections": ("array<string>", []), "source_url": ("string", ""),
}
FEEDBACK = "query string, shot_id long"
REFRESH_QUEUE = "id long"


def conform(df: DataFrame) -> DataFrame:
    """df with all catalog columns in their types; missing and null ones get their defaults.

    Keeps other columns. norm is the folded text where it is missing, norm_length its length, which
    is had without folding, and user_tags_json the tags as the text index sees them.
    """
    have = {c.lower() for c in df.columns}
    out = []
    for name, (kind, default) in COLUMNS.items():
        column = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if default is not None:
            column = F.coalesce(column, F.array().cast(kind) if default == [] else F.lit(default).cast(kind))
        out.append(column.alias(name))
    extra = [c for c in df.columns if c.lower() not in COLUMNS and c not in ("user_tags_json", "norm_length")]
    df = df.select(*out, *extra)
    length = F.coalesce(F.length("norm"), folded_length(F.col("text"))) if "norm" in have else folded_length(F.col("text"))
    return df.withColumns({"norm": F.coalesce("norm", fold(F.col("text"))), "norm_length": length, "user_tags_json": F.to_json("user_tags")})


def empty_catalog(spark: SparkSession) -> DataFrame:
    return conform(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, (t, _) in COLUMNS.items())))
