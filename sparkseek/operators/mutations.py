"""Changes to the catalog, each giving the new tables; writing them is a versioned rewrite."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds on what a user may write.
MAX_NOTE, MAX_LABEL, MAX_LABELS, MAX_URL, MAX_QUERY = 32_000, 128, 64, 8_192, 8_192


def clean_labels(labels: list[str]) -> list[str]:
    """Trimmed labels without empty ones; of those that differ in case only, the first."""
    kept: dict[str, str] = {}
    for label in (x.strip() for x in labels):
        if len(label.encode()) > MAX_LABEL:
            raise ValueError("a tag or collection is too long")
        if label:
            kept.setdefault(label.lower(), label)
    if len(kept) > MAX_LABELS:
        raise ValueError("too many tags or collections")
    return list(kept.values())


def clean_label_column(labels: Column) -> Column:
    """The same for a column of labels, in bulk."""
    trimmed = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")
    new = lambda seen, x: ~F.exists(seen, lambda s: F.lower(s) == F.lower(x))
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda seen, x: F.when(new(seen, x), F.concat(seen, F.array(x))).otherwise(seen))


def validate(note: str = "", tags: list[str] = (), collections: list[str] = (), source_url: str = "") -> dict:
    """Metadata as it is stored, or an error that says what is wrong with it."""
    if len(note.encode()) > MAX_NOTE:
        raise ValueError("the note is too long")
    url = source_url.strip()
    if url:
        parts = urlsplit(url)
        if len(url.encode()) > MAX_URL or parts.scheme not in ("http", "https") or not parts.hostname or parts.username is not None or parts.password is not None:
            raise ValueError("the address must be http or https, with a host and without credentials")
    return {"note": note, "user_tags": clean_labels(list(tags)), "collections": clean_labels(list(collections)), "source_url": url}


def _where(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def pin(catalog: DataFrame, item: int, pinned: bool) -> DataFrame:
    return _where(catalog, F.col("id") == item, {"pinned": F.lit(pinned)})


def update_metadata(catalog: DataFrame, item: int, **metadata) -> DataFrame:
    """The catalog with an item's metadata replaced; the item must be there and shown."""
    clean = validate(**metadata)
    if catalog.filter((F.col("id") == item) & ~F.col("hidden")).isEmpty():
        raise KeyError(item)
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    values = {"note": F.lit(clean["note"]), "user_tags": strings(clean["user_tags"]), "collections": strings(clean["collections"]), "source_url": F.lit(clean["source_url"])}
    out = _where(catalog, F.col("id") == item, values)
    return out.withColumn("user_tags_json", F.to_json("user_tags")) if "user_tags_json" in out.columns else out


def set_relevant(feedback: DataFrame, query: str, item: int, relevant: bool) -> DataFrame:
    """Feedback with or without the mark that an item does not belong to this very query."""
    key = query.strip().lower()
    if not 1 <= len(key.encode()) <= MAX_QUERY:
        raise ValueError("the query is empty or too long")
    rest = feedback.filter(~((F.col("query") == key) & (F.col("shot_id") == item)))
    if relevant:
        return rest
    return rest.unionByName(feedback.sparkSession.createDataFrame([(key, item)], "query string, shot_id long"))


def hide(catalog: DataFrame, ids: list[int], hidden: bool = True) -> DataFrame:
    """Takes items out of sight, or back: the first half of a deletion, and its undo."""
    return _where(catalog, F.col("id").isin(ids), {"hidden": F.lit(hidden)})


def due_deletions(timers: DataFrame, now_ms: int, undo_ms: int = 8_000) -> DataFrame:
    """(id) of hidden items whose time for an undo is over; timers holds (id, hidden_ms)."""
    return timers.filter(F.col("hidden_ms") + undo_ms <= now_ms).select("id")


def delete(catalog: DataFrame, ids: DataFrame, *side_tables: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """The catalog and its side tables (each with the name of its id column) without these items."""
    gone = ids.select("id").distinct()
    rest = [t.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*t.columns) for t, c in side_tables]
    return (catalog.join(gone, "id", "left_anti").select(*catalog.columns), *rest)


def stored(catalog: DataFrame, read: DataFrame) -> DataFrame:
    """The catalog after reading files: text, tags and hashes replaced, the embedding reset, failures marked.

    read holds (id, ok, message, text, lines, dhash, colors, tags). A failed first reading sets
    stage -1; a failed later one keeps what was read before.
    """
    from sparkseek.functions.text import fold, folded_length

    fresh = read.select("id", *(F.col(c).alias(f"r_{c}") for c in ("ok", "message", "text", "lines", "dhash", "colors", "tags")))
    rows = catalog.join(fresh, "id", "left")
    ok, failed = F.coalesce(F.col("r_ok"), F.lit(False)), F.coalesce(~F.col("r_ok"), F.lit(False))
    values = {c: F.when(ok, F.col(f"r_{c}")).otherwise(F.col(c)) for c in ("text", "lines", "dhash", "colors", "tags")}
    values |= {
        "norm": F.when(ok, fold(F.col("r_text"))).otherwise(F.col("norm")),
        "norm_length": F.when(ok, folded_length(F.col("r_text"))).otherwise(F.col("norm_length")),
        "embedding": F.when(~ok, F.col("embedding")),
        "embedding_version": F.when(~ok, F.col("embedding_version")),
        "stage": F.when(ok, 1).when(failed & (F.col("stage") == 0), -1).otherwise(F.col("stage")),
        "error": F.when(ok, None).when(failed, F.col("r_message")).otherwise(F.col("error")),
        "ocr": F.when(ok, 0).otherwise(F.col("ocr")),
    }
    return rows.withColumns({c: v for c, v in values.items() if c in catalog.columns}).select(*catalog.columns)


def embedded(catalog: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """The catalog with vectors (id, embedding) of this model; such rows are done."""
    rows = catalog.join(vectors.select("id", F.col("embedding").alias("_new")), "id", "left")
    got = F.col("_new").isNotNull()
    return rows.withColumns({"embedding": F.coalesce("_new", "embedding"), "embedding_version": F.when(got, version).otherwise(F.col("embedding_version")), "stage": F.when(got, 2).otherwise(F.col("stage"))}).select(*catalog.columns)


def rebuild(catalog: DataFrame) -> DataFrame:
    """Ids to read again when all is read anew."""
    return catalog.filter(F.col("stage") != 0).select("id")


def retry(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog with failed sharp readings to do again, and ids of rows to read again."""
    again = catalog.filter((F.col("stage") == -1) | F.col("error").isNotNull()).select("id")
    return _where(catalog, F.col("ocr") == -1, {"ocr": F.lit(0)}), again


def clear(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Empty catalog, feedback and queue."""
    from sparkseek.schema import FEEDBACK, REFRESH_QUEUE, empty_catalog

    return empty_catalog(spark), spark.createDataFrame([], FEEDBACK), spark.createDataFrame([], REFRESH_QUEUE)
