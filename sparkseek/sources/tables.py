"""The driver's tables seen as catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.schema import conform

DAY_MS, START_MS = 86_400_000, 1_704_067_200_000
BLOCK, STEP_MS = 40, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_catalog(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """A catalog item for every document; joins only what the caller reads are kept by the optimiser."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = d.join(labels, "doc_id", "left")
    if vectors:
        rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    i = F.col("doc_id")
    name = F.concat(F.lit("doc"), i, F.lit("."), F.col("lang"))
    tags = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda t: t.isNotNull())
    return conform(
        rows.select(
            i.alias("id"), name.alias("name"), F.concat(F.lit("/lib/"), F.col("source")).alias("folder"),
            F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"), F.col("n_chars").alias("size"),
            (F.lit(START_MS) + F.floor(i / BLOCK) * DAY_MS + i % BLOCK * STEP_MS).alias("mtime"), "text", tags.alias("user_tags"), F.array("lang").alias("collections"),
            "embedding", F.when(F.col("embedding").isNotNull(), "v1").alias("embedding_version"), F.when(F.col("embedding").isNotNull(), 2).otherwise(1).alias("stage"),
            (i % 10 == 0).alias("pinned"), (i % 50 == 49).alias("hidden"), (1 + i % 1920).cast("int").alias("width"), (1 + F.col("n_chars") % 1080).cast("int").alias("height"),
        )
    )


def events_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog item for every event, with a hash of 64 signs of one of the vectors, in turn."""
    e = table(spark, sf_dir, "events")
    v = table(spark, sf_dir, "embeddings")
    bit = F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.lit(0).cast("long")))
    signs = v.select(F.col("vec_id").alias("h"), F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)).alias("dhash"))
    rows = e.withColumn("h", F.pmod("event_id", F.lit(max(1, v.count())))).join(signs, "h", "left")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return conform(rows.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("folder"), ms.alias("mtime"), F.array("event_type").alias("tags"), "dhash", F.lit(1).alias("stage"), F.lit("").alias("text"), F.concat(F.lit("/e/"), F.col("event_id")).alias("path")))


def orders_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("order"), F.col("o_orderkey"), F.lit("."), F.col("o_orderstatus"))
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return conform(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("folder"), ms.alias("mtime"), F.round("o_totalprice").cast("long").alias("size"), name.alias("name"), F.concat(F.lit("/o/"), name).alias("path"), F.col("o_orderstatus").alias("text"), F.lit(1).alias("stage")))


def pages_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return conform(p.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.col("url").alias("source_url"), F.concat(F.lit("/p/"), F.col("page_id")).alias("path"), F.lit(1).alias("stage")))
