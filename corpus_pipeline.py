"""A corpus pipeline: each stage reads what the one before it kept.

A stage gets the session, its documents and the folder of the tables. All but the last return the
columns of documents as they are, whatever else the table holds and whatever it is called.

Defined cases, stage by stage. Nulls and texts without a letter are in no language and are dropped
first; with no row to learn from, that is every row. Of near duplicates the smallest id stays, of rows
that share it one, and of rows without an id one. An empty benchmark drops nothing. Null sources and
languages are values of their own. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import decontam, langid, mixing, sharding, simhash
from sparkseek.llm.common import checkpoint_folder, load


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject."""
    found = langid.identify(docs, langid.train(docs), prefix="_language_")
    return found.filter(~F.col("_language_rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark windows."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that source, language and topic meet their target token shares."""
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its shard and its place there."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing_to_target_weights", mix_sources),
    ("sharding", shard),
]

#: The fingerprints, hash draws and language models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again.

    A stage's files are removed once the next stage has been written; those that the last one reads stay.
    """
    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
