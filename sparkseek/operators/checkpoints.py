"""Where lineage is cut: the shared folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only where it is unset, as in tests, a folder under the warehouse is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_anew(df: DataFrame) -> DataFrame:
    """As cut, but without what Spark estimates of the rows from the plan before.

    A checkpoint keeps the estimated size, which a join takes to be the product of its sides. In a loop
    that joins its own results, the digits of that number multiply each round until they fill the driver.
    """
    kept, spark = cut(df), df.sparkSession
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
