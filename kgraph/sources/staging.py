"""Cut lineage by writing a table to the cluster's shared folder.

Loops that run to a fixpoint write each round as Parquet and read it back. The
table survives lost executors, and its file sizes give the optimizer true sizes
for the next join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or by setCheckpointDir."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/kgraph/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the staging folder that nothing uses yet."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the staging folder and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def stage_in_place(df: DataFrame, name: str) -> DataFrame:
    """stage, for joins by a scope and more: rows that lie by scope are joined where they lie, not shuffled by all keys.

    Tables whose scopes are few or very unequal are better staged the plain way.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CO_PARTITION)
    spark.conf.set(_CO_PARTITION, "false")
    try:
        return stage(df, name)
    finally:
        spark.conf.set(_CO_PARTITION, before)


def clear_staging(spark: SparkSession) -> None:
    """Delete this application's staged tables, once its results are stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark `df` for broadcast only once its row count is known to be bounded.

    Beyond the bound the plain table is returned and the join shuffles.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df
