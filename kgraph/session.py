"""A session with the settings the operators count on.

On a cluster the submit command owns the sizes; this builder only sets what the
results depend on (time zone) and what keeps plans adaptive.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "kgraph", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_arrow_batches(spark: SparkSession, rows: int = 128, size: int = 4 << 20) -> None:
    """Bound what a Python worker holds of landed pages at a time, for all plans that follow in this session.

    The elements of a page take many times its bytes, and a batch of 10,000 pages is held with all its elements.
    """
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(records))
    if now <= 0 or now > rows:
        spark.conf.set(records, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
