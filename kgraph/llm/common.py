"""What the corpus operators share: tables, folds, batch sizes, names of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker. A batch ends at whichever comes first, so a
#: worker holds a few megabytes however long single texts are.
BATCH_ROWS = 256
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo `modulus`; null keys have none."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def is_held_out(key: str | Column, modulus: int, rest: int) -> Column:
    """True for the held-out fold. Rows without a key are never learned from, so they count as held out."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(True))


def clean_text(name: str = "text") -> Column:
    """The text as valid UTF-8, empty where it is null."""
    return F.coalesce(F.make_valid_utf8(F.col(name)), F.lit(""))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Python worker holds at a time, for all plans that follow in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of `df` except those that an operator is about to write; a clash is won by the operator."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]
