"""Compute an expression once per row, however often it is used later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator.

    The optimizer merges neighbouring projections and would repeat a long
    expression at each use; it does not merge through a generator. The row count
    stays the same, since the generated array has one entry.
    """
    exact = lambda name: F.col("`" + name.replace("`", "``") + "`")
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [exact(c) for c in df.columns if c not in columns]
    once = "_once"
    while once in df.columns:
        once += "_"
    return df.select(*kept, F.explode(F.array(packed)).alias(once)).select(*kept, f"{once}.*")
