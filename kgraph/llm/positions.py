"""Gapless positions inside groups of any size, without a group ever lying in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgraph.sources.staging import stage


def positioned(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with `pos` (0, 1, ... inside its group in ascending `order`, nulls first) and `total` (rows of the group).

    The group column must not be null. Rows are dealt by ranges of (group, order), and equal rows by their place in the
    input, so neither a group nor a repeated row has to fit a task. What is summed across tasks is one number for each
    group in each range; that table is joined back by (range, group), the keys by which rows are numbered.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(ranges, group, *order, "_tie").withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    counts = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(of_group).alias("total"))
    inside = Window.partitionBy("_range", group).orderBy(*order, "_tie")
    return (
        dealt.withColumn("_row", F.row_number().over(inside)).join(offsets, ["_range", group])
        .withColumn("pos", F.col("_offset") + F.col("_row") - 1)
        .select(*df.columns, "pos", "total")
    )
