"""Connected components of a table of links, by smallest labels and pointer jumping.

Each round is a few joins and map-side combined minima; it is written to the shared folder, so a lost executor costs
a task. A hub with very many links is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """`node` and `label` (the smallest node of its component) for all nodes of `links` (a, b)."""
    both = stage(links.select("a", "b").union(links.select("b", "a")), "links-both")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        known = labels.withColumnsRenamed({"node": "b", "label": "near"})
        nearest = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(nearest, "node").select("node", "label", F.least("label", "near").alias("next"))
        heads = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = stage(lower.join(heads, "next", "left").select(
            "node", F.least("next", F.coalesce("jump", "next")).alias("label"),
            (F.least("next", F.coalesce("jump", "next")) < F.col("label")).alias("changed")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return labels
