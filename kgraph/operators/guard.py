"""Text policy: find wording that promises more than the data can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph import constants as K


def matched_pattern(text: Column | str, patterns=K.GUARD_PATTERNS) -> Column:
    """The first pattern, in list order, that the text matches; null if clean."""
    text = F.col(text) if isinstance(text, str) else text
    hit = lambda p: text.rlike(f"(?iU){p}")
    chain = reduce(lambda acc, p: acc.when(hit(p), F.lit(p)), patterns[1:], F.when(hit(patterns[0]), F.lit(patterns[0])))
    return chain


def scan(texts: DataFrame, column: str, patterns=K.GUARD_PATTERNS) -> DataFrame:
    found = matched_pattern(column, patterns)
    return texts.withColumn("matched_pattern", found).withColumn("clean", F.col("matched_pattern").isNull())


def require_clean(texts: DataFrame, columns: list[str], patterns=K.GUARD_PATTERNS) -> DataFrame:
    """Rows unchanged; the job fails when a column holds forbidden wording."""
    kept = texts
    for column in columns:
        pattern = matched_pattern(F.coalesce(F.col(column), F.lit("")), patterns)
        message = F.concat(F.lit("entitlement language ("), pattern, F.lit("): "), F.substring(F.col(column), 1, 80))
        kept = kept.filter(F.when(pattern.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return kept
