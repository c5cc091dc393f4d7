"""Scoring expressions: levels, signals, confidence bands, ranking scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgraph import constants as K


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def level_digit(course_number) -> Column:
    """First character of the course number as a digit, null when it is none."""
    return F.substring(_col(course_number), 1, 1).try_cast("int")


def filter_level(digit) -> Column:
    """Whole level used by the never-upward rule; unknown counts as 3."""
    return F.coalesce(_col(digit), F.lit(K.LEVEL_WHEN_UNKNOWN))


def normalised_level(digit) -> Column:
    """Level digit mapped from 1..6 to 0..1 and clipped; unknown is 0.5."""
    scaled = (_col(digit) - F.lit(1)) / F.lit(5.0)
    # least and greatest skip nulls, so the unknown case comes first.
    return F.when(scaled.isNull(), F.lit(K.NORMALISED_LEVEL_WHEN_UNKNOWN)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    )


def ku_depth(tier) -> Column:
    return F.when(_col(tier) == "core", F.lit(K.CORE_DEPTH)).otherwise(F.lit(K.ELECTIVE_DEPTH))


def rerank_score(similarity, cooccurrence, level_proximity) -> Column:
    """Weighted rerank score; the terms are added in a fixed order."""
    return (
        F.lit(K.WEIGHT_SIMILARITY) * _col(similarity)
        + F.lit(K.WEIGHT_COOCCURRENCE) * _col(cooccurrence)
        + F.lit(K.WEIGHT_LEVEL_PROXIMITY) * _col(level_proximity)
        + F.lit(K.WEIGHT_DEPARTMENT_PRIOR * K.DEPARTMENT_PRIOR)
    )


def margin_confidence(top, runner_up, temperature: float = K.CONFIDENCE_TEMPERATURE) -> Column:
    """Two-way softmax of the best scores, or a sigmoid when there is only one."""
    width = max(temperature, K.TEMPERATURE_FLOOR)
    single = F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(top)))
    margin = F.lit(1.0) / (F.lit(1.0) + F.exp((_col(runner_up) - _col(top)) / F.lit(width)))
    return F.when(_col(top).isNull(), F.lit(0.0)).when(_col(runner_up).isNull(), single).otherwise(margin)


def course_level_signal(dependent_level, dependency_level) -> Column:
    """Positive part of the difference of two normalised levels, at most 1."""
    gap = _col(dependent_level) - _col(dependency_level)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), gap))


def prior_from_hops(hops) -> Column:
    h = _col(hops)
    return (
        F.when(h == 1, F.lit(K.PRIOR_DIRECT))
        .when(h == 2, F.lit(K.PRIOR_TWO_HOPS))
        .when(h <= K.PRIOR_MAX_HOPS, F.lit(K.PRIOR_FURTHER))
        .otherwise(F.lit(0.0))
    )


def area_signal(same_area) -> Column:
    return F.when(_col(same_area), F.lit(K.SAME_AREA)).otherwise(F.lit(K.OTHER_AREA))


def dependency_score(level_signal, prior, cooccurrence, weights=None) -> Column:
    """Weighted structural score. The order of addition decides the 0.55 edge."""
    w_level, w_prior, w_area = weights or (
        K.WEIGHT_COURSE_LEVEL, K.WEIGHT_PREREQUISITE_PRIOR, K.WEIGHT_KU_COOCCURRENCE,
    )
    return (
        F.lit(w_level) * _col(level_signal)
        + F.lit(w_prior) * _col(prior)
        + F.lit(w_area) * _col(cooccurrence)
    )


def confidence_band(confidence, high: float = K.BAND_HIGH, medium: float = K.BAND_MEDIUM) -> Column:
    c = _col(confidence)
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def composite_score(covered, total, mean_confidence) -> Column:
    """Share of requested units covered, weighted by mean confidence."""
    return F.when(
        _col(total) > 0, _col(covered) / _col(total) * _col(mean_confidence)
    ).otherwise(F.lit(0.0))


def coverage_breadth(covered, total) -> Column:
    return F.concat(
        _col(covered).cast("string"), F.lit(" of "), _col(total).cast("string"), F.lit(" concepts")
    )


def ratio(numerator, denominator) -> Column:
    """Quotient that is 0 when nothing was counted."""
    return F.when(_col(denominator) > 0, _col(numerator) / _col(denominator)).otherwise(F.lit(0.0))


def f1(precision, recall) -> Column:
    p, r = _col(precision), _col(recall)
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def seeded_order(key, seed: int) -> Column:
    """A repeatable shuffle key that depends neither on partitioning nor on the engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _col(key).cast("string")).cast("binary"))
