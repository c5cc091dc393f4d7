"""The discover answer for a table of interest queries: one table per section, or all sections as tagged rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.operators import advise as A
from kgraph.operators import guard as G
from kgraph.sources.staging import stage


def discover(queries: DataFrame, query_ku: DataFrame, units: DataFrame, aligned: DataFrame, courses: DataFrame,
             declared: DataFrame, level: str = "all", strict: bool = True) -> dict[str, DataFrame]:
    """Resolved units, ranked courses, combinations, thin coverage and status.

    `queries` is (query_id), `query_ku` (query_id, ku_id) from resolve. When
    strict, wording that promises too much fails the job, as in all sections that
    show text.
    """
    query_ku = stage(query_ku.select("query_id", "ku_id").distinct(), "interest")
    totals = A.query_sizes(query_ku)
    matches = stage(A.match_courses(query_ku, aligned, courses, level), "matches")
    scored = A.with_scores(matches, totals)
    ranked = scored.select(
        "query_id", "course_id", "course_number", "subject_code", "title", "level", F.lit("").alias("credits"),
        "description_excerpt", F.round("relevance_score", 3).alias("relevance_score"), "coverage_breadth",
        "covered_kus", F.lit("inferred").alias("evidence_basis"), F.round("mean_confidence", 3).alias("confidence"),
        F.lit(K.COVERAGE_CAVEAT).alias("caveat"),
    )
    combos = A.combinations(scored, declared).withColumn(
        "combined_relevance", F.round("combined_relevance", 3)
    ).withColumn("caveat", F.lit(K.COVERAGE_CAVEAT))
    if strict:
        ranked = G.require_clean(ranked, ["title", "description_excerpt", "caveat"])
    # Thin notes belong to answers that found courses.
    answered = matches.select("query_id").distinct()
    thin = A.thin_coverage(query_ku, units, aligned).join(answered, "query_id", "left_semi")
    return {
        "resolved_kus": A.ku_labels(query_ku, units),
        "courses": ranked,
        "combinations": combos,
        "thin_coverage": A.ku_labels(thin.select("query_id", "ku_id"), units).drop("knowledge_area"),
        "status": A.discover_status(queries, query_ku, matches),
    }


def _joined(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string")))


def discover_answer(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections of `discover` as rows: query_id, section, position, item, label, detail, score, confidence, note.

    Every query has one `status` row, whatever it found; its item is the status and its label the message. `unit` and
    `thin` rows name units, `course` rows courses with what they cover, `combination` rows sets of courses in their order.
    """
    text, number = (lambda c: c.cast("string")), F.lit(None).cast("double")

    def tagged(name: str, rows: DataFrame, item: Column, label: Column, detail: Column = F.lit(""), score: Column = number,
               confidence: Column = number, note: Column = F.lit(""), position: Column = F.lit(None)) -> DataFrame:
        return rows.select(
            "query_id", F.lit(name).alias("section"), position.cast("bigint").alias("position"), text(item).alias("item"),
            F.coalesce(label, F.lit("")).alias("label"), detail.alias("detail"), score.alias("score"),
            confidence.alias("confidence"), note.alias("note"))

    c = F.col
    parts = [
        tagged("status", sections["status"], c("status"), c("status_message")),
        tagged("unit", sections["resolved_kus"], c("ku_id"), c("label"), c("knowledge_area")),
        tagged("course", sections["courses"], c("course_id"), c("title"),
               F.concat("coverage_breadth", F.lit(": "), _joined("covered_kus")), c("relevance_score"), c("confidence"),
               c("caveat")),
        tagged("combination", sections["combinations"], _joined("course_ids"), c("combined_coverage_breadth"),
               _joined("combined_kus"), c("combined_relevance"), note=c("caveat"), position=c("position")),
        tagged("thin", sections["thin_coverage"], c("ku_id"), c("label")),
    ]
    return reduce(DataFrame.unionByName, parts)
