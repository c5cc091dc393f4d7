"""Registered alignment and resolution queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgraph.operators import align as L
from kgraph.operators import evaluate as E
from kgraph.plans.mapping import Tables
from kgraph.plans.oracle import with_views
from kgraph.sources.staging import stage


def _r6(column: str):
    return F.round(column, 6).alias(column)


def _candidates(t: Tables):
    found = L.topk_cosine(
        t.vector_concept().select(F.col("concept_id").alias("id"), "vector"), t.vocabulary(), L.K.RETRIEVE_TOP_K
    )
    return found.select(F.col("id").alias("concept_id"), "ku_id", "similarity", "rank")


def _funnel(t: Tables):
    """Candidates, concepts, units and predicted areas, each written once."""
    candidates = stage(_candidates(t).drop("rank"), "candidates")
    concepts = t.vector_concept().select("concept_id", "course_id", "course_number")
    units = stage(t.vocabulary().drop("vector"), "units")
    return candidates, concepts, units, stage(L.predict_areas(candidates, concepts, units), "areas")


def topk_cosine(spark, folder):
    return _candidates(Tables(spark, folder)).select(
        "concept_id", "ku_id", _r6("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


def predicted_areas(spark, folder):
    return _funnel(Tables(spark, folder))[3]


def rerank(spark, folder):
    return L.rerank(*_funnel(Tables(spark, folder))).select(
        "concept_id", "ku_id", _r6("cooccurrence"), _r6("score"), F.col("rank").cast("bigint").alias("rank")
    )


def cooccurrence(spark, folder):
    return (
        L.rerank(*_funnel(Tables(spark, folder)))
        .select("concept_id", "knowledge_area", _r6("cooccurrence")).distinct()
    )


def verify_margin(spark, folder):
    candidates, concepts, units, areas = _funnel(Tables(spark, folder))
    return L.verify(L.rerank(candidates, concepts, units, areas), concepts).select(
        "concept_id", "ku_id", _r6("confidence"), "status"
    )


def _judgements(ranked):
    """A second opinion that refuses odd units for concepts of level 1."""
    return ranked.filter("rank = 1 and course_level = 0").select(
        "concept_id", "ku_id", (F.col("ku_id") % 2 == 0).alias("belongs")
    )


def judged_alignment(spark, folder):
    candidates, concepts, units, areas = _funnel(Tables(spark, folder))
    ranked = L.rerank(candidates, concepts, units, areas)
    return L.apply_judgements(L.verify(ranked, concepts), _judgements(ranked)).select(
        "concept_id", "ku_id", _r6("confidence"), "status"
    )


def _aligned(t: Tables):
    candidates, concepts, units, areas = _funnel(t)
    return L.align(L.rerank(candidates, concepts, units, areas), concepts), concepts, units


def reject_fixpoint(spark, folder):
    return _aligned(Tables(spark, folder))[0].select("concept_id", "ku_id", _r6("confidence"), "status", "n_rejected")


def concept_records(spark, folder):
    aligned, concepts, _ = _aligned(Tables(spark, folder))
    return L.concept_records(aligned, concepts).withColumn("confidence", F.round("confidence", 6))


def coverage_index(spark, folder):
    t = Tables(spark, folder)
    return L.coverage_counts(t.aligned_concept(), t.knowledge_unit())


def coverage_courses(spark, folder):
    return L.coverage_pairs(Tables(spark, folder).aligned_concept())


def first_per_label(spark, folder):
    """First order line per (part, supplier) in (order, line) order."""
    lines = Tables(spark, folder).read("lineitem").select(
        F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("label"),
        F.struct("l_orderkey", "l_linenumber").alias("pos"),
    )
    return L.first_per_label(lines).select("course_id", "label")


def labels_to_embed(spark, folder):
    """Labels of parts that no part of the largest size already carries."""
    label = F.concat_ws(" ", "p_brand", "p_name").alias("label")
    part = Tables(spark, folder).read("part")
    return L.labels_to_embed(part.select(label), part.filter("p_size = 50").select(label))


def extraction_summary(spark, folder):
    t = Tables(spark, folder)
    courses = t.course().withColumn("description", F.col("title"))
    return L.extraction_summary(courses, t.concept())


def _interest_vectors(t: Tables):
    return t.vector_concept().select(F.col("concept_id").alias("query_id"), "vector")


def resolve_interest(spark, folder):
    t = Tables(spark, folder)
    return L.resolve(_interest_vectors(t), t.vocabulary()).select(
        "query_id", "ku_id", _r6("similarity"), F.col("pos").cast("bigint").alias("pos")
    )


def select_units(spark, folder):
    """Queries select their odd units in reverse; every third query selects none
    that exists, and falls back."""
    t = Tables(spark, folder)
    resolved = stage(L.resolve(_interest_vectors(t), t.vocabulary()), "resolved")
    real = (F.col("query_id") % 3 != 0) & (F.col("ku_id") % 2 == 1)
    picks = resolved.select(
        "query_id", F.when(real, F.col("ku_id")).otherwise(F.lit(-1)).alias("ku_id"), (-F.col("pos")).alias("pos")
    )
    return L.select_units(resolved, picks, "embed", "select").withColumn("pos", F.col("pos").cast("bigint"))


def _relevance(t: Tables):
    resolved = L.resolve(_interest_vectors(t), t.vocabulary())
    expected = t.vector_concept().select(
        F.col("concept_id").alias("query_id"), F.concat(F.lit("A"), F.col("label").cast("string")).alias("area")
    )
    return E.query_relevance(expected, resolved, t.vocabulary().drop("vector"))


def query_relevance(spark, folder):
    return _relevance(Tables(spark, folder)).select(
        "query_id", "n_expected", "n_resolved", _r6("precision"), _r6("recall")
    )


def macro_relevance(spark, folder):
    return E.macro_relevance(_relevance(Tables(spark, folder))).select(
        _r6("macro_precision"), _r6("macro_recall"), _r6("macro_f1"), "query_count"
    )


VIEWS = {
    "vec": """SELECT vec_id AS concept_id, vec_id // 5 AS course_id, CAST(label AS BIGINT) AS label,
        1 + (vec_id // 5) % 6 AS digit, CAST(embedding AS DOUBLE[]) AS e FROM embeddings""",
    "vocab": """SELECT ku_id, 'A' || CAST(ku_id // 4 AS VARCHAR) AS knowledge_area, list(m ORDER BY pos) AS v FROM
        (SELECT ku_id, pos, avg(x) AS m FROM (SELECT label * 4 + concept_id % 4 AS ku_id, unnest(e) AS x,
        generate_subscripts(e, 1) AS pos FROM vec) GROUP BY 1, 2) GROUP BY 1""",
    "sim": """SELECT concept_id, ku_id, s, row_number() OVER (PARTITION BY concept_id ORDER BY s DESC, ku_id) AS place
        FROM (SELECT concept_id, ku_id, list_cosine_similarity(e, v) AS s FROM vec, vocab)""",
    "plain": """SELECT c.concept_id, course_id, digit, c.ku_id, knowledge_area, s,
        0.40e0 * s + 0.35e0 * 0e0 + 0.20e0 * (1e0 - abs(greatest(0e0, least(1e0, (digit - 1) / 5e0))
        - CASE WHEN c.ku_id % 2 = 0 THEN 0.3e0 ELSE 0.7e0 END)) + 0.0025e0 AS score
        FROM sim c JOIN vec ON vec.concept_id = c.concept_id JOIN vocab ON vocab.ku_id = c.ku_id WHERE place <= 10""",
    "parea": """SELECT concept_id, course_id, knowledge_area AS area FROM (SELECT *, row_number() OVER
        (PARTITION BY concept_id ORDER BY score DESC, s DESC, ku_id) AS rn FROM plain) WHERE rn = 1""",
    "cooc": """SELECT p.concept_id, p.ku_id, p.knowledge_area, CASE WHEN count(o.concept_id) > 0 THEN
        (count(*) FILTER (WHERE o.area = p.knowledge_area)) / CAST(count(o.concept_id) AS DOUBLE) ELSE 0 END AS co
        FROM plain p LEFT JOIN parea o ON o.course_id = p.course_id AND o.concept_id <> p.concept_id GROUP BY 1, 2, 3""",
    "full_score": """SELECT p.concept_id, p.ku_id, p.knowledge_area, p.s, p.digit, co, p.score + 0.35e0 * co AS score
        FROM plain p JOIN cooc ON cooc.concept_id = p.concept_id AND cooc.ku_id = p.ku_id""",
    "graded": """SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY round(score, 12) DESC, s DESC, ku_id) AS rn
        FROM full_score""",
    "verdict": """SELECT a.concept_id, a.ku_id, a.digit, 1 / (1 + exp((b.score - a.score) / 0.1e0)) AS confidence
        FROM graded a JOIN graded b ON a.concept_id = b.concept_id AND a.rn = 1 AND b.rn = 2""",
    # One step per concept in order; `low` holds the lowest level seen of every unit, -1 where there is none.
    "step": """SELECT row_number() OVER (ORDER BY course_id, concept_id) AS i, concept_id, lvl, cands FROM (SELECT vec.concept_id,
        vec.course_id, greatest(0e0, least(1e0, (any_value(vec.digit) - 1) / 5e0)) AS lvl, list(struct_pack(unit := ku_id, score := score)
        ORDER BY rn) AS cands FROM graded JOIN vec ON vec.concept_id = graded.concept_id GROUP BY 1, 2)""",
    "settled": """SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS concept_id, CAST(NULL AS BIGINT) AS unit,
        CAST(NULL AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS n_rejected,
        (SELECT list_transform(range(max(ku_id) + 1), lambda x: -1e0) FROM vocab) AS low
        UNION ALL SELECT i, concept_id, CASE WHEN confidence >= 0.3e0 THEN kept[1].unit END, confidence, n_rejected,
        list_transform(low, lambda v, j: CASE WHEN confidence >= 0.3e0 AND j = kept[1].unit + 1
        THEN CASE WHEN v < 0 THEN lvl ELSE least(v, lvl) END ELSE v END) FROM (SELECT *, len(cands) - len(kept) AS n_rejected,
        CASE WHEN len(kept) = 0 THEN 0e0 WHEN len(kept) = 1 THEN 1 / (1 + exp(-kept[1].score))
        ELSE 1 / (1 + exp((kept[2].score - kept[1].score) / 0.1e0)) END AS confidence FROM (SELECT step.*, low,
        list_filter(cands, lambda c: NOT (lvl + 0.5e0 < low[c.unit + 1])) AS kept
        FROM settled JOIN step ON step.i = settled.i + 1))""",
    "outcome": """SELECT concept_id, unit AS ku_id, confidence, n_rejected, CASE WHEN unit IS NOT NULL THEN 'aligned'
        WHEN confidence = 0 THEN 'unaligned' ELSE 'low_confidence_unaligned' END AS status FROM settled WHERE i > 0""",
    "found": "SELECT concept_id AS query_id, ku_id, s, place FROM sim WHERE place <= 15 AND s >= 0.3",
    "relevance": """SELECT v.concept_id AS query_id, CAST(1 AS BIGINT) AS n_expected,
        count(DISTINCT f.ku_id // 4) AS n_resolved,
        CASE WHEN count(f.ku_id) > 0 THEN max(CASE WHEN f.ku_id // 4 = v.label THEN 1 ELSE 0 END)
        / CAST(count(DISTINCT f.ku_id // 4) AS DOUBLE) ELSE 0e0 END AS precision,
        CAST(max(CASE WHEN f.ku_id // 4 = v.label THEN 1 ELSE 0 END) AS DOUBLE) AS recall
        FROM vec v LEFT JOIN found f ON f.query_id = v.concept_id GROUP BY v.concept_id""",
}
V = lambda body: with_views(body, VIEWS)

QUERIES = {
    "topk_cosine": (topk_cosine, V("""SELECT concept_id, ku_id, round(s, 6) AS similarity, place AS rank FROM sim
        WHERE place <= 10""")),
    "predicted_areas": (predicted_areas, V("SELECT concept_id, course_id, area FROM parea")),
    "rerank": (rerank, V("""SELECT concept_id, ku_id, round(co, 6) AS cooccurrence, round(score, 6) AS score, rn AS rank
        FROM graded""")),
    "cooccurrence": (cooccurrence, V("""SELECT DISTINCT concept_id, knowledge_area, round(co, 6) AS cooccurrence
        FROM cooc""")),
    "verify_margin": (verify_margin, V("""SELECT concept_id, ku_id, round(confidence, 6) AS confidence,
        'aligned' AS status FROM verdict""")),
    "judged_alignment": (judged_alignment, V("""SELECT concept_id,
        CASE WHEN digit = 1 AND ku_id % 2 = 1 THEN NULL ELSE ku_id END AS ku_id, round(confidence, 6) AS confidence,
        CASE WHEN digit = 1 AND ku_id % 2 = 1 THEN 'low_confidence_unaligned' ELSE 'aligned' END AS status
        FROM verdict""")),
    "reject_fixpoint": (reject_fixpoint, V("""SELECT concept_id, ku_id, round(confidence, 6) AS confidence, status, n_rejected
        FROM outcome""")),
    "concept_records": (concept_records, V("""SELECT o.concept_id, course_id,
        CAST(digit AS VARCHAR) || lpad(CAST(course_id % 10000 AS VARCHAR), 4, '0') AS course_number, ku_id AS knowledge_unit_id,
        status AS alignment_status, round(greatest(confidence, 0.01e0), 6) AS confidence
        FROM outcome o JOIN vec ON vec.concept_id = o.concept_id""")),
    "coverage_index": (coverage_index, V("""SELECT ku.ku_id, count(DISTINCT a.course_id) AS n_courses FROM ku
        LEFT JOIN aligned a ON a.ku_id = ku.ku_id GROUP BY 1""")),
    "coverage_courses": (coverage_courses, V("SELECT DISTINCT ku_id, course_id FROM aligned")),
    "first_per_label": (first_per_label, "SELECT DISTINCT l_partkey AS course_id, l_suppkey AS label FROM lineitem"),
    "labels_to_embed": (labels_to_embed, """SELECT DISTINCT concat_ws(' ', p_brand, p_name) AS label FROM part
        WHERE concat_ws(' ', p_brand, p_name) NOT IN (SELECT concat_ws(' ', p_brand, p_name) FROM part WHERE p_size = 50)"""),
    "extraction_summary": (extraction_summary, V("""SELECT * FROM (SELECT count(*) AS courses_processed,
        count(*) FILTER (WHERE length(trim(title)) < 20) AS concepts_skipped_empty FROM course),
        (SELECT count(*) AS concepts_extracted, count(*) FILTER (WHERE alignment_status = 'aligned') AS concepts_aligned,
        CAST(0 AS BIGINT) AS concepts_low_confidence,
        count(*) FILTER (WHERE alignment_status = 'unaligned') AS concepts_unaligned FROM concept)""")),
    "resolve_interest": (resolve_interest, V("SELECT query_id, ku_id, round(s, 6) AS similarity, place AS pos FROM found")),
    "select_units": (select_units, V("""SELECT query_id, ku_id, row_number() OVER (PARTITION BY query_id ORDER BY place DESC)
        AS pos, 'embed+select' AS model_id FROM found f WHERE query_id % 3 <> 0 AND ku_id % 2 = 1
        UNION ALL SELECT query_id, ku_id, place, 'embed+fallback' FROM found f WHERE query_id % 3 = 0
        OR NOT EXISTS (SELECT 1 FROM found g WHERE g.query_id = f.query_id AND g.ku_id % 2 = 1)""")),
    "query_relevance": (query_relevance, V("""SELECT query_id, n_expected, n_resolved, round(precision, 6) AS precision,
        round(recall, 6) AS recall FROM relevance""")),
    "macro_relevance": (macro_relevance, V("""SELECT round(p, 6) AS macro_precision, round(r, 6) AS macro_recall,
        round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS macro_f1, n AS query_count
        FROM (SELECT avg(precision) AS p, avg(recall) AS r, count(*) AS n FROM relevance)""")),
}
