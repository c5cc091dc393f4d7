"""Registered inference queries and their check SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kgraph.functions import scores as S
from kgraph.operators import closure as C
from kgraph.operators import cycles as Y
from kgraph.operators import infer as I
from kgraph.operators.ranking import confidence_stats as stats_of
from kgraph.plans import runs
from kgraph.plans.mapping import Tables
from kgraph.plans.oracle import RECURSIVE
from kgraph.plans.oracle import VIEWS as SHARED
from kgraph.plans.oracle import with_views
from kgraph.sources import tables as A
from kgraph.sources.staging import new_folder, stage


def _cells(t: Tables):
    return I.course_cells(I.concept_nodes(t.concept(), t.course(), t.knowledge_unit("region")))


def _inputs(t: Tables):
    """Cells, prior and declared pairs, written once for the plans that reuse them."""
    declared = stage(t.declared(), "declared")
    cells = stage(_cells(t), "cells")
    return cells, I.candidate_prior(cells, declared), declared


def _counts(df, *columns):
    """Exact pair counts as doubles, for a result that plain SQL can state."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def concept_nodes(spark, folder):
    t = Tables(spark, folder)
    return I.concept_nodes(t.concept(), t.course(), t.knowledge_unit("region"))


def concepts_by_unit(spark, folder):
    t = Tables(spark, folder)
    return I.concepts_by_unit(t.aligned_concept(), t.course(), t.knowledge_unit())


def declared_pairs(spark, folder):
    return I.declared_pairs(Tables(spark, folder).declared())


def prereq_prior(spark, folder):
    return I.prerequisite_prior(Tables(spark, folder).declared())


def course_level_signal(spark, folder):
    t = Tables(spark, folder)
    return I.course_level_pairs(t.declared(), t.course())


def dependency_candidates(spark, folder):
    return _counts(I.dependency_pairs(*_inputs(Tables(spark, folder))), "n_pairs")


def dependency_blocks(spark, folder):
    return _counts(I.dependency_blocks(*_inputs(Tables(spark, folder))), "n_pairs", "n_contradicted")


def ordering_contradictions(spark, folder):
    t = Tables(spark, folder)
    edges = t.dependency().groupBy(
        F.col("to_course").alias("course_a"), F.col("from_course").alias("course_b")
    ).agg(F.count(F.lit(1)).alias("n_edges"))
    return I.ordering_contradictions(edges, t.declared())


def similarity_counts(spark, folder):
    return _counts(I.similarity_counts(Tables(spark, folder).aligned_concept()), "n_edges", "n_low_confidence")


def similarity_profile(spark, folder):
    return _counts(I.similarity_profile(Tables(spark, folder).aligned_concept()), "n_edges")


def _unit_edges(t: Tables, counts):
    return counts.join(t.knowledge_unit("region"), "ku_id").groupBy(F.col("knowledge_area").alias("area")).agg(
        F.sum("n_edges").alias("n_edges")
    )


def area_coverage(spark, folder):
    t = Tables(spark, folder)
    cells, prior, declared = _inputs(t)
    return _counts(I.area_coverage(
        cells, I.pair_totals(I.dependency_pairs(cells, prior, declared)), I.dependency_blocks(cells, prior, declared),
        _unit_edges(t, I.similarity_counts(t.aligned_concept())),
    ), "concept_count", "dependency_edge_count", "similarity_edge_count").withColumn(
        "mean_confidence", F.round("mean_confidence", 6)
    )


def inference_summary(spark, folder):
    t = Tables(spark, folder)
    cells, prior, declared = _inputs(t)
    scored = stage(I.scored_courses(cells, prior, declared), "scored")
    blocks = stage(I.dependency_blocks(cells, prior, declared), "blocks")
    aligned = t.aligned_concept()
    flat = stage(I.area_pairs(scored.filter("flat"), cells), "flat-pairs")
    _, rejected = Y.resolve_cycles(I.cycle_candidates(flat, cells))
    dropped = stage(I.rejected_pairs(rejected, cells), "dropped")
    kept = I.without_rejected(flat, dropped).unionByName(I.area_pairs(scored.filter("not flat"), cells))
    summary = I.inference_summary(
        stage(I.pair_totals(kept), "totals"), blocks, I.similarity_profile(aligned), I.similarity_counts(aligned), dropped
    )
    return _counts(
        summary, "dependency_edges", "similarity_edges", "low_confidence_similarity", "edges_rejected_cycle",
        "edges_rejected_ordering", "total_candidates",
    ).select(
        "dependency_edges", "similarity_edges", "low_confidence_similarity", "edges_rejected_cycle",
        "edges_rejected_ordering", F.round("confidence_mean", 6).alias("confidence_mean"),
        *[F.round(c, 6).alias(c) for c in ("confidence_median", "confidence_p10", "confidence_p90")],
        "total_candidates", "rejection_rate_pct", "alarm",
    )


def confidence_bands(spark, folder):
    return (
        Tables(spark, folder).dependency().groupBy(S.confidence_band("confidence").alias("band"))
        .agg(F.count(F.lit(1)).alias("n_edges"))
    )


def confidence_stats(spark, folder):
    return stats_of(Tables(spark, folder).aligned_concept())


def cycle_core(spark, folder):
    """Edges left after peeling; what is on no cycle and between none is gone."""
    return Y.peel(Tables(spark, folder).same_level_edges().select("src", "dst"))


def strong_components(spark, folder):
    return Y.strong_components(Tables(spark, folder).same_level_edges())


def break_cycles(spark, folder):
    return Y.break_cycles(Tables(spark, folder).same_level_edges())


def _looped_run(t: Tables, graph: str | None, run_id: str):
    return runs.infer_graph(t.concept(), t.course(), t.knowledge_unit("region"), t.looped(), run_id, graph=graph)


def inferred_graph(spark, folder):
    """The edge table after an earlier run's edges and two runs over declared pairs with rings and contradictions: its
    edges inside one level, where cycles are possible, deleted ones included."""
    t = Tables(spark, folder)
    graph = new_folder(spark, "graph")
    earlier = t.earlier_cells().select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.lit(0.0).alias("confidence"))
    rows = A.inferred_edges(earlier, "concept_dependency", "earlier")
    A.write_inferred_edges(rows, rows.limit(0), f"{graph}/edges")
    for run_id in ("first", "second"):
        _looped_run(t, graph, run_id)
    flat = A.read_edges(spark, f"{graph}/edges").filter(F.get_json_object("to_id", "$.area").isNotNull())
    return flat.select("from_id", "to_id", "confidence", "active")


def rejection_summary(spark, folder):
    """Counts of one run over declared pairs with rings and contradictions."""
    summary = _looped_run(Tables(spark, folder), None, "run")["summary"]
    counts = ["dependency_edges", "edges_rejected_cycle", "edges_rejected_ordering", "total_candidates"]
    return _counts(summary, *counts).select(*counts, F.round("rejection_rate_pct", 6).alias("rejection_rate_pct"), "alarm")


def looped_coverage(spark, folder):
    """Per area what is left of the candidates once rejected edges are out."""
    report = _looped_run(Tables(spark, folder), None, "run")["area_coverage"]
    return _counts(report, "concept_count", "dependency_edge_count").select(
        "knowledge_area", "concept_count", "dependency_edge_count", F.round("mean_confidence", 6).alias("mean_confidence"))


def _over_looped(view: str) -> str:
    """A view's SQL over the looped pairs instead of the declared ones."""
    text = {**SHARED, **RECURSIVE, **VIEWS}[view]
    for name in ("declared", "walk", "closure", "prior", "cellpair", "candidate"):
        text = re.sub(rf"\b{name}\b(?! AS\b| numeric)", "looped" if name == "declared" else f"l{name}", text)
    return text.replace("p.lprior", "p.prior").replace("AS lprior", "AS prior")


VIEWS = {
    "cell": """SELECT c.source_course_id AS course_id, lvl AS digit, coalesce(k.knowledge_area, '') AS area, count(*) AS n
        FROM concept c JOIN course ON course.course_id = c.source_course_id
        LEFT JOIN ku_region k ON k.ku_id = c.knowledge_unit_id GROUP BY 1, 2, 3""",
    "prior": """SELECT src AS course_a, dst AS course_b, CAST(hop AS INTEGER) AS hop,
        CASE hop WHEN 1 THEN 1e0 WHEN 2 THEN 0.5e0 ELSE 0.3e0 END AS prior FROM closure WHERE src <> dst""",
    "cellpair": """SELECT p.course_a, a.area, p.course_b, a.area = b.area AS same_area, p.prior,
        0.45e0 * greatest(0e0, least(1e0, (a.digit - 1) / 5e0 - (b.digit - 1) / 5e0)) + 0.40e0 * p.prior
        + 0.15e0 * CASE WHEN a.area = b.area THEN 1e0 ELSE 0.5e0 END AS score, CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs
        FROM prior p JOIN cell a ON a.course_id = p.course_a JOIN cell b ON b.course_id = p.course_b
        WHERE b.digit <= a.digit GROUP BY ALL""",
    "candidate": """SELECT course_a, area, course_b, same_area, score, n_pairs, EXISTS (SELECT 1 FROM declared d
        WHERE d.course_id = course_b AND d.prereq_id = course_a) AS contradiction FROM cellpair WHERE score >= 0.55e0""",
    "block": """SELECT a.digit AS digit_a, b.digit AS digit_b, a.area, TRUE AS same_area,
        0.45e0 * greatest(0e0, least(1e0, (a.digit - 1) / 5e0 - (b.digit - 1) / 5e0)) + 0.40e0 * 0e0
        + 0.15e0 * 1e0 AS score, CAST(sum(CASE WHEN p.course_a IS NULL THEN a.n * b.n ELSE 0 END) AS BIGINT) AS n_pairs,
        CAST(0 AS BIGINT) AS n_contradicted
        FROM cell a JOIN cell b ON a.area = b.area AND a.digit = 6 AND b.digit = 1
        LEFT JOIN prior p ON p.course_a = a.course_id AND p.course_b = b.course_id
        GROUP BY a.digit, b.digit, a.area""",
    "simpair": """SELECT a.ku_id, least(a.confidence, b.confidence) AS confidence,
        a.confidence < 0.5 AND b.confidence < 0.5 AS low
        FROM (SELECT *, row_number() OVER () AS rn FROM aligned) a JOIN
        (SELECT *, row_number() OVER () AS rn FROM aligned) b
        ON a.ku_id = b.ku_id AND (a.confidence < b.confidence OR (a.confidence = b.confidence AND a.rn < b.rn))
        AND a.course_id <> b.course_id""",
    "ka": """SELECT area, sum(n) AS concepts, 0 AS deps, 0e0 AS conf, 0 AS sims FROM cell GROUP BY 1
        UNION ALL SELECT area, 0, sum(n_pairs), sum(score * n_pairs), 0 FROM candidate GROUP BY 1
        UNION ALL SELECT area, 0, sum(n_pairs), sum(score * n_pairs), 0 FROM block GROUP BY 1
        UNION ALL SELECT knowledge_area, 0, 0, 0e0, count(*) FROM simpair JOIN ku_region USING (ku_id) GROUP BY 1""",
    "weighted": """SELECT score AS c, n_pairs AS n FROM candidate UNION ALL SELECT score, n_pairs FROM block
        UNION ALL SELECT confidence, count(*) FROM simpair GROUP BY 1""",
    "placed": """SELECT c, sum(n) AS n, sum(sum(n)) OVER (ORDER BY c) AS upto, sum(sum(n)) OVER () AS total
        FROM weighted GROUP BY c""",
    "flatedge": """SELECT a.course_id AS src, f.course_id AS dst, max(a.l_quantity) / 64.0 AS score FROM rline a JOIN rline f
        ON a.l_orderkey = f.l_orderkey AND a.lvl = f.lvl AND a.l_linenumber > f.l_linenumber
        AND a.course_id <> f.course_id GROUP BY 1, 2""",
    "flatwalk": """SELECT src, dst FROM flatedge UNION SELECT w.src, e.dst FROM flatwalk w JOIN flatedge e ON w.dst = e.src""",
    "oncycle": "SELECT src AS node FROM flatwalk WHERE src = dst",
    "flatrank": """SELECT src, dst, score, row_number() OVER (ORDER BY score, src, dst) AS r FROM flatedge
        WHERE src IN (SELECT node FROM oncycle) AND dst IN (SELECT node FROM oncycle)""",
    "higher": """SELECT r AS low, dst AS node FROM flatrank
        UNION SELECT h.low, e.dst FROM higher h JOIN flatrank e ON e.src = h.node AND e.r > h.low""",
}
VIEWS["looped"] = """SELECT course_id, prereq_id FROM declared UNION SELECT src, dst FROM flatedge
    UNION SELECT prereq_id, course_id FROM declared WHERE (course_id + prereq_id) % 11 = 0"""
for _view in ("walk", "closure", "prior", "cellpair", "candidate", "block"):
    VIEWS[f"l{_view}"] = _over_looped(_view)
VIEWS |= {
    "loopedge": """SELECT '{"course":' || course_a || ',"area":"' || c.area || '"}' AS src,
        '{"course":' || course_b || ',"area":"' || b.area || '"}' AS dst, score, a.digit AS level_a, b.digit AS level_b,
        a.n * b.n AS n_pairs FROM lcandidate c JOIN cell a ON a.course_id = c.course_a AND a.area = c.area
        JOIN cell b ON b.course_id = c.course_b AND (b.area = c.area) = c.same_area WHERE NOT contradiction""",
    "earlier": """SELECT DISTINCT '{"course":' || dst || ',"area":""}' AS src, '{"course":' || src || ',"area":""}' AS dst
        FROM flatedge WHERE (src + dst) % 3 = 0""",
    "newpool": "SELECT src, dst, score FROM loopedge WHERE level_a = level_b",
    "oldpool": """SELECT src, dst, max(score) AS score FROM (SELECT * FROM newpool
        UNION ALL SELECT src, dst, 0e0 FROM earlier) GROUP BY 1, 2""",
}
for _pool in ("new", "old"):
    VIEWS |= {
        # edges out of which nothing leads on, or into which nothing leads, close no cycle
        f"{_pool}core": f"""SELECT * FROM {_pool}pool WHERE src IN (SELECT dst FROM {_pool}pool) AND dst IN (SELECT src FROM {_pool}pool)""",
        f"{_pool}rank": f"SELECT *, row_number() OVER (ORDER BY score, src, dst) AS r FROM {_pool}core",
        f"{_pool}higher": f"""SELECT r AS low, dst AS node FROM {_pool}rank
            UNION SELECT h.low, e.dst FROM {_pool}higher h JOIN {_pool}rank e ON e.src = h.node AND e.r > h.low""",
        f"{_pool}drop": f"""SELECT src, dst FROM {_pool}rank e
            WHERE EXISTS (SELECT 1 FROM {_pool}higher h WHERE h.low = e.r AND h.node = e.src)""",
    }
V = lambda body: with_views(body, VIEWS)

QUERIES = {
    "concept_nodes": (concept_nodes, V("""SELECT c.concept_id, c.source_course_id AS course_id, course.course_number,
        coalesce(k.knowledge_area, '') AS knowledge_area FROM concept c
        JOIN course ON course.course_id = c.source_course_id
        LEFT JOIN ku_region k ON k.ku_id = c.knowledge_unit_id""")),
    "concepts_by_unit": (concepts_by_unit, V("""SELECT a.ku_id, a.concept_id, a.course_id, course.course_number,
        ku.knowledge_area, a.confidence FROM aligned a JOIN course ON course.course_id = a.course_id
        JOIN ku ON ku.ku_id = a.ku_id""")),
    "declared_pairs": (declared_pairs, V("SELECT course_id, prereq_id FROM declared")),
    "prereq_prior": (prereq_prior, V("SELECT * FROM prior")),
    "course_level_signal": (course_level_signal, V("""SELECT d.course_id, d.prereq_id,
        greatest(0e0, least(1e0, (a.lvl - 1) / 5e0 - (b.lvl - 1) / 5e0)) AS level_signal FROM declared d
        JOIN course a ON a.course_id = d.course_id JOIN course b ON b.course_id = d.prereq_id""")),
    "dependency_candidates": (dependency_candidates, V("SELECT * REPLACE (CAST(n_pairs AS DOUBLE) AS n_pairs) FROM candidate")),
    "dependency_blocks": (dependency_blocks, V("""SELECT * REPLACE (CAST(n_pairs AS DOUBLE) AS n_pairs,
        CAST(n_contradicted AS DOUBLE) AS n_contradicted) FROM block""")),
    "ordering_contradictions": (ordering_contradictions, V("""SELECT e.to_course AS course_a, e.from_course AS course_b,
        count(*) AS n_edges FROM dependency e JOIN declared d ON d.course_id = e.from_course
        AND d.prereq_id = e.to_course GROUP BY 1, 2""")),
    "similarity_counts": (similarity_counts, V("""SELECT ku_id, CAST(coalesce(sum(e), 0) AS DOUBLE) AS n_edges,
        CAST(coalesce(sum(l), 0) AS DOUBLE) AS n_low_confidence FROM
        (SELECT ku_id, count(*) AS e, count(*) FILTER (WHERE low) AS l FROM simpair GROUP BY 1
        UNION ALL SELECT DISTINCT ku_id, 0, 0 FROM aligned) GROUP BY ku_id""")),
    "similarity_profile": (similarity_profile, V("""SELECT ku_id, confidence, CAST(count(*) AS DOUBLE) AS n_edges FROM simpair
        GROUP BY 1, 2""")),
    "area_coverage": (area_coverage, V("""SELECT area AS knowledge_area, CAST(sum(concepts) AS DOUBLE) AS concept_count,
        CAST(sum(deps) AS DOUBLE) AS dependency_edge_count, CAST(sum(sims) AS DOUBLE) AS similarity_edge_count,
        round(CASE WHEN sum(deps) > 0 THEN sum(conf) / sum(deps) ELSE 0 END, 6) AS mean_confidence
        FROM ka WHERE area <> '' GROUP BY 1""")),
    "inference_summary": (inference_summary, V("""SELECT d.n AS dependency_edges, s.n AS similarity_edges,
        s.low AS low_confidence_similarity, 0e0 AS edges_rejected_cycle,
        0e0 AS edges_rejected_ordering, round(p.mean, 6) AS confidence_mean,
        round((p.lo + p.hi) / 2, 6) AS confidence_median, round(p.p10, 6) AS confidence_p10,
        round(p.p90, 6) AS confidence_p90, d.n AS total_candidates, 0e0 AS rejection_rate_pct, FALSE AS alarm
        FROM (SELECT CAST(sum(n_pairs) AS DOUBLE) AS n FROM (SELECT n_pairs FROM candidate UNION ALL
        SELECT n_pairs FROM block)) d,
        (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE low) AS DOUBLE) AS low FROM simpair) s,
        (SELECT sum(c * n) / sum(n) AS mean, min(c) FILTER (WHERE upto > (total - 1) // 2) AS lo,
        min(c) FILTER (WHERE upto > total // 2) AS hi,
        min(c) FILTER (WHERE upto > greatest(0, CAST(floor(total * 0.10) AS BIGINT) - 1)) AS p10,
        min(c) FILTER (WHERE upto > least(total - 1, CAST(floor(total * 0.90) AS BIGINT))) AS p90 FROM placed) p""")),
    "confidence_bands": (confidence_bands, V("""SELECT CASE WHEN confidence >= 0.7 THEN 'high'
        WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n_edges FROM dependency GROUP BY 1""")),
    "confidence_stats": (confidence_stats, V("""SELECT avg(confidence) AS confidence_mean, median(confidence) AS confidence_median,
        list_sort(list(confidence))[greatest(0, CAST(floor(count(*) * 0.10) AS BIGINT) - 1) + 1] AS confidence_p10,
        list_sort(list(confidence))[least(count(*) - 1, CAST(floor(count(*) * 0.90) AS BIGINT)) + 1] AS confidence_p90,
        count(*) AS n FROM aligned""")),
    "cycle_core": (cycle_core, V("""SELECT DISTINCT src, dst FROM flatedge
        WHERE src IN (SELECT w.dst FROM flatwalk w JOIN oncycle o ON o.node = w.src)
        AND dst IN (SELECT w.src FROM flatwalk w JOIN oncycle o ON o.node = w.dst)""")),
    "strong_components": (strong_components, V("""SELECT a.src AS node, min(a.dst) AS component FROM flatwalk a
        JOIN flatwalk b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""")),
    "break_cycles": (break_cycles, V("""SELECT src, dst, score FROM flatrank e
        WHERE EXISTS (SELECT 1 FROM higher h WHERE h.low = e.r AND h.node = e.src)""")),
    "inferred_graph": (inferred_graph, V("""SELECT src AS from_id, dst AS to_id, least(1e0, score) AS confidence, TRUE AS active
        FROM newpool e WHERE NOT EXISTS (SELECT 1 FROM olddrop d WHERE d.src = e.src AND d.dst = e.dst)
        UNION ALL SELECT src, dst, 0e0, NOT EXISTS (SELECT 1 FROM olddrop d WHERE d.src = o.src AND d.dst = o.dst) FROM earlier o
        WHERE NOT EXISTS (SELECT 1 FROM newpool e WHERE e.src = o.src AND e.dst = o.dst)
        OR EXISTS (SELECT 1 FROM olddrop d WHERE d.src = o.src AND d.dst = o.dst)""")),
    "rejection_summary": (rejection_summary, V("""SELECT (k + b - c) AS dependency_edges, c AS edges_rejected_cycle,
        o AS edges_rejected_ordering, k + b + o AS total_candidates, round((c + o) / (k + b + o) * 100, 6) AS rejection_rate_pct,
        (c + o) / (k + b + o) * 100 > 20 AS alarm FROM
        (SELECT coalesce(sum(n_pairs) FILTER (WHERE NOT contradiction), 0)::DOUBLE AS k,
            coalesce(sum(n_pairs) FILTER (WHERE contradiction), 0)::DOUBLE AS o FROM lcandidate),
        (SELECT coalesce(sum(n_pairs), 0)::DOUBLE AS b FROM lblock),
        (SELECT coalesce(sum(n_pairs), 0)::DOUBLE AS c FROM loopedge JOIN newdrop USING (src, dst))""")),
    "looped_coverage": (looped_coverage, V("""SELECT area AS knowledge_area, sum(concepts)::DOUBLE AS concept_count,
        sum(deps)::DOUBLE AS dependency_edge_count, round(CASE WHEN sum(deps) > 0 THEN sum(conf) / sum(deps) ELSE 0 END, 6) AS mean_confidence
        FROM (SELECT area, sum(n) AS concepts, 0 AS deps, 0e0 AS conf FROM cell GROUP BY 1
        UNION ALL SELECT area, 0, n_pairs, least(1e0, score) * n_pairs FROM lcandidate WHERE NOT contradiction
        UNION ALL SELECT area, 0, n_pairs, least(1e0, score) * n_pairs FROM lblock
        UNION ALL SELECT src::JSON ->> 'area', 0, -n_pairs, -least(1e0, score) * n_pairs FROM loopedge JOIN newdrop USING (src, dst))
        WHERE area <> '' GROUP BY 1""")),
}
