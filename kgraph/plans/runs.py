"""End-to-end runs: ingest, extract, infer and evaluate.

A run builds its plans, writes one table per result under an output folder and
returns the written tables. With `out=None` nothing is stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.operators import align as L
from kgraph.operators import catalogue as B
from kgraph.operators import cycles as Y
from kgraph.operators import evaluate as E
from kgraph.operators import infer as I
from kgraph.operators import validate as V
from kgraph.operators.ranking import confidence_stats
from kgraph.sources import tables as A
from kgraph.sources.staging import stage


def _stored(results: dict[str, DataFrame], out: str | None) -> dict[str, DataFrame]:
    """Write each result under `out`, which must be new, and read it back."""
    if out is None:
        return results
    written = {}
    for name, table in results.items():
        path = f"{out}/{name}"
        table.write.mode("errorifexists").parquet(path)
        written[name] = table.sparkSession.read.schema(table.schema).parquet(path)
    return written


# --- ingest -----------------------------------------------------------------

def ingest_course_pages(pages: DataFrame, programmes: DataFrame | None = None, second: DataFrame | None = None,
                        adapter: str = "acalog", version: str = "1.0.0", out: str | None = None) -> dict[str, DataFrame]:
    """Landed course pages (url, html, retrieved_at, source_revision, skip_reason?)
    to courses, edges, programmes, outcomes and a summary."""
    skip = F.col("skip_reason") if "skip_reason" in pages.columns else F.lit(None).cast("string")
    landed = pages.withColumn("skip_reason", skip)
    raw = B.course_pages(landed.filter("skip_reason is null"))
    if second is not None:
        raw = B.cross_check(raw, second)
    typed = stage(V.with_failures(B.normalise_courses(raw, adapter, version), V.course_rules()), "courses")
    courses = typed.filter(F.size("failures") == 0).drop("failures")
    read = typed.select(
        F.col("provenance.source_url").alias("url"), F.array_join("failures", "; ").alias("broken"),
        F.col("prerequisite_rule.machine_checkable").alias("machine_checkable"), F.lit(True).alias("parsed"),
    )
    outcomes = landed.join(read, "url", "left").select(
        "url",
        F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("parsed").isNull(), "failed")
        .when(F.col("broken") != "", "failed").otherwise("succeeded").alias("status"),
        F.coalesce(
            "skip_reason", F.when(F.col("parsed").isNull(), "parse_failed"), F.when(F.col("broken") != "", F.col("broken"))
        ).alias("reason"),
        "machine_checkable",
    )
    results = {"courses": courses, "edges": B.declared_edges(courses), "outcomes": outcomes,
               "summary": B.ingest_summary(outcomes)}
    if second is not None:
        results["summary"] = _beside(results["summary"], raw.agg(F.count_if("mismatch").alias("odata_discrepancies")))
    if programmes is not None:
        found = B.programme_pages(programmes.select("url", "html"))
        facts = programmes.select("url", "retrieved_at", "source_revision")
        results["programmes"] = B.normalise_programmes(found.join(facts, "url"), adapter, version)
        results["summary"] = _beside(
            results["summary"], results["programmes"].agg(F.count(F.lit(1)).alias("programmes_ingested"))
        )
    return _stored(results, out)


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates as one row."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def ingest_block_pages(*subjects: DataFrame, retrieved_at: Column | None = None, adapter: str = "uiuc_static",
                       version: str = "1.0.0", out: str | None = None) -> dict[str, DataFrame]:
    """Subject pages of course blocks to courses, edges and a summary."""
    when = retrieved_at if retrieved_at is not None else F.current_timestamp()
    courses = stage(B.block_courses(B.course_blocks(B.union_pages(*subjects)), when, adapter, version), "courses")
    return _stored({"courses": courses, "edges": B.reference_edges(courses), "summary": _reference_summary(courses)}, out)


def ingest_spine(payloads: DataFrame, syllabi: DataFrame, base_url: str, subject: str = "CS",
                 version: str = "1.0.0", limit: int | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """An authoritative course list enriched by syllabus pages."""
    listing = A.odata_courses(payloads, subject)
    merged = B.merge_spine(B.first_by_number(listing, limit), B.syllabus_pages(syllabi), base_url, subject)
    courses = stage(
        merged.withColumn("authority", F.lit("derived")).withColumn(
            "provenance", B.provenance(F.col("source_url"), F.current_timestamp(), "purdue_odata_canonical", version)
        ).drop("source_url"), "courses",
    )
    return _stored({"courses": courses, "edges": B.reference_edges(courses), "summary": _reference_summary(courses)}, out)


def _reference_summary(courses: DataFrame) -> DataFrame:
    return courses.agg(
        F.count(F.lit(1)).alias("courses_attempted"), F.count(F.lit(1)).alias("courses_succeeded"),
        F.coalesce(F.sum(F.size("prerequisite_refs")), F.lit(0)).alias("prereqs_structured"),
        F.lit(0).cast("bigint").alias("prereqs_unstructured"),
    )


# --- extract ----------------------------------------------------------------

def extract_concepts(courses: DataFrame, payloads: DataFrame, vectors: DataFrame, units: DataFrame,
                     unit_vectors: DataFrame, stored: DataFrame | None = None, judgements: DataFrame | None = None,
                     force: bool = False, out: str | None = None) -> dict[str, DataFrame]:
    """Model payloads per course to aligned concepts, coverage and a summary.

    `vectors` is (label, vector). Labels already stored for a course are skipped
    unless forced; forcing also keeps repeats of a label.
    """
    usable = B.described(courses).select("course_id", "course_number")
    labels, rejected = B.concept_labels(payloads.join(usable.select("course_id"), "course_id", "left_semi"))
    new = labels if force else L.first_per_label(labels)
    if stored is not None:
        done = stored.select(F.col("source_course_id").alias("course_id"), "label")
        new = A.skip_existing(new, done, ["course_id", "label"], force)
    named = lambda rows: rows.withColumn("concept_id", F.concat_ws("-", F.lit("concept"), "course_id", "pos")).join(usable, "course_id")
    everything, concepts = stage(named(labels), "labels"), stage(named(new), "concepts")
    found = L.topk_cosine(vectors.select(F.col("label").alias("id"), "vector"), unit_vectors)
    candidates = stage(
        everything.select("concept_id", "label").join(found.withColumnRenamed("id", "label"), "label")
        .select("concept_id", "ku_id", "similarity"), "candidates",
    )
    areas = stage(L.predict_areas(candidates, everything, units), "areas")
    ranked = L.rerank(candidates, concepts.select("concept_id", "course_id", "course_number"), units, areas)
    records = stage(
        L.concept_records(
            L.align(ranked, concepts, judgements),
            concepts.select("concept_id", "label", F.col("course_id").alias("source_course_id")),
        ), "records",
    )
    aligned = records.filter("alignment_status = 'aligned'").select(
        "concept_id", F.col("source_course_id").alias("course_id"), F.col("knowledge_unit_id").alias("ku_id"), "confidence"
    )
    counts = L.coverage_counts(aligned, units)
    results = {
        "concepts": records, "rejected_payloads": rejected, "coverage": counts, "thin_units": L.thin_units(counts),
        "summary": _beside(L.extraction_summary(courses, records, labels), confidence_stats(records).drop("n")),
    }
    return _stored(results, out)


# --- infer ------------------------------------------------------------------

def infer_graph(concepts: DataFrame, courses: DataFrame, units: DataFrame, declared: DataFrame,
                run_id: str = "run", min_score: float = K.MIN_DEPENDENCY_SCORE, out: str | None = None,
                stored: DataFrame | None = None, graph: str | None = None) -> dict[str, DataFrame]:
    """Dependency pairs and blocks, similarity profile, rejections and reports.

    `concepts` is (concept_id, source_course_id, knowledge_unit_id,
    alignment_status, confidence). Edges of earlier runs are given as concept edges `stored` (from_id, to_id), or lie
    in the edge table under `graph`, which this run then updates: what it accepts is written, what it expires is deleted,
    what it rejects is appended. A stored edge counts with score 0, so it goes first where it closes a cycle; `expired` names
    such edges, and stored edges without them and new ones have no cycle. Pairs, coverage and summary hold
    what is left once the rejected edges are out; `dropped` names these by course and area for the expansion to
    concepts. `out=None` and `graph=None` is a dry run.
    """
    spark = concepts.sparkSession
    declared = stage(I.declared_pairs(declared), "declared")
    nodes = stage(I.concept_nodes(concepts, courses, units), "nodes")
    cells = stage(I.course_cells(nodes), "cells")
    prior = I.candidate_prior(cells, declared, min_score)
    scored = stage(I.scored_courses(cells, prior, declared, min_score), "scored")
    level_pairs = stage(I.area_pairs(scored.filter("flat"), cells, min_score), "level-pairs")
    other_pairs = I.area_pairs(scored.filter("not flat"), cells, min_score)
    found = level_pairs.unionByName(other_pairs)
    blocks = stage(I.dependency_blocks(cells, prior, declared, min_score), "blocks")
    flat = stage(I.cycle_candidates(level_pairs, cells), "cycle-candidates")
    of_concepts = None if stored is None else stage(I.stored_by_cell(stored, nodes), "stored")
    in_table = A.read_edges(spark, f"{graph}/edges") if graph else None
    of_table = None if in_table is None else stage(I.stored_cells(A.stored_dependencies(in_table), cells), "stored-cells")
    old = [t.select("src", "dst") for t in (of_concepts, of_table) if t is not None]
    old = stage(reduce(DataFrame.unionByName, old).distinct(), "old-edges") if old else None
    candidates, edges, touched, free = flat.select("src", "dst", "score"), flat, level_pairs, other_pairs
    upward = old is not None and not I.upward_edges(old, cells).isEmpty()
    if upward:
        # with a way up, edges between levels can close a cycle as well
        edges, touched, free = stage(I.cell_edges(found, cells), "cell-edges"), found, other_pairs.limit(0)
        candidates = edges.select("src", "dst", "score").unionByName(I.block_paths(cells, blocks))
    _, cyclic = Y.resolve_cycles(candidates, old)
    new = cyclic.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")
    gone = stage(cyclic.select("src", "dst").join(old, ["src", "dst"], "left_semi") if old is not None else cyclic.select("src", "dst").limit(0), "gone")
    dropped = stage(I.rejected_pairs(new, cells), "dropped")
    touched_left = stage(I.without_rejected(touched, dropped), "kept-pairs")
    pairs = touched_left.unionByName(free)
    totals = I.pair_totals(touched_left)
    if not upward:
        totals = I.pair_totals(totals.unionByName(I.scored_totals(scored.filter("not flat"), cells, min_score)))
    totals = stage(totals, "totals")
    members = (
        concepts.filter((F.col("alignment_status") == "aligned") & F.col("knowledge_unit_id").isNotNull())
        .select(F.col("knowledge_unit_id").alias("ku_id"), F.col("source_course_id").alias("course_id"), "confidence")
    )
    counts = stage(I.similarity_counts(members), "similar")
    profile = stage(I.similarity_profile(members), "profile")
    by_area = counts.join(units, "ku_id").groupBy(F.col("knowledge_area").alias("area")).agg(F.sum("n_edges").alias("n_edges"))
    end = lambda course, area: F.to_json(F.struct(F.col(course).alias("course"), F.col(area).alias("area")))
    ordering = pairs.filter("contradiction").select(
        end("course_a", "area").alias("src"), F.col("course_b").cast("string").alias("dst"), "score",
        F.lit("prerequisite_ordering_contradiction").alias("reason"),
    )
    # a stored edge that is no candidate any more counts as rejected too, with all its pairs or, a concept edge, as one
    only_old = gone.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    lost = dropped.select("n_pairs")
    if of_table is not None:
        lost = lost.unionByName(I.rejected_pairs(of_table.join(only_old, ["src", "dst"], "left_semi").select("src", "dst").distinct(), cells).select("n_pairs"))
    if of_concepts is not None:
        lost = lost.unionByName(of_concepts.join(only_old, ["src", "dst"], "left_semi").select(F.lit(1).cast(I.PAIRS).alias("n_pairs")))
    expired = gone if of_concepts is None else of_concepts.join(gone, ["src", "dst"], "left_semi")
    kept_flat = flat.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
    results = {
        "dependency_pairs": pairs.filter("not contradiction").drop("contradiction"), "dependency_blocks": blocks,
        "dropped": dropped, "edges": kept_flat.unionByName(I.downward_pairs(scored, cells, min_score)), "expired": expired,
        "similarity_counts": counts, "similarity_profile": profile,
        "rejected": ordering.unionByName(cyclic).withColumn("run_id", F.lit(run_id)),
        "area_coverage": I.area_coverage(cells, totals, blocks, by_area),
        "summary": I.inference_summary(totals, blocks, profile, counts, lost),
    }
    results = _stored(results, out)
    if graph:
        kind = "concept_dependency"
        ended, written = gone, results["edges"].select("src", "dst", "score")
        if of_table is not None:
            row = ["row_src", "row_dst"]
            rows = stage(of_table.join(gone, ["src", "dst"], "left_semi").select(*row).distinct(), "ended-rows")
            ended = gone.unionByName(rows.select(F.col("row_src").alias("src"), F.col("row_dst").alias("dst"))).distinct()
            # what else a row stood for stays, cell by cell
            left = stage(of_table.filter("src <> row_src or dst <> row_dst").join(rows, row, "left_semi").join(
                gone, ["src", "dst"], "left_anti"), "left-of-rows")
            if not left.isEmpty():
                before = in_table.select(F.col("from_id").alias("row_src"), F.col("to_id").alias("row_dst"), F.col("confidence").alias("score"))
                written = written.unionByName(stage(left.join(before, row).select("src", "dst", "score"), "kept-cells"))
        named = lambda rows, score: rows.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), score.alias("confidence"))
        A.write_inferred_edges(
            A.inferred_edges(named(written, F.least(F.lit(1.0), F.col("score"))), kind, run_id),
            A.inferred_edges(named(ended, F.lit(0.0)), kind, run_id, active=False), f"{graph}/edges")
        A.append_rejected_edges(results["rejected"].drop("run_id"), run_id, f"{graph}/rejected")
    return results


# --- evaluate ---------------------------------------------------------------

def evaluate_graph(edges: DataFrame, nodes: DataFrame, declared: DataFrame, held_out: DataFrame | None = None,
                   summaries: dict[str, DataFrame | None] | None = None, ablate: bool = False,
                   out: str | None = None, scope: str | None = None, scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Split, metric by band and area, reproduction, failures, ablation, report. `scope` as in evaluate.reach_masks, a
    column of edges and, for the ablation, of nodes. `scored`: the edges as infer.score_edges gives them, where they
    can be had with less."""
    declared = stage(I.declared_pairs(declared), "declared")
    split = stage(E.held_out_split(declared), "split")
    test = split.filter("part = 'test'") if held_out is None else held_out
    of_course = None if scope else stage(nodes.select("concept_id", "course_id").distinct(), "courses")
    reach = E.reach_masks(edges, of_course, bands=E.ALL_BANDS, scope=scope)
    if scope is None:
        reach = stage(reach, "reach")
    headline = stage(E.prf(reach, test, declared, list(E.ALL_BANDS)), "headline")
    by_area = stage(E.prf_by_area(reach.filter(F.col("mask").bitwiseAND(F.lit(1)) != 0), test, declared, nodes), "by_area")
    reproduction = E.reproduction_report(E.classify_edges(edges, of_course, declared))
    given = summaries or {}
    failures = E.failure_report(given.get("ingestion"), given.get("extraction"), given.get("inference"), by_area)
    quality = ["precision", "recall", "f1"]
    report = (
        E.report_rows(headline, "headline", "band", ["tp", "fp", "fn", *quality])
        .unionByName(E.report_rows(by_area, "by_knowledge_area", "knowledge_area", [*quality, "sample_size"]))
        .unionByName(E.report_rows(reproduction, "reproduction", "edge_class", ["n_edges", "mean_confidence"]))
        .unionByName(E.report_rows(failures, "failures", "name", ["n"]))
    )
    results = {"split": split, "headline": headline, "by_area": by_area, "reproduction": reproduction, "failures": failures}
    if ablate:
        if scored is None:
            scored = I.score_edges(edges, nodes, I.prerequisite_prior(declared), scope=scope)
            scored = scored if scope else stage(scored, "scored")
        else:
            scored = stage(scored, "scored")
        modes = E.ablation_edges(scored, declared, scope=scope)
        results["ablation"] = stage(E.ablation(modes, of_course, test, declared, scope=scope), "ablation")
        report = report.unionByName(E.report_rows(results["ablation"], "ablation", "mode", ["tp", "fp", "fn", *quality]))
    results["report"] = report
    return _stored(results, out)
