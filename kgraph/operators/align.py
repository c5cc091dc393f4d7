"""Aligning concepts to the vocabulary: retrieve, rerank, reject, verify.

Scores of outside models enter as tables: vectors for labels, judgements for
alignments. Every concept leaves with a row, aligned or not.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.functions import scores as S
from kgraph.sources.staging import stage

# Bytes of vectors that one task holds of the vocabulary and of the queries, and bytes of the similarities
# that it computes at a time.
BLOCK_BYTES = 32 * 2**20
STRIP_BYTES = 32 * 2**20


# --- retrieve ---------------------------------------------------------------

def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(ids: np.ndarray, matrix: np.ndarray, unit_ids: np.ndarray, unit_matrix: np.ndarray, k: int) -> pd.DataFrame:
    """The k most similar units of each row; ties go to the smaller id.

    `unit_ids` is sorted, so the smaller column settles ties. Only what reaches a row's k-th best value is sorted.
    """
    keep = min(k, len(unit_ids))
    similarity = matrix @ unit_matrix.T
    least = np.partition(similarity, len(unit_ids) - keep, axis=1)[:, [len(unit_ids) - keep]]
    row, column = np.nonzero(similarity >= least)
    value = similarity[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best = place < keep
    return pd.DataFrame({"id": ids[row[best]], "ku_id": unit_ids[column[best]], "similarity": value[best]})


def _parts(vectors: DataFrame, block_bytes: int) -> int:
    """How many parts of about `block_bytes` the vectors make, from their counted components."""
    size = vectors.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    return max(1, math.ceil(size / block_bytes))


def topk_cosine(queries: DataFrame, vocabulary: DataFrame, k: int = K.RETRIEVE_TOP_K,
                block_bytes: int = BLOCK_BYTES, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """(id, ku_id, similarity, rank): exact k nearest units by cosine.

    `queries` is (id, vector), `vocabulary` (ku_id, vector). Both are cut into parts of about `block_bytes`. Each pair
    of a vocabulary block and a query chunk is multiplied in its own task, strip by strip, so a task's memory does not
    grow with either side; the best of all blocks are merged per query. The vocabulary never passes through the driver.
    Vectors of length zero have similarity 0 to all; null vectors take no part.
    """
    id_type = queries.schema["id"].dataType.simpleString()
    ku_type = vocabulary.schema["ku_id"].dataType.simpleString()
    schema = f"id {id_type}, ku_id {ku_type}, similarity double"
    queries = queries.select("id", "vector").filter(F.col("vector").isNotNull())
    vocabulary = stage(vocabulary.select("ku_id", "vector").filter(F.col("vector").isNotNull()), "vocabulary")
    blocks, chunks = _parts(vocabulary, block_bytes), _parts(queries, block_bytes)

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")
        return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def search(query_part: pd.DataFrame, unit_part: pd.DataFrame) -> pd.DataFrame:
        if query_part.empty or unit_part.empty:
            none = np.array([], dtype=object)
            return pd.DataFrame({"id": none, "ku_id": none, "similarity": none}, dtype=object)
        unit_part = unit_part.sort_values("ku_id")
        unit_ids, unit_matrix = unit_part["ku_id"].to_numpy(), _unit_rows(unit_part["vector"])
        ids, strip = query_part["id"].to_numpy(), max(1, strip_bytes // (8 * len(unit_ids)))
        return pd.concat([
            _best(ids[at:at + strip], _unit_rows(query_part["vector"].iloc[at:at + strip]), unit_ids, unit_matrix, k)
            for at in range(0, len(ids), strip)
        ], ignore_index=True)

    left = dealt(queries, "id", "chunk", chunks, "block", blocks)
    right = dealt(vocabulary, "ku_id", "block", blocks, "chunk", chunks)
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(search, schema)
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "ku_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def labels_to_embed(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Distinct bare labels that have no vector yet."""
    return labels.select("label").distinct().join(embeddings.select("label").distinct(), "label", "left_anti")


# --- rerank -----------------------------------------------------------------

def rerank(candidates: DataFrame, concepts: DataFrame, units: DataFrame,
           predicted: DataFrame | None = None) -> DataFrame:
    """Score and rank the candidates (concept_id, ku_id, similarity).

    `concepts` is (concept_id, course_id, course_number). `predicted`, from
    `predict_areas`, adds the co-occurrence term; without it the term is 0.
    """
    facts = units.select("ku_id", "knowledge_area", "tier", F.lit(True).alias("known"))
    rows = candidates.join(concepts, "concept_id").join(facts, "ku_id", "left")
    level = S.normalised_level(S.level_digit("course_number"))
    if predicted is None:
        rows = rows.withColumn("cooccurrence", F.lit(0.0))
    else:
        rows = _with_cooccurrence(rows, predicted)
    proximity = F.when(F.col("known"), F.lit(1.0) - F.abs(level - S.ku_depth("tier"))).otherwise(F.lit(0.0))
    scored = rows.withColumn("course_level", level).withColumn(
        "score", S.rerank_score("similarity", "cooccurrence", proximity)
    )
    order = W.partitionBy("concept_id").orderBy(F.desc("score"), F.desc("similarity"), "ku_id")
    return scored.withColumn("rank", F.row_number().over(order)).select(
        "concept_id", "course_id", "course_level", "ku_id", "knowledge_area", "similarity", "cooccurrence",
        "score", "rank",
    )


def predict_areas(candidates: DataFrame, concepts: DataFrame, units: DataFrame) -> DataFrame:
    """(concept_id, course_id, area): area of the best candidate, null if none."""
    best = rerank(candidates, concepts, units).filter("rank = 1").select(
        "concept_id", F.col("knowledge_area").alias("area")
    )
    return concepts.select("concept_id", "course_id").join(best, "concept_id", "left")


def _with_cooccurrence(rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of the course's other concepts predicted to lie in the candidate's
    area. Counts per (course, area) are made first and the concept's own
    prediction is taken off, so a large course is never gathered."""
    known = predicted.filter(F.col("area").isNotNull())
    per_area = known.groupBy("course_id", F.col("area").alias("knowledge_area")).agg(F.count(F.lit(1)).alias("n_area"))
    per_course = known.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_course"))
    own = known.select("concept_id", F.col("area").alias("own_area"))
    others = F.coalesce("n_course", F.lit(0)) - F.col("own_area").isNotNull().cast("int")
    same = F.coalesce("n_area", F.lit(0)) - F.coalesce(F.col("own_area") == F.col("knowledge_area"), F.lit(False)).cast("int")
    return (
        rows.join(per_area, ["course_id", "knowledge_area"], "left")
        .join(per_course, "course_id", "left")
        .join(own, "concept_id", "left")
        .withColumn("cooccurrence", F.when(F.col("known"), S.ratio(same, others)).otherwise(F.lit(0.0)))
    )


# --- reject and verify ------------------------------------------------------

def verify(surviving: DataFrame, concepts: DataFrame, min_confidence: float = K.MIN_CONFIDENCE,
           temperature: float = K.CONFIDENCE_TEMPERATURE) -> DataFrame:
    """(concept_id, ku_id, confidence, status) from the two best survivors."""
    best = surviving.groupBy("concept_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "ku_id", "score"))), 1, 2).alias("best")
    )
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    confidence = S.margin_confidence(first["score"], second["score"], temperature)
    status = (
        F.when(first.isNull(), "unaligned")
        .when(F.col("confidence") < min_confidence, "low_confidence_unaligned").otherwise("aligned")
    )
    return (
        concepts.select("concept_id").join(best, "concept_id", "left")
        .withColumn("confidence", confidence)
        .withColumn("status", status)
        .select("concept_id", F.when(F.col("status") == "aligned", first["ku_id"]).alias("ku_id"), "confidence", "status")
    )


def apply_judgements(verified: DataFrame, judgements: DataFrame | None) -> DataFrame:
    """Second opinion on aligned winners. A missing answer counts as accepted; a
    refused winner keeps its confidence and loses its unit."""
    if judgements is None:
        return verified
    asked = judgements.groupBy("concept_id", "ku_id").agg(F.bool_and("belongs").alias("belongs"))
    refused = ~F.coalesce("belongs", F.lit(True))
    return verified.join(asked, ["concept_id", "ku_id"], "left").select(
        "concept_id",
        F.when(~refused, F.col("ku_id")).alias("ku_id"),
        "confidence",
        F.when(refused, "low_confidence_unaligned").otherwise(F.col("status")).alias("status"),
    )


def align(ranked: DataFrame, concepts: DataFrame, judgements: DataFrame | None = None,
          min_confidence: float = K.MIN_CONFIDENCE, temperature: float = K.CONFIDENCE_TEMPERATURE) -> DataFrame:
    """Final alignment (concept_id, ku_id, confidence, status, n_rejected).

    A candidate is rejected by what earlier concepts, in (course_id, concept_id)
    order, were aligned to: its unit was aligned earlier, and only at levels far
    above this one. A level of 0.5 or more can never be rejected, so those
    concepts are settled at once, and of them only the first concept per unit and
    level matters to the others (`_risky`). The others all lie near each other:
    once one of them is aligned to a unit, nothing later is rejected for it. So
    all that has to be found is one place per unit (`_first_low`).
    """
    rows = ranked.withColumn("seq", F.struct("course_id", "concept_id"))
    if judgements is not None:
        asked = judgements.groupBy("concept_id", "ku_id").agg(F.bool_and("belongs").alias("belongs"))
        rows = rows.join(asked, ["concept_id", "ku_id"], "left")
    else:
        rows = rows.withColumn("belongs", F.lit(None).cast("boolean"))
    rows = stage(rows.withColumn("belongs", F.coalesce("belongs", F.lit(True))), "ranked")
    everyone = stage(concepts.select("concept_id", "course_id"), "concepts")
    sure = rows.filter(F.col("course_level") >= K.ORDERING_SLACK)
    low = rows.filter(F.col("course_level") < K.ORDERING_SLACK)
    settled = apply_judgements(
        verify(sure, sure.select("concept_id").distinct(), min_confidence, temperature),
        rows.select("concept_id", "ku_id", "belongs"),
    )
    low = stage(_risky(low, _first_seen(settled, rows)), "low")
    first_low = _first_low(low, min_confidence, temperature)
    rejected = stage(
        low.filter("risky").join(first_low, "ku_id", "left")
        .filter(F.col("first_low").isNull() | (F.col("first_low") >= F.col("seq"))).select("concept_id", "ku_id"),
        "rejected",
    )
    surviving = rows.join(rejected, ["concept_id", "ku_id"], "left_anti")
    outcome = apply_judgements(
        verify(surviving, everyone, min_confidence, temperature), rows.select("concept_id", "ku_id", "belongs")
    )
    counts = rejected.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_rejected"))
    return outcome.join(counts, "concept_id", "left").na.fill(0, ["n_rejected"])


def _first_seen(outcome: DataFrame, rows: DataFrame) -> DataFrame:
    """(ku_id, level, first_seq): the first concept aligned per unit and level."""
    return (
        outcome.filter("status = 'aligned'").join(rows.select("concept_id", "ku_id", "course_level", "seq"), ["concept_id", "ku_id"])
        .groupBy("ku_id", F.col("course_level").alias("level")).agg(F.min("seq").alias("first_seq"))
    )


def _risky(low: DataFrame, firsts: DataFrame) -> DataFrame:
    """`low` with `risky`: high concepts alone would have the candidate rejected. A unit has one entry per level."""
    seen = firsts.groupBy("ku_id").agg(F.collect_list(F.struct("level", "first_seq")).alias("seen"))
    earlier = lambda s: s["first_seq"] < F.col("seq")
    near = lambda s: s["level"] <= F.col("course_level") + K.ORDERING_SLACK
    violates = F.exists("seen", earlier) & ~F.exists("seen", lambda s: earlier(s) & near(s))
    return low.join(seen, "ku_id", "left").withColumn("risky", F.coalesce(violates, F.lit(False))).drop("seen")


def _first_low(low: DataFrame, min_confidence: float, temperature: float) -> DataFrame:
    """(ku_id, first_low): the first low concept aligned to each unit.

    The first one cannot win by a risky candidate, which needs an earlier one. Each
    round keeps two bounds per unit: `upper`, the first settled concept that won it,
    and `lower`, the first that won or still may. A risky candidate after `upper`
    stays, one not after `lower` goes. A concept is settled once its two best
    survivors are known, and only unsettled ones enter the next round. The earliest
    of them is always settled, so the rounds end; in practice they are few, and the
    table that is joined has one row per unit.
    """
    spread = low.select("concept_id", "seq", F.struct("rank", "ku_id", "score", "belongs", "risky").alias("c"))
    waiting = spread.groupBy("concept_id", "seq").agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    bounds = None
    while True:
        rows = waiting.select("concept_id", "seq", F.explode("candidates").alias("c"))
        if bounds is None:
            fate = F.when(F.col("c.risky"), "open").otherwise("kept")
        else:
            rows = rows.join(bounds.withColumnRenamed("ku_id", "unit"), F.col("c.ku_id") == F.col("unit"), "left")
            fate = (
                F.when(~F.col("c.risky") | F.coalesce(F.col("upper") < F.col("seq"), F.lit(False)), "kept")
                .when(F.col("lower") < F.col("seq"), "open").otherwise("gone")
            )
        judged = rows.groupBy("concept_id", "seq").agg(
            F.array_sort(F.collect_list(F.struct("c.rank", "c", fate.alias("fate")))).alias("all")
        ).withColumn("left", F.filter("all", lambda x: x["fate"] != "gone"))
        first, second = F.get("left", F.lit(0)), F.get("left", F.lit(1))
        known = ~F.exists(F.slice("left", 1, 2), lambda x: x["fate"] == "open")
        confidence = S.margin_confidence(first["c"]["score"], second["c"]["score"], temperature)
        won = first.isNotNull() & (confidence >= min_confidence)
        # What may still win ends with the first candidate that is sure to stay.
        ahead = F.filter("left", lambda x: ~F.exists(
            "left", lambda y: (y["fate"] == "kept") & (y["rank"] < x["rank"])))
        winners = F.when(known, F.when(won, F.slice("left", 1, 1)).otherwise(F.slice("left", 1, 0))).otherwise(ahead)
        round_ = stage(judged.select(
            "concept_id", "seq", known.alias("known"), F.transform("all", lambda x: x["c"]).alias("candidates"),
            F.transform(F.filter(winners, lambda x: x["c"]["belongs"] & ~x["c"]["risky"]),
                        lambda x: x["c"]["ku_id"]).alias("units"),
        ), "round")
        seen = round_.select(
            F.explode("units").alias("ku_id"), F.when(F.col("known"), F.col("seq")).alias("upper"),
            F.col("seq").alias("lower"))
        if bounds is not None:
            won_before = bounds.filter(F.col("upper").isNotNull())
            seen = seen.unionByName(won_before.select("ku_id", "upper", F.col("upper").alias("lower")))
        bounds = stage(seen.groupBy("ku_id").agg(F.min("upper").alias("upper"), F.min("lower").alias("lower")), "bounds")
        waiting = round_.filter(~F.col("known"))
        if waiting.isEmpty():
            return bounds.select("ku_id", F.col("upper").alias("first_low"))


def concept_records(aligned: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concept rows: confidence is at least 0.01 so an unaligned record is valid."""
    return concepts.join(aligned, "concept_id").select(
        *concepts.columns, F.col("ku_id").alias("knowledge_unit_id"), F.col("status").alias("alignment_status"),
        F.greatest("confidence", F.lit(K.UNALIGNED_CONFIDENCE_FLOOR)).alias("confidence"),
    )


def first_per_label(raw: DataFrame) -> DataFrame:
    """One raw concept per (course_id, label): the one with the lowest `pos`."""
    rest = [c for c in raw.columns if c not in ("course_id", "label", "pos")]
    return raw.groupBy("course_id", "label").agg(F.min(F.struct("pos", *rest)).alias("first")).select(
        "course_id", "label", "first.*"
    )


# --- coverage and summary ---------------------------------------------------

def coverage_pairs(aligned: DataFrame) -> DataFrame:
    """Which courses cover which unit, one row per pair."""
    return aligned.select("ku_id", "course_id").distinct()


def coverage_counts(aligned: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Distinct courses per unit; units without any count 0 when given."""
    counts = coverage_pairs(aligned).groupBy("ku_id").agg(F.count(F.lit(1)).alias("n_courses"))
    if units is None:
        return counts
    return units.select("ku_id").join(counts, "ku_id", "left").na.fill(0, ["n_courses"])


def thin_units(counts: DataFrame, min_courses: int = K.MIN_COVERAGE_COURSES) -> DataFrame:
    return counts.filter(F.col("n_courses") < min_courses)


def extraction_summary(courses: DataFrame, concepts: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """One row: courses read and skipped, concepts by outcome.

    `extracted` holds all labels that were read, repeats and known ones included;
    without it the kept concepts are all there were.
    """
    short = F.length(F.trim(F.coalesce("description", F.lit("")))) < K.MIN_DESCRIPTION_LENGTH
    read = courses.agg(
        F.count(F.lit(1)).alias("courses_processed"), F.count_if(short).alias("concepts_skipped_empty")
    )
    status = F.col("alignment_status")
    outcome = concepts.agg(
        F.count(F.lit(1)).alias("concepts_extracted"),
        F.count_if(status == "aligned").alias("concepts_aligned"),
        F.count_if(status == "low_confidence_unaligned").alias("concepts_low_confidence"),
        F.count_if(status == "unaligned").alias("concepts_unaligned"),
    )
    if extracted is not None:
        named = outcome.columns
        total = extracted.agg(F.count(F.lit(1)).alias("concepts_extracted"))
        outcome = outcome.drop("concepts_extracted").withColumn("one", F.lit(1)).join(
            total.withColumn("one", F.lit(1)), "one").select(*named)
    return read.withColumn("one", F.lit(1)).join(outcome.withColumn("one", F.lit(1)), "one").drop("one")


# --- query resolution -------------------------------------------------------

def resolve(queries: DataFrame, vocabulary: DataFrame, k: int = K.RESOLVE_TOP_K,
            min_score: float = K.RESOLVE_MIN_SCORE) -> DataFrame:
    """(query_id, ku_id, similarity, pos): units of each interest above the floor."""
    found = topk_cosine(queries.select(F.col("query_id").alias("id"), "vector"), vocabulary, k)
    return found.filter(F.col("similarity") >= min_score).select(
        F.col("id").alias("query_id"), "ku_id", "similarity", F.col("rank").alias("pos")
    )


def select_units(resolved: DataFrame, selections: DataFrame, embed_model: str, select_model: str) -> DataFrame:
    """Keep each query's selected units in the caller's order.

    `selections` is (query_id, ku_id, pos). Unknown ids are dropped, repeats keep
    their first place. A query left with none keeps all its candidates and its
    model id says so.
    """
    picked = (
        selections.groupBy("query_id", "ku_id").agg(F.min("pos").alias("chosen"))
        .join(resolved.select("query_id", "ku_id"), ["query_id", "ku_id"], "left_semi")
    )
    answered = picked.select("query_id").distinct().withColumn("answered", F.lit(True))
    order = W.partitionBy("query_id").orderBy("place")
    return (
        resolved.join(picked, ["query_id", "ku_id"], "left")
        .join(answered, "query_id", "left")
        .filter(F.col("answered").isNull() | F.col("chosen").isNotNull())
        .withColumn("place", F.when(F.col("answered"), F.col("chosen")).otherwise(F.col("pos")))
        .select(
            "query_id", "ku_id", F.row_number().over(order).alias("pos"),
            F.when(F.col("answered"), f"{embed_model}+{select_model}").otherwise(f"{embed_model}+fallback").alias("model_id"),
        )
    )
