"""The alignment funnel against sequential brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgraph.operators import align as L

CANDIDATE = "concept_id string, ku_id string, similarity double"
CONCEPT = "concept_id string, course_id string, course_number string"
UNIT = "ku_id string, label string, knowledge_area string, tier string"
RANKED = "concept_id string, course_id string, course_level double, ku_id string, score double, rank int"


def test_nearest_units_blocked_or_not(spark, rows):
    rng = np.random.default_rng(1)
    vectors = lambda n, tag: [(f"{tag}{i:02d}", [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    queries = spark.createDataFrame(vectors(23, "q") + [("zero", [0.0] * 8)], "id string, vector array<double>")
    units = spark.createDataFrame(vectors(17, "u"), "ku_id string, vector array<double>")
    whole = rows(L.topk_cosine(queries, units, 5), "id", "ku_id", "rank")
    assert whole == rows(L.topk_cosine(queries, units, 5, block_bytes=4 * 64, strip_bytes=100), "id", "ku_id", "rank")
    assert len(whole) == 24 * 5
    # Ties, here of the vector of length zero, go to the smaller ids.
    assert [r[1] for r in whole if r[0] == "zero"] == [f"u{i:02d}" for i in range(5)]
    plain = {}
    unit = {r["ku_id"]: np.array(r["vector"]) for r in units.collect()}
    for r in queries.filter("id <> 'zero'").collect():
        v = np.array(r["vector"])
        near = {u: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for u, w in unit.items()}
        plain[r["id"]] = sorted(near, key=lambda u: (-near[u], u))[:5]
    for q, best in plain.items():
        assert [u for i, u, _ in sorted(whole, key=lambda r: r[2]) if i == q] == best
    nulls = queries.unionByName(spark.createDataFrame([("none", None)], "id string, vector array<double>"))
    assert rows(L.topk_cosine(nulls, units, 5), "id", "ku_id", "rank") == whole
    assert len(rows(L.topk_cosine(queries, units, 50))) == 24 * 17
    assert L.topk_cosine(queries, units.limit(0), 5).isEmpty()


def test_rerank_order_and_cooccurrence(spark, rows):
    units = spark.createDataFrame([("k1", "a", "IS", "core"), ("k2", "b", "AL", "core")], UNIT)
    concepts = spark.createDataFrame([("x", "c", "38100"), ("y", "c", "38100"), ("z", "c", "38100")], CONCEPT)
    near = spark.createDataFrame([("x", "k1", 0.5), ("x", "k2", 0.9), ("x", "gone", 0.1)], CANDIDATE)
    ranked = {r["ku_id"]: r for r in L.rerank(near, concepts, units).collect()}
    assert ranked["k2"]["rank"] == 1 and ranked["gone"]["score"] == pytest.approx(0.40 * 0.1 + 0.0025)
    even = spark.createDataFrame([("x", "k1", 0.6), ("x", "k2", 0.6)], CANDIDATE)
    areas = spark.createDataFrame([("x", "c", "AL"), ("y", "c", "IS"), ("z", "c", None)],
                                  "concept_id string, course_id string, area string")
    ranked = {r["ku_id"]: r for r in L.rerank(even, concepts, units, areas).collect()}
    # The concept's own prediction is left out and the missing one not counted.
    assert ranked["k1"]["cooccurrence"] == 1.0 and ranked["k2"]["cooccurrence"] == 0.0
    assert ranked["k1"]["rank"] == 1


def test_verify_cases(spark, rows):
    concepts = spark.createDataFrame([("none", "c"), ("one", "c"), ("clear", "c"), ("close", "c")],
                                     "concept_id string, course_id string")
    data = [("one", "c", 0.5, "k", 0.2, 1), ("clear", "c", 0.5, "k", 0.9, 1), ("clear", "c", 0.5, "j", 0.1, 2),
            ("close", "c", 0.5, "k", 0.11, 1), ("close", "c", 0.5, "j", 0.10, 2)]
    surviving = spark.createDataFrame(data, RANKED)
    got = {r["concept_id"]: r for r in L.verify(surviving, concepts, min_confidence=0.54).collect()}
    assert got["none"]["status"] == "unaligned" and got["none"]["confidence"] == 0.0
    assert got["one"]["confidence"] == pytest.approx(1 / (1 + math.exp(-0.2)))
    assert got["clear"]["ku_id"] == "k" and got["clear"]["confidence"] > 0.99
    assert got["close"]["status"] == "low_confidence_unaligned" and got["close"]["ku_id"] is None


def test_judgements_fail_open(spark, rows):
    verified = spark.createDataFrame(
        [("yes", "k", 0.9, "aligned"), ("no", "k", 0.9, "aligned"), ("null", "k", 0.9, "aligned"), ("absent", "k", 0.9, "aligned")],
        "concept_id string, ku_id string, confidence double, status string")
    asked = spark.createDataFrame([("yes", "k", True), ("no", "k", False), ("null", "k", None)],
                                  "concept_id string, ku_id string, belongs boolean")
    got = {r["concept_id"]: (r["ku_id"], r["confidence"], r["status"]) for r in L.apply_judgements(verified, asked).collect()}
    assert got["no"] == (None, 0.9, "low_confidence_unaligned")
    assert all(got[c] == ("k", 0.9, "aligned") for c in ("yes", "null", "absent"))


def brute_alignment(ranked, refused):
    """One concept after the other, as the order demands."""
    by_concept = {}
    for concept, course, level, unit, score, rank in ranked:
        by_concept.setdefault((course, concept, level), []).append((rank, unit, score))
    seen, out = {}, {}
    for (course, concept, level), candidates in sorted(by_concept.items()):
        left = [c for c in sorted(candidates) if not (seen.get(c[1]) and all(level + 0.5 < s for s in seen[c[1]]))]
        n_rejected = len(candidates) - len(left)
        if not left:
            out[concept] = (None, "unaligned", n_rejected)
        elif (concept, left[0][1]) in refused:
            out[concept] = (None, "low_confidence_unaligned", n_rejected)
        else:
            seen.setdefault(left[0][1], set()).add(level)
            out[concept] = (left[0][1], "aligned", n_rejected)
    return out


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 60), (3, 250), (4, 250)])
def test_rejection_equals_the_sequential_pass(spark, seed, n):
    rng = random.Random(seed)
    ranked, refused = [], set()
    for k in range(n):
        concept, course = f"n{k:03d}", f"c{rng.randrange(20):02d}"
        level = [1.0, 0.8, 0.6, 0.4, 0.2, 0.0][int(course[1:]) % 6]
        units = rng.sample("pqrstu" if n == 60 else "abcdefghijklmnopqrstu", rng.randrange(1, 4))
        scores = sorted((rng.random() for _ in units), reverse=True)
        ranked += [(concept, course, level, u, s, i + 1) for i, (u, s) in enumerate(zip(units, scores))]
        if rng.random() < 0.2:
            refused.add((concept, units[0]))
    frame = spark.createDataFrame(ranked, RANKED)
    concepts = frame.select("concept_id", "course_id").distinct()
    asked = spark.createDataFrame([(*r, False) for r in sorted(refused)], "concept_id string, ku_id string, belongs boolean")
    expected = brute_alignment(ranked, refused)
    assert any(n for _, _, n in expected.values())
    got = L.align(frame, concepts, asked).collect()
    assert {r["concept_id"]: (r["ku_id"], r["status"], r["n_rejected"]) for r in got} == expected


def test_rejection_hangs_on_earlier_rejections(spark):
    """Each low concept's outcome is settled by what earlier ones won or lost."""
    ranked = [("h1", "a", 1.0, "u1", 0.9, 1), ("h2", "a", 1.0, "u2", 0.9, 1), ("h3", "a", 1.0, "u3", 0.9, 1),
              ("n1", "b", 0.0, "u1", 0.9, 1), ("n1", "b", 0.0, "free", 0.8, 2),
              ("n2", "c", 0.4, "u2", 0.9, 1), ("n2", "c", 0.4, "u3", 0.2, 2), ("n2", "c", 0.4, "free", 0.1, 3),
              ("n3", "d", 0.0, "u3", 0.9, 1), ("n3", "d", 0.0, "u4", 0.1, 2), ("n4", "e", 0.2, "u3", 0.5, 1)]
    frame = spark.createDataFrame(ranked, RANKED)
    concepts = frame.select("concept_id", "course_id").distinct()
    got = {r["concept_id"]: (r["ku_id"], r["status"], r["n_rejected"]) for r in L.align(frame, concepts).collect()}
    assert got == brute_alignment(ranked, set())
    assert L.align(frame.limit(0), concepts.limit(0)).isEmpty()
    none = {r["concept_id"]: r["status"] for r in L.align(frame.limit(0), concepts).collect()}
    assert set(none.values()) == {"unaligned"} and len(none) == 7


def test_coverage(spark, rows):
    aligned = spark.createDataFrame([("K1", "a"), ("K1", "b"), ("K1", "b"), ("K2", "a")], "ku_id string, course_id string")
    units = spark.createDataFrame([("K1",), ("K2",), ("K3",)], "ku_id string")
    counts = L.coverage_counts(aligned, units)
    assert rows(counts) == [("K1", 2), ("K2", 1), ("K3", 0)]
    assert rows(L.thin_units(counts, 2), "ku_id") == [("K2",), ("K3",)]
    assert rows(L.thin_units(counts, 1), "ku_id") == [("K3",)]


def test_resolution(spark, rows):
    resolved = spark.createDataFrame(
        [(q, u, s, p) for q in ("a", "b") for u, s, p in (("k1", 0.62, 1), ("k2", 0.55, 2), ("k3", 0.51, 3))],
        "query_id string, ku_id string, similarity double, pos int")
    picks = spark.createDataFrame([("a", "k3", 1), ("a", "nope", 2), ("a", "k1", 3), ("a", "k3", 4), ("b", "nope", 1)],
                                  "query_id string, ku_id string, pos int")
    got = rows(L.select_units(resolved, picks, "e", "s"))
    assert got == [("a", "k1", 2, "e+s"), ("a", "k3", 1, "e+s"), ("b", "k1", 1, "e+fallback"),
                   ("b", "k2", 2, "e+fallback"), ("b", "k3", 3, "e+fallback")]


def test_first_per_label(spark, rows):
    raw = spark.createDataFrame([("c", "x", 2, "m2"), ("c", "x", 0, "m0"), ("c", "y", 1, "m1")],
                                "course_id string, label string, pos int, model_id string")
    assert rows(L.first_per_label(raw)) == [("c", "x", 0, "m0"), ("c", "y", 1, "m1")]
