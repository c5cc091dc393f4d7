"""Matching, combinations, readiness and overlap on small tables."""

import pytest
from pyspark.sql import functions as F

from kgraph.functions import scores as S
from kgraph.operators import advise as A
from kgraph.operators import guard as G
from kgraph.plans.discover import discover, discover_answer

COURSE = "course_id string, course_number string, subject_code string, title string, level string, description string"
ALIGNED = "concept_id string, course_id string, ku_id string, confidence double"


@pytest.fixture()
def scored(spark):
    def make(*courses):
        return spark.createDataFrame(
            [("q", c, c[-5:], f"title {c}", kus, len(kus), conf, total, len(kus) / total * conf) for c, kus, conf, total in courses],
            "query_id string, course_id string, course_number string, title string, covered_kus array<string>, n_covered int, "
            "mean_confidence double, total_kus int, relevance_score double")
    return make


def test_composite(spark):
    score = lambda *a: spark.range(1).select(S.composite_score(*[F.lit(x) for x in a])).first()[0]
    assert score(5, 10, 0.6) == pytest.approx(0.30) and score(3, 0, 0.9) == 0.0
    assert spark.range(1).select(S.coverage_breadth(F.lit(5), F.lit(14))).first()[0] == "5 of 14 concepts"


def test_breadth_beats_confidence(scored, rows):
    kus = lambda n: [f"k{i}" for i in range(n)]
    top = A.top_courses(scored(("narrow", kus(1), 0.97, 14), ("broad", kus(5), 0.60, 14)), 5)
    assert rows(top, "rank", "course_id") == [(1, "broad"), (2, "narrow")]
    even = A.top_courses(scored(("few", kus(1), 0.4, 4), ("more", kus(2), 0.2, 4)), 5)
    assert rows(even, "rank", "course_id")[0] == (1, "more")


def declared_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "course_id string, prereq_id string")


def test_combination_notes(spark, scored):
    none = declared_of(spark)
    two = A.combinations(scored(("CS-25100", ["k1", "k2"], 0.9, 4), ("CS-18000", ["k3", "k4"], 0.8, 4)), none).collect()
    assert len(two) == 1 and two[0]["combined_coverage_breadth"] == "4 of 4 concepts" and two[0]["redundancies"] == []
    note = two[0]["prerequisite_order"]
    assert len(note) == 1 and not note[0]["declared"] and note[0]["message"]
    assert A.combinations(scored(("a", ["k1", "k2", "k3"], 0.9, 4), ("b", ["k1"], 0.8, 4)), none).isEmpty()
    shared = A.combinations(scored(("CS-25100", ["k1", "k2"], 0.9, 4), ("CS-18000", ["k2", "k3"], 0.8, 4)),
                            declared_of(spark, ("CS-25100", "CS-18000"))).first()
    assert shared["redundancies"][0]["overlapping_kus"] == ["k2"]
    order = shared["prerequisite_order"][0]
    assert (order["take_first"], order["then_take"], order["declared"]) == ("18000", "25100", True)


@pytest.fixture(scope="module")
def graph(spark):
    courses = spark.createDataFrame(
        [("CS-3", "30000", "CS", "Three", "undergraduate", "d" * 300), ("CS-1", "10000", "CS", "One", "undergraduate", None),
         ("CS-5", "50000", "CS", "Five", "graduate", "x")], COURSE)
    aligned = spark.createDataFrame(
        [("1", "CS-3", "A", 0.8), ("2", "CS-3", "A", 0.2), ("3", "CS-3", "B", 0.6), ("4", "CS-3", "C", 0.7),
         ("5", "CS-1", "A", 0.9), ("6", "CS-1", "B", 0.4), ("7", "CS-5", "C", 0.5)], ALIGNED)
    units = spark.createDataFrame([(k, f"label {k}", "AL") for k in "ABCD"], "ku_id string, label string, knowledge_area string")
    declared = spark.createDataFrame([("CS-3", "CS-1", "both"), ("CS-3", "CS-2", None), ("CS-5", "CS-3", "three")],
                                     "course_id string, prereq_id string, verbatim string")
    return courses, aligned, units, declared


def requests(spark, *rows_):
    return spark.createDataFrame(list(rows_), "student_id string, course_id string")


def test_readiness(spark, rows, graph):
    courses, _, _, declared = graph
    asked = requests(spark, ("s", "CS-3"), ("s", "CS-1"), ("s", "CS-9"), ("s", "CS-2"))
    done = requests(spark, ("s", "CS-1"))
    got = {c: (n, ready, status) for _, c, n, ready, status in rows(A.readiness(asked, done, declared, courses))}
    assert got == {"CS-3": (1, False, "ok"), "CS-1": (0, True, "ok"), "CS-9": (0, False, "course_not_found"),
                   "CS-2": (0, True, "ok")}
    assert rows(A.unmet_prerequisites(asked, done, declared, courses), "course_id", "prereq_id", "title", "verbatim") == [
        ("CS-3", "CS-2", "", "")]


def test_overlap(spark, rows, graph):
    courses, aligned, _, _ = graph
    asked, done = requests(spark, ("s", "CS-3"), ("t", "CS-3")), requests(spark, ("s", "CS-1"), ("s", "CS-3"), ("t", "CS-3"))
    got = {s: (m, g, c) for s, _, _, m, g, c in rows(A.overlap(asked, done, aligned, courses))}
    assert got == {"s": (2, 1, 0.7), "t": (0, 3, 0.0)}


def test_thin_coverage_counts_units_without_courses(spark, rows, graph):
    _, aligned, units, _ = graph
    asked = spark.createDataFrame([("q", "A"), ("q", "D"), ("q", "unknown")], "query_id string, ku_id string")
    assert rows(A.thin_coverage(asked, units, aligned), "ku_id", "n_courses") == [("D", 0)]


def test_discover_sections(spark, rows, graph):
    courses, aligned, units, declared = graph
    queries = spark.createDataFrame([("found",), ("empty",), ("unresolved",)], "query_id string")
    asked = spark.createDataFrame([("found", "A"), ("found", "B"), ("found", "C"), ("found", "D"), ("empty", "D")],
                                  "query_id string, ku_id string")
    answer = discover(queries, asked, units, aligned, courses, declared)
    assert rows(answer["status"], "query_id", "status") == [
        ("empty", "no_courses_found"), ("found", "ok"), ("unresolved", "no_concepts_resolved")]
    best = {r["course_id"]: r for r in answer["courses"].collect()}
    assert best["CS-3"]["coverage_breadth"] == "3 of 4 concepts" and best["CS-3"]["confidence"] == 0.7
    assert len(best["CS-3"]["description_excerpt"]) == 200 and best["CS-1"]["covered_kus"] == ["A"]
    assert rows(answer["thin_coverage"], "query_id", "ku_id") == [("found", "D")]
    tagged = discover_answer(answer)
    assert rows(tagged.filter("section = 'status'"), "query_id", "item") == rows(answer["status"], "query_id", "status")
    for section, name in (("unit", "resolved_kus"), ("course", "courses"), ("combination", "combinations"), ("thin", "thin_coverage")):
        assert tagged.filter(F.col("section") == section).count() == answer[name].count()
    assert rows(tagged.filter("section = 'thin'"), "query_id", "item") == [("found", "D")]
    assert ("found", "CS-3") in rows(tagged.filter("section = 'course'"), "query_id", "item")
    graduate = discover(queries, asked, units, aligned, courses, declared, level="graduate")
    assert rows(graduate["courses"], "course_id") == [("CS-5",)]


def test_guard(spark, rows):
    texts = ["You are exempt.", "It covers everything", "You can skip it", "EXEMPT", "you WILL master it", "Plain text", "exemption"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["clean"] for r in G.scan(df, "text").collect()}
    assert [got[t] for t in texts] == [False, False, False, False, False, True, True]
    with pytest.raises(Exception, match="entitlement language"):
        G.require_clean(df, ["text"]).collect()
    assert G.require_clean(df.filter("text = 'Plain text'"), ["text"]).count() == 1


def test_requests_for_single_courses(spark, rows):
    courses = spark.createDataFrame(
        [("A", "100", "S", "a", "ug", "da"), ("B", "200", "S", "b", "ug", None), ("C", "300", "S", "c", "g", "dc")],
        "course_id string, course_number string, subject_code string, title string, level string, description string")
    declared = spark.createDataFrame(
        [("B", "A", "v1"), ("C", "B", None), ("A", "STUB", "v3"), ("C", "A", "v4")], "course_id string, prereq_id string, verbatim string")
    aligned = spark.createDataFrame([("B", "k", 0.5), ("B", "k", 0.7), ("C", "k", 0.9)], "course_id string, ku_id string, confidence double")
    units = spark.createDataFrame([("k", "unit", "X")], "ku_id string, label string, knowledge_area string")
    asked = spark.createDataFrame([("A",), ("C",), ("STUB",), ("NO",), ("A",)], "course_id string")
    unlocked = A.unlock_requests(asked, courses, declared)
    missing = "No course 'NO' is present in the catalogue graph."
    assert rows(unlocked, "course_id", "status", "unlocks", "title") == sorted([
        ("A", "ok", "B", "b"), ("A", "ok", "C", "c"), ("C", "ok", None, None), ("NO", "course_not_found", None, None),
        ("STUB", "ok", "A", "a"), ("STUB", "ok", "B", "b"), ("STUB", "ok", "C", "c")], key=repr)
    assert {r["status_message"] for r in unlocked.filter("status <> 'ok'").collect()} == {missing}
    facts = rows(A.course_details(asked, courses, aligned, units, declared), "course_id", "section", "item_id", "label", "note", "status")
    assert [f for f in facts if f[1] == "course"] == sorted([
        ("A", "course", "A", "a", "da", "ok"), ("C", "course", "C", "c", "dc", "ok"), ("NO", "course", "NO", "", "", "course_not_found"),
        ("STUB", "course", "STUB", "", "", "ok")], key=repr)
    assert ("A", "prerequisite", "STUB", "", "v3", "ok") in facts and ("C", "concept", "k", "unit", "X", "ok") in facts
    assert not any(f[0] == "B" for f in facts) and sum(f[1] == "unlock" for f in facts) == 5
    students = spark.createDataFrame([("s", "C"), ("s", "A"), ("s", "NO")], "student_id string, course_id string")
    done = spark.createDataFrame([("s", "B")], "student_id string, course_id string")
    assert rows(A.overlap_details(students, done, aligned, units, courses)) == sorted([
        ("s", "C", "ok", "k", "unit", "X", 0.9, True), ("s", "A", "ok", None, None, None, None, None),
        ("s", "NO", "course_not_found", None, None, None, None, None)], key=repr)


def test_overlap_of_a_hub_course_and_of_odd_requests(spark, rows):
    """More units than one pack holds; a cover by another course, by the target itself, for a null student; unknown courses."""
    aligned = spark.createDataFrame([(1, k, 0.5) for k in range(150)] + [(2, 149, 0.25), (2, 500, 0.75)],
                                    "course_id int, ku_id int, confidence double")
    done = spark.createDataFrame([(7, 2), (7, 1), (8, 1), (None, 2)], "student_id int, course_id int")
    asked = spark.createDataFrame([(7, 1), (8, 1), (None, 1), (9, 3), (9, 4)], "student_id int, course_id int")
    got = A.overlap_units(asked, done, aligned)
    assert got.count() == 450 and rows(got.filter("matched"), "student_id", "course_id", "ku_id") == [(7, 1, 149)]
    courses = spark.createDataFrame([(1,), (2,), (3,)], "course_id int")
    batch = rows(A.overlap(asked, done, aligned, courses), "student_id", "course_id", "status", "n_matched", "n_gap", "confidence")
    assert (7, 1, "ok", 1, 149, 0.5) in batch and (9, 3, "ok", 0, 0, 0.0) in batch and (9, 4, "course_not_found", 0, 0, 0.0) in batch
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("ku_id" in line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line)
