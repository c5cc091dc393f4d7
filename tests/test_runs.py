"""End-to-end runs on small landings, stored and dry."""

import datetime
import json

from pyspark.sql import functions as F

from kgraph.plans import runs

NOW = datetime.datetime(2024, 1, 1)
PAGE = "url string, html string, retrieved_at timestamp, source_revision string, skip_reason string"


def test_ingest_course_pages(spark, rows, tmp_path):
    course = "<h1>CS {n} - Title {n}</h1><p>Credit Hours: 3.00.</p><p>Prerequisite: {p}.</p>"
    pages = spark.createDataFrame([
        ("https://a", course.format(n=38100, p="CS 25100 and CS 18200"), NOW, "9", None),
        ("https://b", course.format(n=59000, p="permission of instructor"), NOW, "9", None),
        ("https://c", "<p>nothing here</p>", NOW, "9", None), ("https://d", None, NOW, "9", "robots_disallowed")], PAGE)
    programme = spark.createDataFrame([("https://p", "<body><h1>Bachelor of Arts</h1><p>12 credit hours</p></body>", NOW, "9")],
                                      "url string, html string, retrieved_at timestamp, source_revision string")
    second = spark.createDataFrame([("38100", "other words"), ("59000", "")], "course_number string, description string")
    out = runs.ingest_course_pages(pages, programme, second, out=str(tmp_path / "run"))
    assert rows(out["edges"], "from_id", "to_id") == [("CS-38100", "CS-18200"), ("CS-38100", "CS-25100")]
    assert rows(out["outcomes"], "url", "status", "reason") == sorted([
        ("https://a", "succeeded", None), ("https://b", "succeeded", None), ("https://c", "failed", "parse_failed"),
        ("https://d", "skipped", "robots_disallowed")], key=repr)
    summary = out["summary"].first()
    assert (summary["courses_attempted"], summary["prereqs_structured"], summary["prereqs_unstructured"]) == (4, 1, 1)
    assert summary["failure_rate_pct"] == 25.0 and summary["alarm"] and summary["odata_discrepancies"] == 1
    assert summary["programmes_ingested"] == 1 and out["programmes"].first()["requirement_rules"][0]["rule_type"] == "minimum_credits"


def test_ingest_spine_and_blocks(spark, rows):
    item = lambda n, **c: {"Id": n, "Number": n, "Title": f"T{n}", "CreditHours": 3, **c}
    payload = json.dumps({"value": [item("25200"), item("25200", Title="again"), item("18000", CreditHours=None), item("1", CreditHours="x")]})
    syllabus = ("<main><h1>CS 252: Systems</h1><p>Prerequisite: CS 250</p><h2>Detailed Syllabus:</h2><p>Processes and many files</p></main>")
    out = runs.ingest_spine(spark.createDataFrame([(payload,)], "payload string"),
                            spark.createDataFrame([("https://s", syllabus)], "url string, html string"), "https://list")
    got = {r["course_id"]: r for r in out["courses"].collect()}
    assert set(got) == {"CS-25200", "CS-18000"} and got["CS-25200"]["title"] == "Systems"
    assert got["CS-25200"]["provenance"]["source_url"] == "https://s" and got["CS-18000"]["provenance"]["source_url"] == "https://list/Courses"
    assert tuple(got["CS-18000"]["credits"]) == (0.0, 0.0)
    assert rows(out["edges"], "from_id", "to_id") == [("CS-25200", "CS-25000")]
    block = ('<div class="courseblock"><p class="courseblocktitle">{s} 500 Adv credit: 4 Hours.</p>'
             '<p class="courseblockdesc">Prerequisite: {s} 225.</p></div>')
    pages = [spark.createDataFrame([(f"https://{s}", block.format(s=s))], "url string, html string") for s in ("CS", "ECE")]
    blocks = runs.ingest_block_pages(*pages)
    assert rows(blocks["courses"], "course_id", "level") == [("CS-500", "graduate"), ("ECE-500", "graduate")]
    assert rows(blocks["edges"], "to_id") == [("CS-225",), ("ECE-225",)]


def test_extract_infer_evaluate(spark, rows, tmp_path):
    text = "a description that is long enough"
    courses = spark.createDataFrame(
        [("CS-1", "10000", text), ("CS-2", "20000", text), ("CS-3", "30000", "short")], "course_id string, course_number string, description string")
    payloads = spark.createDataFrame(
        [("CS-1", '{"concepts":[{"label":"x"},{"label":"y"},{"label":"x"}]}'), ("CS-2", '["x","y"]'), ("CS-3", '["x"]')],
        "course_id string, payload string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, vector array<double>")
    units = spark.createDataFrame([("k1", "one", "A", "core"), ("k2", "two", "B", "core")], "ku_id string, label string, knowledge_area string, tier string")
    unit_vectors = spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.0, 1.0])], "ku_id string, vector array<double>")
    got = runs.extract_concepts(courses, payloads, vectors, units, unit_vectors)
    assert rows(got["concepts"], "source_course_id", "label", "knowledge_unit_id", "alignment_status") == [
        (c, l, k, "aligned") for c in ("CS-1", "CS-2") for l, k in (("x", "k1"), ("y", "k2"))]
    summary = got["summary"].first()
    assert (summary["courses_processed"], summary["concepts_skipped_empty"], summary["concepts_aligned"]) == (3, 1, 4)
    assert summary["concepts_extracted"] == 5  # the repeated label was extracted as well
    stored = got["concepts"].filter("label = 'x'").select("source_course_id", "label")
    assert runs.extract_concepts(courses, payloads, vectors, units, unit_vectors, stored)["concepts"].count() == 2
    concepts = got["concepts"]
    declared = spark.createDataFrame([("CS-2", "CS-1")], "course_id string, prereq_id string")
    graph = runs.infer_graph(concepts, courses, units, declared, out=str(tmp_path / "infer"))
    assert graph["dependency_pairs"].agg(F.sum("n_pairs")).first()[0] == 4
    report = {r["knowledge_area"]: r for r in graph["area_coverage"].collect()}
    assert (report["A"]["concept_count"], report["A"]["dependency_edge_count"], report["A"]["similarity_edge_count"]) == (2, 2, 1)
    summary = graph["summary"].first()
    assert (summary["dependency_edges"], summary["similarity_edges"], summary["rejection_rate_pct"]) == (4, 2, 0.0)
    ids = {(r["source_course_id"], r["label"]): r["concept_id"] for r in concepts.collect()}
    edges = spark.createDataFrame([(ids[("CS-2", "x")], ids[("CS-1", "x")], 0.64)], "from_id string, to_id string, confidence double")
    nodes = spark.createDataFrame([(i, c, {"CS-1": "10000", "CS-2": "20000"}[c], "A") for (c, _), i in ids.items()],
                                  "concept_id string, course_id string, course_number string, knowledge_area string")
    result = runs.evaluate_graph(edges, nodes, declared, held_out=declared, ablate=True)
    assert {r["band"]: r["tp"] for r in result["headline"].collect()} == {"all": 1, "high": 0, "medium": 1, "low": 0}
    assert {r["mode"]: r["tp"] for r in result["ablation"].collect()} == {"retrieval_only": 0, "retrieval_rerank": 1, "full_pipeline": 1}
    assert {r["section"] for r in result["report"].collect()} == {"headline", "by_knowledge_area", "reproduction", "failures", "ablation"}


def test_inferred_graph_has_no_cycle(spark, rows):
    """Three courses of one level that require each other in a ring, two concepts each."""
    ring = [("A", "B"), ("B", "C"), ("C", "A")]
    courses = spark.createDataFrame([(c, "20000") for c in "ABC"], "course_id string, course_number string")
    units = spark.createDataFrame([("k", "one", "X", "core")], "ku_id string, label string, knowledge_area string, tier string")
    concepts = spark.createDataFrame([(f"{c}{i}", c, "k", "aligned", 0.9) for c in "ABC" for i in (1, 2)], (
        "concept_id string, source_course_id string, knowledge_unit_id string, alignment_status string, confidence double"))
    declared = spark.createDataFrame(ring, "course_id string, prereq_id string")
    found = runs.infer_graph(concepts, courses, units, declared, min_score=0.5)
    pairs = found["dependency_pairs"].select("course_a", "course_b", "n_pairs").collect()
    summary, rejected = found["summary"].first(), found["rejected"].filter("reason = 'cycle_prevention'").count()
    from kgraph.operators import cycles as Y

    assert rejected > 0 and not Y.has_cycle(found["dependency_pairs"].select(
        F.col("course_a").alias("src"), F.col("course_b").alias("dst"), "score"))
    assert summary["edges_rejected_cycle"] == 4 * rejected
    assert summary["dependency_edges"] == sum(p["n_pairs"] for p in pairs)
    assert found["area_coverage"].first()["dependency_edge_count"] == summary["dependency_edges"]
    assert found["dropped"].agg(F.sum("n_pairs")).first()[0] == 4 * rejected
    # an edge of an earlier run counts: the edge that closes a ring with it is not new
    earlier = spark.createDataFrame([("A1", "B1"), ("B1", "C1")], "from_id string, to_id string")
    again = runs.infer_graph(concepts, courses, units, declared, min_score=0.5, stored=earlier)
    assert not Y.has_cycle(again["dependency_pairs"].select(
        F.col("course_a").alias("src"), F.col("course_b").alias("dst"), "score"))


def small_graph(spark, levels):
    courses = spark.createDataFrame(list(levels.items()), "course_id string, course_number string")
    units = spark.createDataFrame([("k", "one", "X", "core")], "ku_id string, label string, knowledge_area string, tier string")
    concepts = spark.createDataFrame([(f"{c}{i}", c, "k", "aligned", 0.9) for c in levels for i in (1, 2)], (
        "concept_id string, source_course_id string, knowledge_unit_id string, alignment_status string, confidence double"))
    return concepts, courses, units


def test_stored_edge_that_closes_a_cycle_is_expired(spark, rows):
    """A stored edge against a declared pair of one level goes; one that points upward goes once a way leads down."""
    inputs = small_graph(spark, {"A": "20000", "B": "20000", "L": "10000"})
    declared = spark.createDataFrame([("A", "B"), ("B", "L")], "course_id string, prereq_id string")
    earlier = spark.createDataFrame([("B1", "A1"), ("L1", "A2"), ("A1", "B2")], "from_id string, to_id string")
    found = runs.infer_graph(*inputs, declared, min_score=0.5, stored=earlier)
    assert rows(found["expired"], "from_id", "to_id") == [("B1", "A1"), ("L1", "A2")]
    assert found["summary"].first()["edges_rejected_cycle"] == 2 and found["dropped"].isEmpty()
    assert found["rejected"].filter("reason = 'cycle_prevention'").count() == 2
    assert found["dependency_pairs"].agg(F.sum("n_pairs")).first()[0] == 8  # A to B and B to L


def test_two_runs_leave_one_acyclic_table(spark, rows, tmp_path):
    from kgraph.operators import cycles as Y
    from kgraph.sources import tables as A

    graph = str(tmp_path / "graph")
    inputs = small_graph(spark, {"A": "20000", "B": "20000", "C": "20000", "L": "10000"})
    declared = lambda *pairs: spark.createDataFrame(pairs, "course_id string, prereq_id string")
    runs.infer_graph(*inputs, declared(("A", "B"), ("B", "C"), ("C", "L")), "r1", 0.5, graph=graph)
    first = {r["edge_id"]: r for r in A.read_edges(spark, f"{graph}/edges").collect()}
    assert len(first) == 3 and all(r["active"] and r["run_id"] == "r1" for r in first.values())
    # now C requires A: a ring with what is stored
    second = runs.infer_graph(*inputs, declared(("C", "A"), ("C", "L"), ("B", "C")), "r2", 0.5, graph=graph)
    table = A.read_edges(spark, f"{graph}/edges")
    assert {r["edge_id"] for r in table.collect()} >= set(first)
    active = A.stored_dependencies(table)
    assert not Y.has_cycle(active)
    name = lambda c: '{"course":"%s","area":"X"}' % c
    gone = rows(table.filter("not active"), "from_id", "to_id")
    assert gone == [(name("A"), name("B"))]
    assert second["summary"].first()["edges_rejected_cycle"] == 4
    assert rows(spark.read.parquet(f"{graph}/rejected").filter("reason = 'cycle_prevention'"), "src", "dst", "run_id") == [
        (name("A"), name("B"), "r2")]
    # the same run once more changes nothing
    before = sorted(table.collect())
    runs.infer_graph(*inputs, declared(("C", "A"), ("C", "L"), ("B", "C")), "r2", 0.5, graph=graph)
    assert sorted(A.read_edges(spark, f"{graph}/edges").collect()) == before


def test_downward_edges_are_stored_by_course(spark, rows, tmp_path):
    """One stored edge stands for all areas of a course; once the course is renumbered, it is cut into cells and what closes no
    cycle stays. Totals by course equal those of the pairs by area."""
    from kgraph.operators import infer as I
    from kgraph.sources import tables as A

    graph = str(tmp_path / "graph")
    units = spark.createDataFrame([(k, k, k.upper(), "core") for k in "xyz"], "ku_id string, label string, knowledge_area string, tier string")
    concepts = spark.createDataFrame([(f"{c}{k}{i}", c, k, "aligned", 0.9) for c, ks in (("A", "xyz"), ("B", "xy"), ("L", "z")) for k in ks for i in (1, 2)], (
        "concept_id string, source_course_id string, knowledge_unit_id string, alignment_status string, confidence double"))
    levels = lambda **n: spark.createDataFrame([(c, f"{d}0000") for c, d in n.items()], "course_id string, course_number string")
    declared = lambda *pairs: spark.createDataFrame(pairs, "course_id string, prereq_id string")
    found = runs.infer_graph(concepts, levels(A=3, B=2, L=1), units, declared(("A", "B"), ("B", "L"), ("L", "A")), "r1", 0.5, graph=graph)
    course, part = (lambda c: '{"course":"%s"}' % c), (lambda c, same: '{"course":"%s","same_area":%s}' % (c, same))
    stored = rows(A.read_edges(spark, f"{graph}/edges"), "from_id", "to_id")
    assert stored == [(course("A"), part("B", "false")), (course("A"), part("B", "true")), (course("B"), part("L", "false"))]
    assert sorted(int(r["n_pairs"]) for r in found["edges"].collect()) == [8, 8, 16]
    cells = I.course_cells(I.concept_nodes(concepts, levels(A=3, B=2, L=1), units))
    scored = I.scored_courses(cells, I.candidate_prior(cells, declared(("A", "B"), ("B", "L")), 0.5), declared(("A", "B"), ("B", "L")), 0.5)
    assert rows(I.scored_totals(scored, cells, 0.5)) == rows(I.pair_totals(I.area_pairs(scored, cells, 0.5)))
    # A is now below B, and B's cell of area x needs A's: the stored edge between these cells goes, the others stay
    name = lambda c, area: '{"course":"%s","area":"%s"}' % (c, area)
    again = runs.infer_graph(concepts, levels(A=2, B=2, L=1), units, declared(("B", "A")), "r2", 0.5, graph=graph)
    active = A.read_edges(spark, f"{graph}/edges").filter("active")
    flat = [r for r in rows(active, "from_id", "to_id") if '"area"' in r[0]]
    assert (name("B", "X"), name("A", "X")) in flat and (name("A", "X"), name("B", "X")) not in flat
    assert not rows(active.filter(F.col("from_id") == course("A")).filter(F.col("to_id") == part("B", "true")))
    assert again["expired"].count() > 0


def test_only_named_partitions_are_written_again(spark, tmp_path):
    from kgraph.sources import tables as A

    path = str(tmp_path / "edges")
    edges = lambda pairs, run: A.inferred_edges(
        spark.createDataFrame(pairs, "from_id string, to_id string, confidence double"), "concept_dependency", run)
    none = edges([], "none")
    A.write_inferred_edges(edges([(f"a{i}", "b", 0.5) for i in range(200)], "r1"), none, path)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("edges/**/*.parquet")}
    A.write_inferred_edges(edges([("a3", "b", 0.9), ("new", "b", 0.6)], "r2"), edges([("a4", "b", 0.0)], "r2"), path)
    kept = {p for p, at in files.items() if p.exists() and p.stat().st_mtime_ns == at}
    assert len(files) - len(kept) <= 3
    table = {r["from_id"]: r for r in A.read_edges(spark, path).collect()}
    assert len(table) == 201 and (table["a3"]["confidence"], table["a3"]["run_id"]) == (0.9, "r2")
    assert [k for k, r in table.items() if not r["active"]] == ["a4"] and table["a5"]["run_id"] == "r1"


def test_spine_keeps_landing_order_and_one_page_per_course(spark):
    item = lambda n, title: json.dumps({"value": [{"Id": n, "Number": "25200", "Title": title, "CreditHours": 3}]})
    payloads = spark.createDataFrame([(1, item("9", "first")), (2, item("10", "second"))], "seq int, payload string")
    page = "<main><h1>CS 252:</h1><p>nothing more</p></main>"
    pages = spark.createDataFrame([("https://b", page), ("https://a", page)], "url string, html string")
    alone = runs.ingest_spine(payloads, pages.limit(0), "https://list")["courses"].collect()
    assert [r["title"] for r in alone] == ["first"]
    both = runs.ingest_spine(payloads, pages, "https://list")["courses"].collect()
    assert [r["course_id"] for r in both] == ["CS-25200"]


def test_staging_can_be_cleared(spark):
    from kgraph.sources import staging

    table = staging.stage(spark.range(3).toDF("x"), "three")
    assert table.count() == 3 and staging.is_small(table, 3) and not staging.is_small(table, 2)
    folder = staging._run_folder(spark)
    staging.clear_staging(spark)
    from kgraph.sources.tables import exists

    assert not exists(spark, folder)
