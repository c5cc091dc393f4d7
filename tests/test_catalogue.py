"""Pages, prerequisite texts, normalisation, payloads, rules and sinks."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from kgraph.operators import catalogue as B
from kgraph.operators import validate as V
from kgraph.plans.queries_catalogue import page_title
from kgraph.sources import tables as A

NOW = datetime.datetime(2024, 1, 1)
PAGE = "url string, html string, retrieved_at timestamp, source_revision string"


def page(spark, html):
    return spark.createDataFrame([("https://x", html, NOW, "7")], PAGE)


def test_blocks(spark):
    html = ('<div class="courseblock"><p class="courseblocktitle">CS 100 &nbsp; Orientation  credit: 1 Hour.</p>'
            '<p class="courseblockdesc">First <b>steps</b>.</p></div><div class="other courseblock">'
            '<p class="courseblocktitle">CS 101 Intro  credit: 3 Hours.</p><p class="courseblockdesc">A &amp; B. Prerequisite: MATH 220.</p>'
            '</div><div class="courseblock"><p class="courseblocktitle">no match</p></div>')
    got = {r["number"]: r for r in B.course_blocks(page(spark, html)).collect()}
    assert set(got) == {"100", "101"} and got["100"]["credits"] == 1.0 and got["101"]["credits"] == 3.0
    assert got["101"]["description"] == "A & B. Prerequisite: MATH 220." and got["100"]["title"] == "Orientation"


def test_course_page(spark):
    html = ("<html><h1>CS 18000 - Problem Solving. More</h1><p>Credit Hours: 4.00. Prerequisite: CS 10000 and CS 18200.</p>"
            "<p>Same as ECE 38100.</p></html>")
    got = B.course_pages(page(spark, html)).first()
    assert (got["subject_code"], got["course_number"], got["title"], got["level_raw"]) == ("CS", "18000", "Problem Solving", "Undergraduate")
    assert "4.00" in got["credits_raw"] and got["prereqs_raw"] == "CS 10000 and CS 18200" and got["cross_list_raw"] == ["ECE 38100"]
    assert B.course_pages(page(spark, "<html><body></body></html>")).isEmpty()


def test_syllabus_page(spark):
    html = ("<main><h1>CS 252: Systems Programming</h1><p>Prerequisite: CS 25000 and CS 251 and CS 25000</p>"
            "<h2>Detailed Syllabus:</h2><p>Processes, files and sockets</p><p>Contact us</p></main>")
    got = B.syllabus_pages(page(spark, html)).first()
    assert (got["number_3"], got["title"]) == ("252", "Systems Programming")
    assert got["prerequisite_refs"] == ["CS-25000", "CS-25100"] and got["description"] == "Processes, files and sockets"
    bare = B.syllabus_pages(page(spark, "<h1>CS 252: X</h1>")).first()
    assert not bare["has_description"] and bare["prerequisite_refs"] == []


def test_programme_page_with_unclosed_tags(spark):
    html = ("<body><h1>Bachelor of <i>Science</i></h1><div class='tab_content'><ul><li>At least 12 credit hours<li>2.50 GPA"
            "</ul><p>CS 18000 or MA 26100</p><p>abc</p></div><p>outside rule text</p></body>")
    got = B.programme_pages(page(spark, html)).first()
    assert got["name"] == "Bachelor ofScience" and got["level_raw"] == "Undergraduate"
    kinds = [(r["verbatim_text"], r["rule_type_hint"], r["course_refs"]) for r in got["requirement_rules"]]
    assert kinds == [("At least 12 credit hours 2.50 GPA", "hours", []), ("2.50 GPA", "gpa", []),
                     ("CS 18000 or MA 26100", "courses", ["CS-18000", "MA-26100"])]


def test_page_title_decodes_what_its_sql_decodes(spark, tmp_path):
    pages = [("u1", "<body><h1>BS &amp;&quot;x&quot; &am</h1></body>"), ("u2", "<body><h1>A &lt;b&gt; &amp;amp; &amp</h1></body>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["url"]: r["name"] for r in page_title(spark, str(tmp_path)).collect()}
    assert got == {"u1": "BS &&quot;x&quot; &am", "u2": "A &lt;b&gt; &amp; &amp"}


leaf = lambda c, g=None: {"course_id": c, "min_grade": g}
GRAMMAR = [
    ("CS 18000", leaf("CS-18000")),
    ("CS 18000 (C or better)", leaf("CS-18000", "C")),
    ("CS 18000 and CS 18200", {"op": "and", "children": [leaf("CS-18000"), leaf("CS-18200")]}),
    ("CS 18000 or CS 18200 or MA 26100", {"op": "or", "children": [leaf("CS-18000"), leaf("CS-18200"), leaf("MA-26100")]}),
    ("(CS 18000 or CS 18200) and CS 25100",
     {"op": "and", "children": [{"op": "or", "children": [leaf("CS-18000"), leaf("CS-18200")]}, leaf("CS-25100")]}),
    ("((CS 18000))", leaf("CS-18000")),
    ("CS 18000 consent needed", leaf("CS-18000")),
    ("CS 18000 and CS 18200 or CS 25100", None), ("CS 18000 CS 18200", None), ("CS 18000 or instructor", None),
    ("(CS 18000", None), ("CS 18000)", None), ("and CS 18000", None), ("(C or better) CS 18000", None),
    ("Permission of instructor required", None), ("Junior standing or above", None), ("", None), ("  ", None),
]


def test_grammar(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GRAMMAR)], "i int, t string")
    got = df.select("i", "t", B.prerequisite_rule("t").alias("r"), B.prerequisite_rule("t", strict=True).alias("s")).orderBy("i").collect()
    for row, (text, tree) in zip(got, GRAMMAR):
        assert row["r"]["machine_checkable"] == (tree is not None), text
        assert (json.loads(row["r"]["structured"]) if tree else row["r"]["structured"]) == tree, text
        assert row["r"]["verbatim_text"] == (text or "(empty)")
    assert not got[6]["s"]["machine_checkable"] and got[4]["s"]["machine_checkable"]


def test_normalised_course_and_edges(spark, rows):
    base = dict(subject_code="CS", course_number="38100", title="T", description="d", credits_raw="3.00 Credit Hours",
                prereqs_raw="", cross_list_raw=[], level_raw="Undergraduate", source_url="https://x", retrieved_at=NOW, source_revision=None)
    changes = [{}, {"credits_raw": "1.00 to 3.00 Credit Hours"}, {"credits_raw": "Variable"}, {"credits_raw": "none"},
               {"prereqs_raw": "CS 18000"}, {"prereqs_raw": "permission"}, {"cross_list_raw": ["ECE 40400", "?"]},
               {"prereqs_raw": "CS 18000 and CS 18200", "level_raw": "Graduate"}]
    schema = ("subject_code string, course_number string, title string, description string, credits_raw string, prereqs_raw string, "
              "cross_list_raw array<string>, level_raw string, source_url string, retrieved_at timestamp, source_revision string")
    raw = spark.createDataFrame([tuple({**base, **c, "title": f"t{i}"}.values()) for i, c in enumerate(changes)], schema)
    courses = B.normalise_courses(raw, "acalog", "1.0.0")
    by_title = {r["title"]: r for r in courses.collect()}
    assert [tuple(by_title[f"t{i}"]["credits"]) for i in range(4)] == [(3.0, 3.0), (1.0, 3.0), (0.0, 0.0), (3.0, 3.0)]
    assert by_title["t0"]["course_id"] == "CS-38100" and by_title["t7"]["level"] == "graduate"
    edges = B.declared_edges(courses)
    assert rows(edges, "to_id", "relationship_type") == sorted(
        [("CS-18000", "prerequisite")] * 2 + [("CS-18200", "prerequisite"), ("ECE-40400", "cross_listing")], key=repr)


def test_first_wording_wins(spark, rows):
    refs = spark.createDataFrame([("c", 0, 0, "r", ""), ("c", 1, 0, "r", "second"), ("c", 2, 0, "r", "third"), ("c", 0, 1, "s", "")],
                                 "course_id string, rule_pos int, ref_pos int, ref string, verbatim_text string")
    assert rows(B.first_wording(refs)) == [("c", "r", "second"), ("c", "s", "")]


def test_payload_shapes(spark, rows):
    shapes = ['{"concepts":[{"label":" a "},"b",3,{"label":""},{"x":1}]}', '["a"]', '{"label":"a"}', '{"z":["a"]}', '{"z":["a"],"y":["b"]}',
              "{}", "", "nope", '{"a":1}', '[{"label":5}]', '{"concepts":"x","results":["a"]}', '"text"']
    concepts, rejected = B.concept_labels(spark.createDataFrame(list(enumerate(shapes)), "course_id int, payload string"))
    assert rows(concepts) == sorted([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (2, 0, "a"), (3, 0, "a"), (10, 0, "a")], key=repr)
    assert rows(rejected, "course_id") == sorted([(4,), (7,), (8,), (9,), (11,)], key=repr)


def test_rules_report_every_failure(spark, rows):
    edges = spark.createDataFrame([("m", 0.5, "e", "a", "b", "concept_dependency"), (" ", 1.5, "", "a", "b", "odd")],
                                  "model_id string, confidence double, edge_id string, from_id string, to_id string, relationship_type string")
    good, bad = V.split_valid(edges, V.inferred_edge_rules())
    assert good.count() == 1 and len(bad.first()["failures"]) == 4
    with pytest.raises(Exception, match="invalid record"):
        V.require_valid(edges, V.inferred_edge_rules()).collect()
    assert rows(V.from_json_rows(V.to_json_rows(edges), edges.schema)) == rows(edges)
    rule = spark.createDataFrame([("r", "", False, None), ("r", "x", True, None), ("r", "x", False, "t"), ("r", "x", False, None)],
                                 "rule_id string, verbatim_text string, machine_checkable boolean, structured string")
    assert V.split_valid(rule, V.prerequisite_rule_rules())[0].count() == 1


def test_course_lines(spark, rows, tmp_path):
    prov = {"source_url": "http://x", "retrieved_at": "2024-01-01T00:00:00+00:00", "adapter_name": "a", "adapter_version": "1"}
    line = lambda i, **c: json.dumps({"provenance": prov, "course_id": i, "authority": "derived", "subject_code": "CS", "course_number": "1",
        "title": "t", "description": "", "level": "graduate", "credits": 3.0, "declared_prerequisites": [{"rule_id": "r",
        "verbatim_text": "w", "machine_checkable": True, "structured": {"children": [{"course_id": "x"}, {"course_id": "y"}]}}], **c})
    (tmp_path / "courses.jsonl").write_text("\n".join([
        line("a"), "", line("b", credits={"min_credits": 1, "max_credits": 3}), line("c", level="odd"), "{broken", line("d")]))
    subset = spark.createDataFrame([("a",), ("b",), ("c",)], "course_id string")
    courses, rejected = A.read_courses(spark, str(tmp_path), subset)
    assert {r["course_id"]: tuple(r["credits"]) for r in courses.collect()} == {"a": (3.0, 3.0), "b": (1.0, 3.0)}
    assert rows(rejected, "course_id") == [("c",)]
    assert A.read_courses(spark, str(tmp_path))[1].count() == 2
    assert rows(A.course_references(courses), "course_id", "ref", "verbatim_text") == [
        (c, r, "w") for c in "ab" for r in "xy"]


def test_upserts(spark, rows):
    base = spark.createDataFrame([("k1", "old", "concept"), ("k2", "same", "unit")], "id string, label string, entity_type string")
    delta = spark.createDataFrame([("k1", "new", "unit"), ("k3", "add", "unit")], "id string, label string, entity_type string")
    assert rows(A.upsert(base, delta, ["id"], keep=("entity_type",))) == [("k1", "new", "concept"), ("k2", "same", "unit"), ("k3", "add", "unit")]
    courses = spark.createDataFrame([("a", "A")], "course_id string, title string")
    edges = spark.createDataFrame([("a", "z", "w")], "course_id string, prereq_id string, verbatim string")
    delta = spark.createDataFrame([("a", "z", "again"), ("a", "b", None)], "course_id string, prereq_id string, verbatim string")
    more, written = A.upsert_prerequisites(courses, edges, delta)
    assert rows(more) == sorted([("a", "A"), ("b", None), ("z", None)], key=repr)
    assert rows(written) == [("a", "b", ""), ("a", "z", "again")]


def test_snapshot(spark, tmp_path):
    root = str(tmp_path)
    courses = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    A.create_snapshot({"courses": courses, "edges": courses.limit(0)}, root, "s")
    assert A.verify_snapshot(spark, root, "s") and not A.verify_snapshot(spark, root, "gone")
    assert A.resolve_snapshot(spark, root, "s").count() == 2
    courses.withColumn("title", F.lit("x")).write.mode("overwrite").parquet(f"{root}/s/courses")
    assert not A.verify_snapshot(spark, root, "s")
    with pytest.raises(FileNotFoundError):
        A.resolve_snapshot(spark, root, "gone")
    A.write_artefact(courses, root, "r", "split")
    assert A.finish_run(spark, root, "r", ["split"]).first()["records"] == 2
    with pytest.raises(Exception):
        A.write_artefact(courses, root, "r", "split")


def test_label_and_split_files(spark, rows, tmp_path):
    write = lambda name, data: (tmp_path / name).write_text(json.dumps(data)) and str(tmp_path / name)
    assert rows(A.read_query_labels(spark, write("q.json", {"queries": [{"query": "x", "expected_areas": ["A", "B"]}]}))) == [
        (0, "x", "A"), (0, "x", "B")]
    with pytest.raises(Exception, match="label is not known"):
        A.read_judgements(spark, write("j.json", {"items": [{"item_id": "1", "label": "maybe"}]})).collect()
    saved = {"train": ["a->b"], "test": ["c->d"], "seed": 42, "fraction": 0.2, "ingestion_run_id": "r"}
    assert rows(A.read_split(spark, write("s.json", saved)), "key", "part") == [("a->b", "train"), ("c->d", "test")]
    with pytest.raises(Exception, match="split has no seed"):
        A.read_split(spark, write("t.json", {k: v for k, v in saved.items() if k != "seed"})).collect()
    assert A.read_summary(spark, str(tmp_path / "none.json")) is None
    vocabulary = {"units": [{"ku_id": "k", "label": "l", "knowledge_area": "A", "tier": "odd", "source": "S"}]}
    assert rows(A.read_vocabulary(spark, write("v.json", vocabulary)), "ku_id", "tier") == [("k", "elective")]


def test_blocks_take_the_first_part_inside_also_of_nested_ones(spark):
    page = (
        '<div class="courseblock x"><div class="courseblock"><p class="courseblocktitle">CS 101 Inner Title. Credit: 3 Hours.</p>'
        '<p class="courseblockdesc">inner <b>bold</b> text<script>no</script></p></div><p class="courseblocktitle">CS 102 Outer.</p></div>'
        '<p class="courseblocktitle">CS 103 outside.</p><div class="courseblock"><p class="courseblockdesc">alone'
        '<div class="courseblock"><p class="courseblocktitle">CS 104 open</p>')
    from kgraph.functions import html as H

    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    parts = [("p", "courseblocktitle"), ("p", "courseblockdesc")]
    got = [r[0] for r in df.select(H.blocks("html", ("div", "courseblock"), parts)).collect()]
    inner = [["CS 101 Inner Title. Credit: 3 Hours."], ["inner ", "bold", " text"]]
    assert got == [[inner, inner, [["CS 104 open"], ["alone", "CS 104 open"]], [["CS 104 open"], None]], [], []]


def test_once_keeps_columns_of_any_name(spark):
    from kgraph.functions.once import with_once

    df = spark.createDataFrame([(1, "k", 2)], "`a.b` int, _once string, x int")
    out = with_once(df, {"x": F.col("x") + 1, "y": F.col("`a.b`") * 10})
    assert out.columns == ["a.b", "_once", "x", "y"] and tuple(out.first()) == (1, "k", 3, 10)


def test_pages_are_read_in_small_batches(spark):
    from kgraph.operators import catalogue

    catalogue.programme_pages(spark.createDataFrame([("u", "<h1>A</h1>")], "url string, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 128
