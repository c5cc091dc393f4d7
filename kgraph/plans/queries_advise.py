"""Registered advisory queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.operators import advise as A
from kgraph.operators import closure as C
from kgraph.plans import discover as D
from kgraph.plans.mapping import Tables
from kgraph.plans.oracle import VIEWS
from kgraph.plans.oracle import with_views as V


def _text(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


def _matches(t: Tables):
    return A.match_courses(t.interest(), t.aligned_concept(), t.course())


def _scored(t: Tables):
    return A.with_scores(_matches(t), A.query_sizes(t.interest()))


def match_courses(spark, folder):
    return _matches(Tables(spark, folder)).select(
        "query_id", "course_id", "course_number", "subject_code", "title", "level", "description_excerpt",
        _text("covered_kus"), "mean_confidence",
    )


def rank_courses(spark, folder):
    t = Tables(spark, folder)
    return A.rank_courses(_matches(t), A.query_sizes(t.interest())).select(
        "query_id", "course_id", F.col("n_covered").cast("bigint").alias("n_covered"),
        "mean_confidence", F.round("relevance_score", 6).alias("relevance_score"), "coverage_breadth",
    )


def top_courses(spark, folder):
    return A.top_courses(_scored(Tables(spark, folder)), A.K.COMBINATION_POOL).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "course_id", _text("covered_kus"),
    )


def ku_labels(spark, folder):
    t = Tables(spark, folder)
    return A.ku_labels(t.interest(), t.knowledge_unit())


def thin_coverage(spark, folder):
    t = Tables(spark, folder)
    strong = t.aligned_concept().filter("confidence >= 0.75")
    return A.thin_coverage(t.interest(), t.knowledge_unit(), strong, min_courses=10)


def declared_pairs_between(spark, folder):
    t = Tables(spark, folder)
    return A.declared_between(_matches(t).select("query_id", "course_id"), t.declared())


def _combos(t: Tables):
    return A.combinations(_scored(t), t.declared())


def combinations(spark, folder):
    return _combos(Tables(spark, folder)).select(
        "query_id", F.col("position").cast("bigint").alias("position"), _text("course_ids"), _text("combined_kus"),
        "combined_coverage_breadth", F.round("combined_relevance", 6).alias("combined_relevance"),
    )


def redundancy(spark, folder):
    return (
        _combos(Tables(spark, folder))
        .select("query_id", F.col("position").cast("bigint").alias("position"), F.explode("redundancies").alias("r"))
        .select("query_id", "position", "r.course_a_number", "r.course_b_number",
                F.concat_ws(",", F.transform("r.overlapping_kus", lambda x: x.cast("string"))).alias("overlapping_kus"))
    )


def prereq_notes(spark, folder):
    return (
        _combos(Tables(spark, folder))
        .select("query_id", F.col("position").cast("bigint").alias("position"),
                F.explode("prerequisite_order").alias("n"))
        .select("query_id", "position", "n.take_first", "n.then_take", "n.declared", "n.message")
    )


def course_prerequisites(spark, folder):
    t = Tables(spark, folder)
    return A.prerequisites(t.declared(), t.course())


def readiness_batch(spark, folder):
    t = Tables(spark, folder)
    return A.readiness(t.targets(), t.completed(), t.declared(), t.course())


def unmet_prerequisites(spark, folder):
    t = Tables(spark, folder)
    return A.unmet_prerequisites(t.targets(), t.completed(), t.declared(), t.course())


def unlock(spark, folder):
    t = Tables(spark, folder)
    return A_unlocks(t)


def A_unlocks(t: Tables):
    titles = t.course().select(F.col("course_id").alias("unlocks"), "title")
    return C.unlocks(t.declared()).join(titles, "unlocks", "left").select(
        "course_id", "unlocks", F.coalesce("title", F.lit("")).alias("title")
    )


def course_detail(spark, folder):
    t = Tables(spark, folder)
    return A.course_detail(
        t.course(), t.aligned_concept(), t.knowledge_unit(), t.declared(), C.unlocks(t.declared())
    )


def course_concepts(spark, folder):
    t = Tables(spark, folder)
    return A.course_concepts(t.aligned_concept(), t.knowledge_unit())


def covered_kus(spark, folder):
    t = Tables(spark, folder)
    sets = t.completed().withColumnRenamed("student_id", "query_id")
    return A.covered_units(sets, t.aligned_concept())


def overlap_batch(spark, folder):
    t = Tables(spark, folder)
    return A.overlap(t.targets(), t.completed(), t.aligned_concept(), t.course())


def overlap_units(spark, folder):
    t = Tables(spark, folder)
    return A.overlap_units(t.targets(), t.completed(), t.aligned_concept())


def unlock_requests(spark, folder):
    t = Tables(spark, folder)
    return A.unlock_requests(t.course_requests(), t.course(), t.declared())


def course_details(spark, folder):
    t = Tables(spark, folder)
    return A.course_details(t.course_requests(), t.course(), t.aligned_concept(), t.knowledge_unit(), t.declared())


def readiness_requests(spark, folder):
    t = Tables(spark, folder)
    return A.readiness(t.student_requests(), t.completed(), t.declared(), t.course())


def overlap_details(spark, folder):
    t = Tables(spark, folder)
    return A.overlap_details(t.student_requests(), t.completed(), t.aligned_concept(), t.knowledge_unit(), t.course())


def status_branch(spark, folder):
    t = Tables(spark, folder)
    queries = t.read("nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"))
    matches = A.match_courses(t.interest(), t.aligned_concept(), t.course(), level="graduate", min_confidence=0.77)
    return A.discover_status(queries, t.interest(), matches).select("query_id", "status")


def discover(spark, folder):
    """Every nation asks three times: for its suppliers and a unit that no course covers, for a unit that is not known,
    and for nothing that could be resolved."""
    t = Tables(spark, folder)
    nation = t.read("nation").select(F.col("n_nationkey").cast("bigint").alias("n"), "n_name")
    uncovered, unknown = F.col("n") + 20_000_000, F.col("n") + 10_000_000
    queries = nation.select(F.explode(F.array(*[F.col("n") + k for k in (0, 1000, 2000)])).alias("query_id"))
    interest = (
        t.interest().select("query_id", "ku_id")
        .unionByName(nation.select(F.col("n").alias("query_id"), uncovered.alias("ku_id")))
        .unionByName(nation.select((F.col("n") + 1000).alias("query_id"), unknown.alias("ku_id")))
    )
    units = t.knowledge_unit().unionByName(nation.select(
        uncovered.alias("ku_id"), F.concat(F.lit("uncovered "), "n_name").alias("label"),
        F.col("n_name").alias("knowledge_area"), F.lit("core").alias("tier")))
    return D.discover_answer(D.discover(queries, interest, units, t.aligned_concept(), t.course(), t.declared()))


COMBO_VIEWS = {
    "member": "SELECT * FROM pool",
    "pairset": """SELECT a.query_id, [a.rnk, b.rnk] AS ranks, [a.course_id, b.course_id] AS ids, a.total_kus,
        list_sort(list_distinct(list_concat(string_split(a.covered_kus, ','), string_split(b.covered_kus, ',')))) AS kus,
        (0.0 + a.mean_confidence + b.mean_confidence) / 2 AS rel
        FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.rnk < b.rnk""",
    "tripleset": """SELECT a.query_id, [a.rnk, b.rnk, c.rnk] AS ranks, [a.course_id, b.course_id, c.course_id] AS ids,
        a.total_kus, list_sort(list_distinct(list_concat(list_concat(string_split(a.covered_kus, ','),
        string_split(b.covered_kus, ',')), string_split(c.covered_kus, ',')))) AS kus,
        (0.0 + a.mean_confidence + b.mean_confidence + c.mean_confidence) / 3 AS rel
        FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.rnk < b.rnk
        JOIN pool c ON a.query_id = c.query_id AND b.rnk < c.rnk""",
    "combo": """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id
        ORDER BY len(kus) DESC, rel DESC, len(ranks), ranks) AS position
        FROM (SELECT * FROM pairset UNION ALL SELECT * FROM tripleset) s
        JOIN (SELECT query_id, max(n_covered) AS best FROM pool GROUP BY 1) m
        ON s.query_id = m.query_id AND len(s.kus) > m.best) WHERE position <= 5""",
    "combomember": """SELECT query_id, position, unnest(ranks) AS rnk FROM combo""",
    "combopair": """SELECT x.query_id, x.position, p.course_id AS a_id, p.course_number AS a_number,
        p.covered_kus AS a_kus, q.course_id AS b_id, q.course_number AS b_number, q.covered_kus AS b_kus
        FROM combomember x JOIN combomember y ON x.query_id = y.query_id AND x.position = y.position AND x.rnk < y.rnk
        JOIN pool p ON p.query_id = x.query_id AND p.rnk = x.rnk
        JOIN pool q ON q.query_id = y.query_id AND q.rnk = y.rnk""",
    "paired": """SELECT cp.*, EXISTS (SELECT 1 FROM declared d WHERE d.course_id = a_id AND d.prereq_id = b_id) AS ab,
        EXISTS (SELECT 1 FROM declared d WHERE d.course_id = b_id AND d.prereq_id = a_id) AS ba FROM combopair cp""",
}
UNLOCK_VIEWS = {
    "climb": """SELECT prereq_id AS course_id, course_id AS unlocks FROM declared
        UNION SELECT c.course_id, d.course_id FROM climb c JOIN declared d ON d.prereq_id = c.unlocks""",
}
REQUEST_VIEWS = {
    **UNLOCK_VIEWS,
    "asked": """SELECT DISTINCT l_partkey AS course_id FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1
        UNION SELECT p_partkey + 10000000 FROM part WHERE p_partkey % 50 = 0""",
    "answered": """SELECT course_id, CASE WHEN course_id IN (SELECT course_id FROM course) THEN 'ok' ELSE 'course_not_found' END AS status,
        CASE WHEN course_id IN (SELECT course_id FROM course) THEN ''
        ELSE 'No course ' || chr(39) || course_id || chr(39) || ' is present in the catalogue graph.' END AS status_message FROM asked""",
    "askedby": """SELECT student_id, course_id, 'ok' AS status FROM targets
        UNION ALL SELECT c_custkey, c_custkey + 10000000, 'course_not_found' FROM customer WHERE c_custkey % 20 = 0""",
}
OVERLAP_VIEWS = {
    "unitof": "SELECT course_id, ku_id, max(confidence) AS max_confidence FROM aligned GROUP BY 1, 2",
    "overlapped": """SELECT t.student_id, t.course_id, u.ku_id, u.max_confidence,
        EXISTS (SELECT 1 FROM cover c WHERE c.student_id = t.student_id AND c.ku_id = u.ku_id
        AND c.course_id <> t.course_id) AS matched
        FROM targets t JOIN unitof u ON t.course_id = u.course_id""",
    "cover": """SELECT DISTINCT c.student_id, c.course_id, u.ku_id FROM completed c JOIN unitof u
        ON c.course_id = u.course_id""",
    "unmet": """SELECT t.student_id, t.course_id, d.prereq_id, d.verbatim FROM targets t
        JOIN declared d ON d.course_id = t.course_id
        WHERE NOT EXISTS (SELECT 1 FROM completed c WHERE c.student_id = t.student_id AND c.course_id = d.prereq_id)""",
}
DISCOVER_VIEWS = {
    **COMBO_VIEWS,
    "interest": VIEWS["interest"] + """ UNION ALL SELECT n_nationkey, n_nationkey + 20000000, 0 FROM nation
        UNION ALL SELECT n_nationkey + 1000, n_nationkey + 10000000, 1 FROM nation""",
    "ku": VIEWS["ku"] + " UNION ALL SELECT n_nationkey + 20000000, 'uncovered ' || n_name, n_name, 'core' FROM nation",
    "asking": "SELECT CAST(n_nationkey + k AS BIGINT) AS query_id FROM nation, (VALUES (0), (1000), (2000)) v(k)",
    "verdicts": """SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM interest) THEN 'no_concepts_resolved'
        WHEN query_id NOT IN (SELECT query_id FROM matches) THEN 'no_courses_found' ELSE 'ok' END AS status FROM asking""",
}

QUERIES = {
    "match_courses": (match_courses, V("""SELECT query_id, course_id, course_number, subject_code, title, level,
        description_excerpt, covered_kus, mean_confidence FROM matches""")),
    "rank_courses": (rank_courses, V("""SELECT query_id, course_id, n_covered, mean_confidence,
        round(relevance_score, 6) AS relevance_score, coverage_breadth FROM ranked""")),
    "top_courses": (top_courses, V("SELECT query_id, rnk AS rank, course_id, covered_kus FROM pool")),
    "ku_labels": (ku_labels, V("""SELECT query_id, interest.ku_id, coalesce(label, '') AS label,
        coalesce(knowledge_area, '') AS knowledge_area FROM interest LEFT JOIN ku ON interest.ku_id = ku.ku_id""")),
    "thin_coverage": (thin_coverage, V("""SELECT i.query_id, i.ku_id, count(DISTINCT a.course_id) AS n_courses
        FROM interest i JOIN ku ON ku.ku_id = i.ku_id
        LEFT JOIN (SELECT * FROM aligned WHERE confidence >= 0.75) a ON a.ku_id = i.ku_id
        GROUP BY 1, 2 HAVING count(DISTINCT a.course_id) < 10""")),
    "declared_pairs_between": (declared_pairs_between, V("""SELECT a.query_id, d.course_id, d.prereq_id
        FROM declared d JOIN matches a ON a.course_id = d.course_id
        JOIN matches b ON b.course_id = d.prereq_id AND a.query_id = b.query_id""")),
    "combinations": (combinations, V("""SELECT query_id, position, array_to_string(ids, ',') AS course_ids,
        array_to_string(list_sort(list_transform(kus, lambda x: CAST(x AS BIGINT))), ',') AS combined_kus,
        CAST(len(kus) AS VARCHAR) || ' of ' || CAST(total_kus AS VARCHAR) || ' concepts' AS combined_coverage_breadth,
        round(rel, 6) AS combined_relevance FROM combo""", COMBO_VIEWS)),
    "redundancy": (redundancy, V("""SELECT query_id, position, a_number AS course_a_number, b_number AS course_b_number,
        array_to_string(list_sort(list_transform(list_intersect(string_split(a_kus, ','), string_split(b_kus, ',')),
        lambda x: CAST(x AS BIGINT))), ',') AS overlapping_kus FROM combopair
        WHERE len(list_intersect(string_split(a_kus, ','), string_split(b_kus, ','))) > 0""", COMBO_VIEWS)),
    "prereq_notes": (prereq_notes, V("""SELECT query_id, position, CASE WHEN ab THEN b_number ELSE a_number END AS take_first,
        CASE WHEN ab THEN a_number ELSE b_number END AS then_take, TRUE AS declared, '' AS message
        FROM paired WHERE ab OR ba
        UNION ALL SELECT query_id, position, '', '', FALSE,
        'No ordering constraint is published between these courses.' FROM paired
        GROUP BY query_id, position HAVING NOT bool_or(ab OR ba)""", COMBO_VIEWS)),
    "course_prerequisites": (course_prerequisites, V("""SELECT d.course_id, d.prereq_id, coalesce(c.title, '') AS title,
        d.verbatim FROM declared d LEFT JOIN course c ON c.course_id = d.prereq_id""")),
    "readiness_batch": (readiness_batch, V("""SELECT t.student_id, t.course_id, count(u.prereq_id) AS n_unmet,
        count(u.prereq_id) = 0 AS ready, 'ok' AS status FROM targets t
        LEFT JOIN unmet u ON u.student_id = t.student_id AND u.course_id = t.course_id GROUP BY 1, 2""", OVERLAP_VIEWS)),
    "unmet_prerequisites": (unmet_prerequisites, V("""SELECT u.student_id, u.course_id, u.prereq_id, c.title, u.verbatim
        FROM unmet u JOIN course c ON c.course_id = u.prereq_id""", OVERLAP_VIEWS)),
    "unlock": (unlock, V("""SELECT climb.course_id, climb.unlocks, title FROM climb
        JOIN course ON course.course_id = climb.unlocks WHERE climb.course_id <> climb.unlocks""", UNLOCK_VIEWS)),
    "course_detail": (course_detail, V("""SELECT a.course_id, 'concept' AS section, CAST(a.ku_id AS VARCHAR) AS item_id,
        ku.label, ku.knowledge_area AS note, round(avg(a.confidence), 3) AS confidence
        FROM aligned a JOIN ku ON ku.ku_id = a.ku_id GROUP BY a.course_id, a.ku_id, ku.label, ku.knowledge_area
        UNION ALL SELECT d.course_id, 'prerequisite', CAST(d.prereq_id AS VARCHAR), c.title, d.verbatim, NULL
        FROM declared d JOIN course c ON c.course_id = d.prereq_id
        UNION ALL SELECT x.course_id, 'unlock', CAST(x.unlocks AS VARCHAR), c.title, '', NULL
        FROM climb x JOIN course c ON c.course_id = x.unlocks WHERE x.course_id <> x.unlocks""", UNLOCK_VIEWS)),
    "course_concepts": (course_concepts, V("""SELECT a.course_id, a.concept_id, a.ku_id, ku.label AS ku_label,
        ku.knowledge_area, a.confidence FROM aligned a JOIN ku ON ku.ku_id = a.ku_id""")),
    "covered_kus": (covered_kus, V("""SELECT DISTINCT c.student_id AS query_id, a.ku_id
        FROM completed c JOIN aligned a ON a.course_id = c.course_id""")),
    "overlap_units": (overlap_units, V("SELECT * FROM overlapped", OVERLAP_VIEWS)),
    "overlap_batch": (overlap_batch, V("""SELECT t.student_id, t.course_id, 'ok' AS status,
        count(*) FILTER (WHERE o.matched) AS n_matched, count(*) FILTER (WHERE NOT o.matched) AS n_gap,
        round(coalesce(avg(o.max_confidence) FILTER (WHERE o.matched), 0.0), 3) AS confidence
        FROM targets t LEFT JOIN overlapped o ON o.student_id = t.student_id AND o.course_id = t.course_id
        GROUP BY 1, 2""", OVERLAP_VIEWS)),
    "status_branch": (status_branch, V("""SELECT CAST(n_nationkey AS BIGINT) AS query_id,
        CASE WHEN n_nationkey NOT IN (SELECT query_id FROM interest) THEN 'no_concepts_resolved'
        WHEN n_nationkey NOT IN (SELECT i.query_id FROM interest i JOIN aligned a ON a.ku_id = i.ku_id
        JOIN course c ON c.course_id = a.course_id WHERE c.level = 'graduate' AND a.confidence >= 0.77)
        THEN 'no_courses_found' ELSE 'ok' END AS status FROM nation""")),
    "unlock_requests": (unlock_requests, V("""SELECT a.course_id, status, status_message, x.unlocks, c.title FROM answered a
        LEFT JOIN (SELECT * FROM climb WHERE course_id <> unlocks) x ON x.course_id = a.course_id
        LEFT JOIN course c ON c.course_id = x.unlocks""", REQUEST_VIEWS)),
    "course_details": (course_details, V("""SELECT a.course_id, status, status_message, 'course' AS section,
        a.course_id::VARCHAR AS item_id, coalesce(title, '') AS label, coalesce(description, '') AS note, NULL::DOUBLE AS confidence,
        coalesce(course_number, '') AS course_number, coalesce(subject_code, '') AS subject_code, coalesce(level, '') AS level
        FROM answered a LEFT JOIN course c ON c.course_id = a.course_id
        UNION ALL SELECT a.course_id, 'ok', '', 'concept', a.ku_id::VARCHAR, ku.label, ku.knowledge_area, round(avg(a.confidence), 3),
        NULL, NULL, NULL FROM aligned a JOIN ku ON ku.ku_id = a.ku_id WHERE a.course_id IN (SELECT course_id FROM asked)
        GROUP BY a.course_id, a.ku_id, ku.label, ku.knowledge_area
        UNION ALL SELECT d.course_id, 'ok', '', 'prerequisite', d.prereq_id::VARCHAR, c.title, d.verbatim, NULL, NULL, NULL, NULL
        FROM declared d JOIN course c ON c.course_id = d.prereq_id WHERE d.course_id IN (SELECT course_id FROM asked)
        UNION ALL SELECT x.course_id, 'ok', '', 'unlock', x.unlocks::VARCHAR, c.title, '', NULL, NULL, NULL, NULL
        FROM climb x JOIN course c ON c.course_id = x.unlocks
        WHERE x.course_id <> x.unlocks AND x.course_id IN (SELECT course_id FROM asked)""", REQUEST_VIEWS)),
    "readiness_requests": (readiness_requests, V("""SELECT t.student_id, t.course_id, count(u.prereq_id) AS n_unmet,
        count(u.prereq_id) = 0 AND t.status = 'ok' AS ready, t.status FROM askedby t
        LEFT JOIN unmet u ON u.student_id = t.student_id AND u.course_id = t.course_id GROUP BY t.student_id, t.course_id, t.status""",
        {**REQUEST_VIEWS, **OVERLAP_VIEWS})),
    "overlap_details": (overlap_details, V("""SELECT t.student_id, t.course_id, t.status, o.ku_id, ku.label AS ku_label,
        ku.knowledge_area, round(o.max_confidence, 3) AS confidence, o.matched FROM askedby t
        LEFT JOIN overlapped o ON o.student_id = t.student_id AND o.course_id = t.course_id
        LEFT JOIN ku ON ku.ku_id = o.ku_id""", {**REQUEST_VIEWS, **OVERLAP_VIEWS})),
    "discover": (discover, V(f"""SELECT query_id, 'status' AS section, CAST(NULL AS BIGINT) AS position, status AS item,
        CASE status WHEN 'no_concepts_resolved' THEN '{K.STATUS_NO_CONCEPTS}' WHEN 'no_courses_found' THEN '{K.STATUS_NO_COURSES}'
        ELSE '' END AS label, '' AS detail, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS confidence, '' AS note FROM verdicts
        UNION ALL SELECT query_id, 'unit', NULL, CAST(i.ku_id AS VARCHAR), coalesce(label, ''), coalesce(knowledge_area, ''),
        NULL, NULL, '' FROM interest i LEFT JOIN ku ON ku.ku_id = i.ku_id
        UNION ALL SELECT query_id, 'course', NULL, CAST(course_id AS VARCHAR), title, coverage_breadth || ': ' || covered_kus,
        round(relevance_score, 3), round(mean_confidence, 3), '{K.COVERAGE_CAVEAT}' FROM ranked
        UNION ALL SELECT query_id, 'combination', position, array_to_string(ids, ','),
        CAST(len(kus) AS VARCHAR) || ' of ' || CAST(total_kus AS VARCHAR) || ' concepts',
        array_to_string(list_sort(list_transform(kus, lambda x: CAST(x AS BIGINT))), ','), round(rel, 3), NULL,
        '{K.COVERAGE_CAVEAT}' FROM combo
        UNION ALL SELECT i.query_id, 'thin', NULL, CAST(i.ku_id AS VARCHAR), any_value(ku.label), '', NULL, NULL, '' FROM interest i
        JOIN ku ON ku.ku_id = i.ku_id LEFT JOIN aligned a ON a.ku_id = i.ku_id
        WHERE i.query_id IN (SELECT query_id FROM matches) GROUP BY i.query_id, i.ku_id
        HAVING count(DISTINCT a.course_id) < {K.MIN_COVERAGE_COURSES}""", DISCOVER_VIEWS)),
}
