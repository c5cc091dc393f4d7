"""SQL text of the mapped views, shared by the check queries.

Each view is the plain-SQL statement of a method of mapping.Tables.
"""

from __future__ import annotations

import re

VIEWS = {
    "course": """SELECT p_partkey AS course_id, CAST(1 + (p_size - 1) // 9 AS INTEGER) AS lvl,
        CAST(1 + (p_size - 1) // 9 AS VARCHAR) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS course_number,
        p_brand AS subject_code, p_name AS title,
        CASE WHEN 1 + (p_size - 1) // 9 >= 5 THEN 'graduate' ELSE 'undergraduate' END AS level,
        p_brand || ' ' || p_type || ' ' || p_name AS description FROM part""",
    "ku": """SELECT s_suppkey AS ku_id, s_name AS label, n_name AS knowledge_area,
        CASE WHEN s_suppkey % 2 = 0 THEN 'core' ELSE 'elective' END AS tier
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "ku_region": """SELECT s_suppkey AS ku_id, s_name AS label, r_name AS knowledge_area,
        CASE WHEN s_suppkey % 2 = 0 THEN 'core' ELSE 'elective' END AS tier
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "concept": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS concept_id,
        l_partkey AS source_course_id, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS knowledge_unit_id,
        CASE WHEN l_returnflag = 'R' THEN 'aligned' ELSE 'unaligned' END AS alignment_status,
        l_quantity / 64.0 AS confidence FROM lineitem""",
    "aligned": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS concept_id,
        l_partkey AS course_id, l_suppkey AS ku_id, l_quantity / 64.0 AS confidence
        FROM lineitem WHERE l_returnflag = 'R'""",
    "rline": """SELECT l_orderkey, l_linenumber, l_quantity, lvl, l_partkey AS course_id
        FROM lineitem JOIN course ON l_partkey = course.course_id WHERE l_returnflag = 'R'""",
    "declared": """SELECT a.course_id, b.course_id AS prereq_id, 'order ' || CAST(min(a.l_orderkey) AS VARCHAR) AS verbatim
        FROM rline a JOIN rline b ON a.l_orderkey = b.l_orderkey AND a.lvl = b.lvl + 1 GROUP BY 1, 2""",
    "anyline": """SELECT l_orderkey, lvl, l_partkey AS course_id, l_quantity / 64.0 AS confidence,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS concept_id
        FROM lineitem JOIN course ON l_partkey = course.course_id""",
    "dependency": """SELECT a.concept_id AS from_id, b.concept_id AS to_id, a.course_id AS from_course,
        b.course_id AS to_course, max(a.confidence) AS confidence
        FROM anyline a JOIN anyline b ON a.l_orderkey = b.l_orderkey AND a.lvl IN (b.lvl + 1, b.lvl + 2) GROUP BY 1, 2, 3, 4""",
    "interest": """SELECT CAST(s_nationkey AS BIGINT) AS query_id, s_suppkey AS ku_id,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier""",
    "completed": """SELECT DISTINCT o_custkey AS student_id, l_partkey AS course_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'""",
    "targets": """SELECT DISTINCT o_custkey AS student_id, l_partkey AS course_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'""",
    "matches": """SELECT query_id, c.course_id, any_value(c.course_number) AS course_number, any_value(c.title) AS title,
        any_value(c.subject_code) AS subject_code, any_value(c.level) AS level,
        substr(any_value(c.description), 1, 200) AS description_excerpt,
        array_to_string(list_sort(list(DISTINCT a.ku_id)), ',') AS covered_kus,
        count(DISTINCT a.ku_id) AS n_covered, sum(a.confidence) / count(*) AS mean_confidence
        FROM interest i JOIN aligned a ON i.ku_id = a.ku_id JOIN course c ON c.course_id = a.course_id
        WHERE a.confidence >= 0.5 GROUP BY query_id, c.course_id""",
    "totals": "SELECT query_id, count(*) AS total_kus FROM interest GROUP BY query_id",
    "ranked": """SELECT m.*, total_kus, n_covered / total_kus * mean_confidence AS relevance_score,
        CAST(n_covered AS VARCHAR) || ' of ' || CAST(total_kus AS VARCHAR) || ' concepts' AS coverage_breadth
        FROM matches m JOIN totals USING (query_id)""",
    "pool": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC,
        n_covered DESC, mean_confidence DESC, course_id) AS rnk FROM ranked) WHERE rnk <= 20""",
    "closure": """SELECT src, dst, min(hop) AS hop FROM walk GROUP BY src, dst""",
}

RECURSIVE = {
    "walk": """SELECT course_id AS src, prereq_id AS dst, 1 AS hop FROM declared
        UNION SELECT w.src, d.prereq_id, w.hop + 1 FROM walk w JOIN declared d ON w.dst = d.course_id WHERE w.hop < 5""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `body` with the views it names, in order of need."""
    known = {**VIEWS, **RECURSIVE, **(extra or {})}
    order: list[str] = []

    def need(text: str, current: str | None = None) -> None:
        for name in known:
            if name != current and name not in order and re.search(rf"\b{name}\b(?!\s*\()", text):
                need(known[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    heads = ",\n".join(f"{name} AS ({known[name]})" for name in order)
    return f"WITH RECURSIVE {heads}\n{body}"
