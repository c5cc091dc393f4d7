"""Advisory queries over whole tables of requests.

Requests are rows: interest is (query_id, ku_id), readiness and overlap are
(student_id, course_id). Lists that can grow with the data stay rows; only the
units of one interest query, at most its top-k, are gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.functions import scores as S
from kgraph.operators.closure import bounded_closure
from kgraph.sources.staging import broadcast_if_small, stage

MAX_BROADCAST_ROWS = 100_000


def ku_labels(query_ku: DataFrame, units: DataFrame) -> DataFrame:
    """Label and area of every requested unit; unknown units get ''."""
    return query_ku.join(
        units.select("ku_id", "label", "knowledge_area"), "ku_id", "left"
    ).select(
        "query_id", "ku_id",
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("knowledge_area", F.lit("")).alias("knowledge_area"),
    )


def query_sizes(query_ku: DataFrame) -> DataFrame:
    return query_ku.groupBy("query_id").agg(F.count_distinct("ku_id").alias("total_kus"))


def excerpt(description: Column) -> Column:
    return F.substring(F.coalesce(description, F.lit("")), 1, K.EXCERPT_LENGTH)


def match_courses(
    query_ku: DataFrame,
    aligned: DataFrame,
    courses: DataFrame,
    level: str = "all",
    min_confidence: float = K.MATCH_MIN_CONFIDENCE,
) -> DataFrame:
    """Courses whose aligned concepts hit the requested units.

    Concepts are reduced to (course, unit) sums before they meet the queries, so
    a course or unit that holds a large share of the rows is combined on the map
    side and one unit asked for by many queries is not read many times.
    """
    asked = broadcast_if_small(query_ku.select("query_id", "ku_id").distinct(), MAX_BROADCAST_ROWS)
    units_asked = broadcast_if_small(query_ku.select("ku_id").distinct(), MAX_BROADCAST_ROWS)
    per_unit = (
        aligned.filter(F.col("confidence") >= min_confidence)
        .join(units_asked, "ku_id", "left_semi")
        .groupBy("course_id", "ku_id")
        .agg(F.sum("confidence").alias("conf_sum"), F.count(F.lit(1)).alias("n"))
    )
    hits = per_unit.join(asked, "ku_id").groupBy("query_id", "course_id").agg(
        F.sort_array(F.collect_set("ku_id")).alias("covered_kus"),
        (F.sum("conf_sum") / F.sum("n")).alias("mean_confidence"),
    )
    if level != "all":
        courses = courses.filter(F.col("level") == level)
    return hits.join(courses, "course_id").select(
        "query_id",
        "course_id",
        F.coalesce("course_number", F.lit("")).alias("course_number"),
        F.coalesce("subject_code", F.lit("")).alias("subject_code"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("level", F.lit("")).alias("level"),
        excerpt(F.col("description")).alias("description_excerpt"),
        "covered_kus",
        "mean_confidence",
    )


def with_scores(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """Add covered count, composite score and coverage text to matches."""
    covered = F.size("covered_kus")
    return (
        matches.join(broadcast_if_small(totals, MAX_BROADCAST_ROWS), "query_id")
        .withColumn("n_covered", covered)
        .withColumn("relevance_score", S.composite_score("n_covered", "total_kus", "mean_confidence"))
        .withColumn("coverage_breadth", S.coverage_breadth("n_covered", "total_kus"))
    )


def _rank_order() -> list[Column]:
    return [
        F.desc("relevance_score"), F.desc("n_covered"), F.desc("mean_confidence"), F.asc("course_id"),
    ]


def rank_courses(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """All matches, sorted per query by one range-partitioned sort."""
    return with_scores(matches, totals).orderBy(F.asc("query_id"), *_rank_order())


def top_courses(scored: DataFrame, n: int) -> DataFrame:
    """The n best courses of every query, with their rank."""
    window = W.partitionBy("query_id").orderBy(*_rank_order())
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def thin_coverage(
    query_ku: DataFrame, units: DataFrame, aligned: DataFrame, min_courses: int = K.MIN_COVERAGE_COURSES
) -> DataFrame:
    """Requested known units with fewer than `min_courses` distinct courses."""
    known = query_ku.select("query_id", "ku_id").distinct().join(units.select("ku_id"), "ku_id", "left_semi")
    pairs = aligned.select("ku_id", "course_id").distinct()
    counts = pairs.groupBy("ku_id").agg(F.count(F.lit(1)).alias("n_courses"))
    return (
        known.join(counts, "ku_id", "left")
        .withColumn("n_courses", F.coalesce("n_courses", F.lit(0)))
        .filter(F.col("n_courses") < min_courses)
        .select("query_id", "ku_id", "n_courses")
    )


def declared_between(query_course: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared pairs whose two ends are both in a query's course set."""
    members = query_course.select("query_id", "course_id").distinct()
    return (
        declared.select("course_id", "prereq_id").distinct()
        .join(members, "course_id")
        .join(
            members.select("query_id", F.col("course_id").alias("prereq_id")),
            ["query_id", "prereq_id"], "left_semi",
        )
        .select("query_id", "course_id", "prereq_id")
    )


# --- combinations -----------------------------------------------------------

def combination_pool(scored: DataFrame, pool: int = K.COMBINATION_POOL) -> DataFrame:
    """The best courses of each query, the only input of the combinations."""
    return top_courses(scored, pool).select(
        "query_id", "rank", "course_id", "course_number", "title", "covered_kus", "mean_confidence", "total_kus",
    )


def _member(pool: DataFrame, tag: str) -> DataFrame:
    return pool.select(
        "query_id",
        F.col("rank").alias(f"rank_{tag}"),
        F.struct("course_id", "course_number", "title", "covered_kus", "mean_confidence").alias(tag),
    )


def combinations(
    scored: DataFrame,
    declared: DataFrame,
    pool_size: int = K.COMBINATION_POOL,
    max_size: int = 3,
    max_results: int = K.MAX_COMBINATIONS,
) -> DataFrame:
    """Pairs and triples that cover more units than the best single course.

    The pool holds at most `pool_size` rows per query, which is the feature's own
    limit, so each query makes at most C(20,2) + C(20,3) rows.
    """
    if max_size not in (2, 3):
        raise ValueError("combinations hold two or three courses")
    pool = combination_pool(scored, pool_size)
    best = pool.groupBy("query_id").agg(
        F.max(F.size("covered_kus")).alias("best_single"), F.first("total_kus").alias("total_kus")
    )
    pairs = _member(pool, "a").join(_member(pool, "b"), "query_id").filter(F.col("rank_a") < F.col("rank_b"))
    sized = pairs.select("query_id", F.array("a", "b").alias("members"),
                         F.array("rank_a", "rank_b").alias("ranks"))
    if max_size >= 3:
        triples = pairs.join(_member(pool, "c"), "query_id").filter(F.col("rank_b") < F.col("rank_c"))
        sized = sized.unionByName(
            triples.select("query_id", F.array("a", "b", "c").alias("members"),
                           F.array("rank_a", "rank_b", "rank_c").alias("ranks"))
        )
    scored_sets = (
        sized.withColumn(
            "combined_kus",
            F.array_sort(F.array_distinct(F.flatten(F.transform("members", lambda m: m["covered_kus"])))),
        )
        .join(best, "query_id")
        .filter(F.size("combined_kus") > F.col("best_single"))
        .withColumn(
            "combined_relevance",
            F.aggregate("members", F.lit(0.0), lambda acc, m: acc + m["mean_confidence"]) / F.size("members"),
        )
    )
    window = W.partitionBy("query_id").orderBy(
        F.desc(F.size("combined_kus")), F.desc("combined_relevance"), F.asc(F.size("members")), F.asc("ranks")
    )
    top = scored_sets.withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= max_results
    )
    top = top.withColumn("redundancies", _redundancies()).withColumn(
        "combined_coverage_breadth", S.coverage_breadth(F.size("combined_kus"), F.col("total_kus"))
    )
    return _with_order_notes(top, declared)


def _pair_list() -> Column:
    """Member pairs of a combination of two or three, in order."""
    pair = lambda i, j: F.struct(F.get("members", F.lit(i)).alias("a"), F.get("members", F.lit(j)).alias("b"))
    return F.filter(F.array(pair(0, 1), pair(0, 2), pair(1, 2)), lambda p: p["b"].isNotNull())


def _redundancies() -> Column:
    """Units shared by each pair, for pairs that share any."""
    notes = F.transform(
        _pair_list(),
        lambda p: F.struct(
            p["a"]["course_number"].alias("course_a_number"),
            p["b"]["course_number"].alias("course_b_number"),
            F.array_sort(F.array_intersect(p["a"]["covered_kus"], p["b"]["covered_kus"])).alias("overlapping_kus"),
        ),
    )
    return F.filter(notes, lambda n: F.size(n["overlapping_kus"]) > 0)


def _with_order_notes(top: DataFrame, declared: DataFrame) -> DataFrame:
    """Attach, per combination, which member to take first."""
    pairs = top.select(
        "query_id", "position", F.posexplode(_pair_list()).alias("pair_pos", "pair")
    ).select(
        "query_id", "position", "pair_pos",
        F.col("pair.a.course_id").alias("a_id"), F.col("pair.a.course_number").alias("a_number"),
        F.col("pair.b.course_id").alias("b_id"), F.col("pair.b.course_number").alias("b_number"),
    )
    # Both readings of a pair meet the declared edges in one join; the reading
    # "a requires b" wins when both are declared.
    readings = pairs.select(
        "query_id", "position", "pair_pos",
        F.explode(F.array(
            F.struct(F.lit(0).alias("reading"), F.col("a_id").alias("course_id"), F.col("b_id").alias("prereq_id"),
                     F.col("b_number").alias("take_first"), F.col("a_number").alias("then_take")),
            F.struct(F.lit(1).alias("reading"), F.col("b_id").alias("course_id"), F.col("a_id").alias("prereq_id"),
                     F.col("a_number").alias("take_first"), F.col("b_number").alias("then_take")),
        )).alias("r"),
    ).select("query_id", "position", "pair_pos", "r.*")
    found = (
        readings.join(
            declared.select("course_id", "prereq_id").distinct(), ["course_id", "prereq_id"], "left_semi"
        )
        .groupBy("query_id", "position", "pair_pos")
        .agg(F.min(F.struct("reading", "take_first", "then_take")).alias("n"))
        .groupBy("query_id", "position")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("pair_pos"), F.col("n.take_first").alias("take_first"), F.col("n.then_take").alias("then_take"),
        ))).alias("found"))
    )
    declared_notes = F.transform("found", lambda n: F.struct(
        n["take_first"].alias("take_first"), n["then_take"].alias("then_take"),
        F.lit(True).alias("declared"), F.lit("").alias("message"),
    ))
    none_declared = F.array(F.struct(
        F.lit("").alias("take_first"), F.lit("").alias("then_take"),
        F.lit(False).alias("declared"), F.lit(K.NO_ORDER_MESSAGE).alias("message"),
    ))
    return (
        top.join(found, ["query_id", "position"], "left")
        .withColumn("prerequisite_order", F.coalesce(declared_notes, none_declared))
        .select(
            "query_id", "position",
            F.transform("members", lambda m: m["course_id"]).alias("course_ids"),
            F.transform("members", lambda m: m["course_number"]).alias("course_numbers"),
            F.transform("members", lambda m: m["title"]).alias("course_titles"),
            "combined_kus", "combined_coverage_breadth", "combined_relevance", "redundancies", "prerequisite_order",
        )
    )


# --- readiness, unlock, detail, overlap -------------------------------------

def course_exists(requests: DataFrame, courses: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Add `status`. A course named only as a prerequisite exists as a stub."""
    known = courses.select("course_id")
    if declared is not None:
        known = known.unionByName(declared.select(F.col("prereq_id").alias("course_id")))
        known = known.unionByName(declared.select("course_id"))
    known = known.distinct().withColumn("known", F.lit(True))
    return requests.join(known, "course_id", "left").withColumn(
        "status", F.when(F.col("known"), "ok").otherwise("course_not_found")
    ).drop("known")


def prerequisites(declared: DataFrame, courses: DataFrame) -> DataFrame:
    """Direct prerequisites with title and wording; stubs have title ''."""
    titles = courses.select(F.col("course_id").alias("prereq_id"), "title")
    return declared.join(titles, "prereq_id", "left").select(
        "course_id", "prereq_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("verbatim", F.lit("")).alias("verbatim"),
    )


def unmet_prerequisites(requests: DataFrame, completed: DataFrame, declared: DataFrame, courses: DataFrame) -> DataFrame:
    """One row per (student, course, missing prerequisite)."""
    done = completed.select("student_id", F.col("course_id").alias("prereq_id")).distinct()
    needed = requests.select("student_id", "course_id").distinct().join(prerequisites(declared, courses), "course_id")
    return needed.join(done, ["student_id", "prereq_id"], "left_anti").select(
        "student_id", "course_id", "prereq_id", "title", "verbatim"
    )


def readiness(requests: DataFrame, completed: DataFrame, declared: DataFrame, courses: DataFrame) -> DataFrame:
    """One row per request: how many prerequisites are unmet, and if it is ready."""
    unmet = (
        unmet_prerequisites(requests, completed, declared, courses)
        .groupBy("student_id", "course_id")
        .agg(F.count(F.lit(1)).alias("n_unmet"))
    )
    checked = course_exists(requests.select("student_id", "course_id").distinct(), courses, declared)
    n_unmet = F.coalesce("n_unmet", F.lit(0))
    return checked.join(unmet, ["student_id", "course_id"], "left").select(
        "student_id", "course_id", n_unmet.alias("n_unmet"),
        ((n_unmet == 0) & (F.col("status") == "ok")).alias("ready"), "status",
    )


def course_units(aligned: DataFrame) -> DataFrame:
    """(course, unit) with mean and best confidence, combined before shuffling."""
    return aligned.groupBy("course_id", "ku_id").agg(
        F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence")
    )


def course_concepts(aligned: DataFrame, units: DataFrame) -> DataFrame:
    """One row per aligned concept, with the label and area of its unit."""
    return aligned.join(units, "ku_id").select(
        "course_id", "concept_id", "ku_id",
        F.coalesce("label", F.lit("")).alias("ku_label"),
        F.coalesce("knowledge_area", F.lit("")).alias("knowledge_area"),
        "confidence",
    )


def covered_units(query_course: DataFrame, aligned: DataFrame) -> DataFrame:
    """(query_id, ku_id) covered by any course of the query's set."""
    pairs = aligned.select("course_id", "ku_id").distinct()
    return query_course.select("query_id", "course_id").distinct().join(pairs, "course_id").select(
        "query_id", "ku_id"
    ).distinct()


def course_detail(courses: DataFrame, aligned: DataFrame, units: DataFrame, declared: DataFrame,
                  unlocks: DataFrame) -> DataFrame:
    """Everything known about each course, one row per fact.

    Sections: concept (unit, mean confidence to 3 places), prerequisite, unlock.
    Rows, not arrays, so that a hub course does not become one giant record.
    """
    concept = course_units(aligned).join(units, "ku_id").select(
        "course_id", F.lit("concept").alias("section"), F.col("ku_id").cast("string").alias("item_id"),
        "label", F.col("knowledge_area").alias("note"), F.round("mean_confidence", 3).alias("confidence"),
    )
    titles = courses.select(F.col("course_id").alias("item"), "title")
    prereq = declared.withColumnRenamed("prereq_id", "item").join(titles, "item", "left").select(
        "course_id", F.lit("prerequisite").alias("section"), F.col("item").cast("string").alias("item_id"),
        F.coalesce("title", F.lit("")).alias("label"), F.coalesce("verbatim", F.lit("")).alias("note"),
        F.lit(None).cast("double").alias("confidence"),
    )
    unlocked = unlocks.withColumnRenamed("unlocks", "item").join(titles, "item", "left").select(
        "course_id", F.lit("unlock").alias("section"), F.col("item").cast("string").alias("item_id"),
        F.coalesce("title", F.lit("")).alias("label"), F.lit("").alias("note"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return concept.unionByName(prereq).unionByName(unlocked)


PACK = 64


def _packed_units(units_of: DataFrame) -> DataFrame:
    """(course_id, units): a course's units as rows of at most PACK, so that a hub course does not become one giant record."""
    place = F.row_number().over(W.partitionBy("course_id").orderBy("ku_id"))
    return (
        units_of.withColumn("pack", F.floor((place - 1) / PACK)).groupBy("course_id", "pack")
        .agg(F.collect_list(F.struct(*[c for c in units_of.columns if c != "course_id"])).alias("units")).drop("pack")
    )


def _overlap_rows(requests: DataFrame, completed: DataFrame, units_of: DataFrame, outer: bool = False) -> DataFrame:
    """The columns of `requests` and `units_of` with `matched` for each unit of each target; `outer` keeps requests
    without units, as a row where `matched` is null.

    A student's coverage of a unit is kept as the smallest and largest covering
    course: the target itself is the only cover exactly when both equal it. Courses carry their units to the students in
    packs, and these are opened where all rows of a student lie; single units never travel.
    """
    key = ["student_id", "course_id"]
    told = [c for c in requests.columns if c not in key]
    asked = requests.select(*key, *told, F.lit(True).alias("asked"), F.lit(False).alias("done"))
    taken = completed.filter(F.col("student_id").isNotNull()).select(*key, F.lit(False).alias("asked"), F.lit(True).alias("done"))
    pairs = asked.unionByName(taken, allowMissingColumns=True).groupBy(*key).agg(
        *[F.max(c).alias(c) for c in told], F.bool_or("asked").alias("asked"), F.bool_or("done").alias("done"))
    packs = _packed_units(units_of).withColumnRenamed("course_id", "of_course")
    fields = [c for c in units_of.columns if c != "course_id"]
    slim = F.transform("units", lambda u: F.struct(
        u["ku_id"].alias("ku_id"), *[F.when(F.col("asked"), u[c]).alias(c) for c in fields if c != "ku_id"]))
    of_course = (F.col("course_id") == F.col("of_course")) & F.col("student_id").isNotNull() if outer else F.col("course_id") == F.col("of_course")
    met = pairs.join(packs, of_course, "left" if outer else "inner").select(
        *key, *told, "asked", "done", slim.alias("units")).repartition("student_id")
    opened = (F.explode_outer if outer else F.explode)("units").alias("u")
    rows = met.select(*key, *told, "asked", "done", opened).withColumn("present", F.col("u").isNotNull()).select(
        *key, *told, "asked", "done", "present", "u.*")
    same = W.partitionBy("student_id", "ku_id")
    cover = F.when(F.col("done") & F.col("ku_id").isNotNull(), F.col("course_id"))
    by_other = (F.col("first_cover") != F.col("course_id")) | (F.col("last_cover") != F.col("course_id"))
    return rows.withColumn("first_cover", F.min(cover).over(same)).withColumn("last_cover", F.max(cover).over(same)).filter("asked").select(
        *key, *told, *fields, F.when(F.col("present"), F.coalesce(by_other, F.lit(False))).alias("matched"))


def _best_units(aligned: DataFrame) -> DataFrame:
    """(course_id, ku_id, max_confidence), lying by course."""
    return aligned.select("course_id", "ku_id", "confidence").repartition("course_id").groupBy("course_id", "ku_id").agg(
        F.max("confidence").alias("max_confidence"))


def overlap_units(requests: DataFrame, completed: DataFrame, aligned: DataFrame) -> DataFrame:
    """Units of each target course, marked covered by other completed courses."""
    return _overlap_rows(requests.select("student_id", "course_id"), completed, _best_units(aligned))


def overlap(requests: DataFrame, completed: DataFrame, aligned: DataFrame, courses: DataFrame,
            declared: DataFrame | None = None) -> DataFrame:
    """Per request: matched and missing units, mean confidence of the matched."""
    checked = course_exists(requests.select("student_id", "course_id"), courses, declared)
    return _overlap_rows(checked, completed, _best_units(aligned), outer=True).groupBy("student_id", "course_id").agg(
        F.max("status").alias("status"), F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_gap"),
        F.round(F.coalesce(F.avg(F.when(F.col("matched"), F.col("max_confidence"))), F.lit(0.0)), 3).alias("confidence"),
    )


# --- requests for single courses --------------------------------------------

def _requested(requests: DataFrame, courses: DataFrame, declared: DataFrame) -> DataFrame:
    """(course_id, status, status_message), one row per requested course."""
    asked = course_exists(requests.select("course_id").distinct(), courses, declared)
    message = F.format_string(K.STATUS_COURSE_NOT_FOUND, F.col("course_id").cast("string"))
    return asked.withColumn("status_message", F.when(F.col("status") == "course_not_found", message).otherwise(F.lit("")))


def requested_unlocks(requests: DataFrame, declared: DataFrame) -> DataFrame:
    """(course_id, unlocks) for the requested courses: whatever requires them, directly or not.

    The walk starts at the requests, so its size follows them and not the whole catalogue.
    """
    up = declared.select(F.col("prereq_id").alias("src"), F.col("course_id").alias("dst"))
    asked = requests.select("course_id").distinct().select(F.col("course_id").alias("src"), F.col("course_id").alias("at"))
    return bounded_closure(up, seeds=asked).filter("src <> dst").select(
        F.col("src").alias("course_id"), F.col("dst").alias("unlocks"))


def unlock_requests(requests: DataFrame, courses: DataFrame, declared: DataFrame) -> DataFrame:
    """(course_id, status, status_message, unlocks, title): every requested course has a row, with `unlocks` null where it
    opens up nothing or is not known. Stubs have title ''."""
    titles = courses.select(F.col("course_id").alias("unlocks"), "title")
    opened = requested_unlocks(requests, declared).join(titles, "unlocks", "left").withColumn("title", F.coalesce("title", F.lit("")))
    return _requested(requests, courses, declared).join(opened, "course_id", "left").select(
        "course_id", "status", "status_message", "unlocks", "title")


def course_details(requests: DataFrame, courses: DataFrame, aligned: DataFrame, units: DataFrame,
                   declared: DataFrame) -> DataFrame:
    """Everything known about each requested course, one row per fact (see course_detail).

    A row of section `course` carries status, number, subject, level, title (label) and description (note), also for
    courses without any fact, for stubs (all '') and for unknown courses.
    """
    asked = stage(_requested(requests, courses, declared), "requested")
    wanted = asked.filter("status = 'ok'").select("course_id")
    only = lambda rows: rows.join(wanted, "course_id", "left_semi")
    facts = course_detail(courses, only(aligned), units, only(declared), requested_unlocks(wanted, declared))
    text = lambda name: F.coalesce(name, F.lit(""))
    of_course = asked.join(courses, "course_id", "left").select(
        "course_id", "status", "status_message", F.lit("course").alias("section"), F.col("course_id").cast("string").alias("item_id"),
        text("title").alias("label"), text("description").alias("note"), F.lit(None).cast("double").alias("confidence"),
        *[text(c).alias(c) for c in ("course_number", "subject_code", "level")])
    none = {c: F.lit(None).cast("string") for c in ("course_number", "subject_code", "level")}
    return of_course.unionByName(facts.withColumns({"status": F.lit("ok"), "status_message": F.lit(""), **none}))


def overlap_details(requests: DataFrame, completed: DataFrame, aligned: DataFrame, units: DataFrame, courses: DataFrame,
                    declared: DataFrame | None = None) -> DataFrame:
    """Matched and missing units of every request with label and area, one row each; a request for an unknown course
    or one without units has a single row without unit."""
    named = _best_units(aligned).join(
        units.select("ku_id", F.coalesce("label", F.lit("")).alias("ku_label"), F.coalesce("knowledge_area", F.lit("")).alias("knowledge_area")),
        "ku_id").select("course_id", "ku_id", "max_confidence", "ku_label", "knowledge_area")
    checked = course_exists(requests.select("student_id", "course_id"), courses, declared)
    return _overlap_rows(checked, completed, named, outer=True).select(
        "student_id", "course_id", "status", "ku_id", "ku_label", "knowledge_area",
        F.round("max_confidence", 3).alias("confidence"), "matched")


def discover_status(queries: DataFrame, query_ku: DataFrame, matches: DataFrame) -> DataFrame:
    """ok, no_concepts_resolved or no_courses_found for every query."""
    resolved = query_ku.select("query_id").distinct().withColumn("resolved", F.lit(True))
    matched = matches.select("query_id").distinct().withColumn("matched", F.lit(True))
    return (
        queries.select("query_id").distinct()
        .join(resolved, "query_id", "left")
        .join(matched, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("resolved").isNull(), "no_concepts_resolved")
            .when(F.col("matched").isNull(), "no_courses_found").otherwise("ok").alias("status"),
            F.when(F.col("resolved").isNull(), K.STATUS_NO_CONCEPTS)
            .when(F.col("matched").isNull(), K.STATUS_NO_COURSES).alias("status_message"),
        )
    )
