"""Landed catalogue pages to typed courses, rules and declared edges."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.functions import html as H
from kgraph.functions import text as T
from kgraph.functions.once import with_once
from kgraph.session import small_arrow_batches

# --- pages ------------------------------------------------------------------

def course_blocks(pages: DataFrame) -> DataFrame:
    """Every course block of a subject page as one row.

    (url, prefix, number, title, credits, description); a block without a title
    of the expected form is dropped.
    """
    parts = [("p", "courseblocktitle"), ("p", "courseblockdesc")]
    small_arrow_batches(pages.sparkSession)
    blocks = pages.select("url", F.explode(H.blocks("html", ("div", "courseblock"), parts)).alias("parts"))
    titled = with_once(blocks, {
        "title_text": H.joined(F.get("parts", F.lit(0))),
        "description": F.coalesce(H.joined(F.get("parts", F.lit(1))), F.lit("")),
    }).drop("parts")
    group = lambda n: T.found("title_text", K.BLOCK_TITLE, n, "isU")
    return titled.filter(group(0).isNotNull()).select(
        "url", F.upper(group(1)).alias("prefix"), group(2).alias("number"), F.trim(group(3)).alias("title"),
        F.coalesce(group(4).try_cast("double"), F.lit(0.0)).alias("credits"), "description",
    )


def course_pages(pages: DataFrame) -> DataFrame:
    """One raw course per course page; pages without a course code drop out."""
    small_arrow_batches(pages.sparkSession)
    read = with_once(
        pages.withColumn("found", H.elements("html", ["div", "td", "p"])).drop("html"),
        {"page_text": H.text_of(H.first(F.col("found")))},
    )
    block = H.first(H.where("found", lambda e: (e["tag"] == "div") & H.has_class(e, "courseblockdesc")))
    cell = H.first(H.where("found", lambda e: (e["tag"] == "td") & H.has_class(e, "courseblockdesc")))
    long_paragraphs = H.where("found", lambda e: (e["tag"] == "p") & (H.raw_length(e) > 40))
    fallback = F.array_join(F.transform(F.slice(long_paragraphs, 1, 3), lambda e: H.text_of(e)), " ")
    code = lambda n: T.found("page_text", K.COURSE_TITLE, n, "sU")
    credits = F.coalesce(
        *[F.trim(T.found("page_text", p, 0, "iU")) for p in (K.CREDIT_COLON, K.CREDIT_SPAN, K.CREDIT_FIXED)],
        F.when(F.lower("page_text").contains("variable"), "Variable"), F.lit(""),
    )
    number = F.trim(code(2))
    return read.filter(code(0).isNotNull()).select(
        F.trim(code(1)).alias("subject_code"), number.alias("course_number"),
        F.substring(F.trim(F.split_part(F.regexp_replace(code(3), r"(?U)\s+", " "), F.lit("."), F.lit(1))), 1, 200).alias("title"),
        F.coalesce(H.text_of(block), H.text_of(cell), fallback).alias("description"),
        credits.alias("credits_raw"),
        F.coalesce(T.one_space(T.found("page_text", K.PREREQ_TEXT, 1, "isU")), F.lit("")).alias("prereqs_raw"),
        F.transform(T.found_all("page_text", K.CROSS_LISTED, 1, "iU"), lambda x: F.trim(x)).alias("cross_list_raw"),
        F.when(F.substring(number, 1, 1).try_cast("int") >= 5, "Graduate").otherwise("Undergraduate").alias("level_raw"),
        F.col("url").alias("source_url"), "retrieved_at", "source_revision",
    )


def course_slug(course_number) -> Column:
    """Page name of a course: cs and the first three digits of its number."""
    return F.concat(F.lit("cs"), F.substring(F.regexp_replace(course_number, r"\D", ""), 1, 3))


def syllabus_pages(pages: DataFrame) -> DataFrame:
    """(url, number_3, title, description, prerequisite_refs, has_description)
    of syllabus pages; pages without a course heading drop out."""
    small_arrow_batches(pages.sparkSession)
    read = pages.select("url", H.elements("html", ["main", "article", "h1"]).alias("found"))
    tagged = lambda tag: H.first(H.where("found", lambda e: e["tag"] == tag))
    read = read.withColumn("main", F.coalesce(tagged("main"), tagged("article"), H.first(F.col("found"))))
    heading = H.text_of(H.first(H.where("found", lambda e: (e["tag"] == "h1") & H.inside(e, F.col("main")))))
    read = with_once(read, {"heading": heading, "body": H.text_of(F.col("main"), "\n")}).drop("found", "main")
    named = lambda n: T.found("heading", r"^CS\s*(\d{3,5})\s*:?\s*(.*)", n)
    lowered = F.lower("body")
    prereq_at, outline_at = F.instr(lowered, "prerequisite"), F.instr(lowered, "detailed syllabus")
    window = F.when(outline_at > prereq_at, outline_at - prereq_at).otherwise(F.lit(300))
    asked = F.when(prereq_at > 0, F.substring(F.col("body"), prereq_at, window)).otherwise(F.lit(""))
    refs = F.transform(
        T.found_all(asked, r"\bCS\s*(\d{3,5})\b", 1),
        lambda d: F.concat(F.lit("CS-"), F.when(F.length(d) == 3, F.concat(d, F.lit("00"))).otherwise(d)),
    )
    outline = F.when(
        outline_at > 0, H.strip(F.substring(F.col("body"), outline_at + len(K.SYLLABUS_HEAD), F.length("body")))
    ).otherwise(F.lit(""))
    # The outline starts with text, so a marker never stands at its start.
    for marker in K.FOOTER_MARKERS:
        outline = F.substring_index(outline, marker, 1)
    cut = with_once(read.filter(named(0).isNotNull()), {"outline": outline})
    description = F.substring(H.strip(F.regexp_replace("outline", r"\n{2,}", " ")), 1, 4000)
    title = H.strip(named(2))
    return cut.select(
        "url", F.substring(named(1), 1, 3).alias("number_3"),
        F.substring(F.when(title != "", title).otherwise(F.col("heading")), 1, 200).alias("title"),
        description.alias("description"), F.array_distinct(refs).alias("prerequisite_refs"),
        (F.length(H.strip(description)) >= K.MIN_DESCRIPTION_LENGTH).alias("has_description"),
    )


def rule_type(text) -> Column:
    """hours, gpa or courses, the first that fits; null when none does."""
    return (
        F.when(T.found(text, K.HOURS, 0, "iU").isNotNull(), "hours")
        .when(T.found(text, K.GPA, 0, "iU").isNotNull(), "gpa")
        .when(T.found(text, K.COURSE_CODE).isNotNull(), "courses")
    )


def _rule(text: Column) -> Column:
    return F.struct(
        text.alias("verbatim_text"), rule_type(text).alias("rule_type_hint"),
        T.course_refs(text, K.COURSE_CODE).alias("course_refs"),
    )


def programme_pages(pages: DataFrame) -> DataFrame:
    """(url, name, level_raw, requirement_rules) of programme pages.

    Rules are the list items, paragraphs and table rows of the requirement block;
    a page without any has its text lines instead.
    """
    small_arrow_batches(pages.sparkSession)
    read = pages.select("url", H.elements("html", ["h1", "strong", "b", "div", "body", "li", "p", "tr"]).alias("found"))
    named = lambda tag: H.first(H.where("found", lambda e: e["tag"] == tag))
    nonempty = lambda c: F.when(c != "", c)
    name = F.coalesce(
        nonempty(H.text_of(named("h1"), "")), nonempty(H.text_of(F.coalesce(named("strong"), named("b")), ""))
    )
    by_id = lambda i: H.first(H.where("found", lambda e: (e["tag"] == "div") & (e["id"] == i)))
    by_class = H.first(H.where("found", lambda e: (e["tag"] == "div") & H.has_class(e, "tab_content")))
    block = F.coalesce(
        by_id("programrequirementstextcontainer"), by_class, by_id("requirementstextcontainer"), named("body")
    )
    read = with_once(read, {"name": name}).filter(F.col("name").isNotNull()).withColumn("block", block)
    listed = F.filter(
        F.transform(
            H.where("found", lambda e: e["tag"].isin("li", "p", "tr") & H.inside(e, F.col("block"))),
            lambda e: H.text_of(e),
        ),
        lambda x: F.length(x) >= 5,
    )
    lines = F.filter(
        F.transform(F.split(H.text_of(H.first(F.col("found")), "\n"), r"\r?\n"), lambda x: H.strip(x)),
        lambda x: F.length(x) >= 10,
    )
    read = with_once(read, {"listed": F.coalesce(listed, F.array().cast("array<string>"))})
    read = with_once(read, {"texts": F.when(F.size("listed") > 0, F.col("listed")).otherwise(lines)})
    low = F.lower("name")
    undergraduate = low.contains("bachelor") | low.contains("b.s.") | low.contains("bs ") | low.contains("undergraduate")
    return read.select(
        "url", F.substring("name", 1, 300).alias("name"),
        F.when(undergraduate, "Undergraduate").otherwise("Graduate").alias("level_raw"),
        F.transform("texts", _rule).alias("requirement_rules"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, pos, href, link_text) of every link with a target."""
    small_arrow_batches(pages.sparkSession)
    links = H.where(H.elements("html", ["a"]), lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    return pages.select("url", F.posexplode(links).alias("pos", "a")).select(
        "url", "pos", F.col("a.href").alias("href"), H.text_of(F.col("a"), "").alias("link_text")
    )


def newest_catalogue(links: DataFrame) -> DataFrame:
    """One row with the highest catalogue id that any link names."""
    ids = T.found("href", r"catoid=(\d+)", 1).try_cast("bigint")
    return links.agg(F.max(ids).alias("catoid"))


def course_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("href").contains("preview_course_nopop.php")).select(
        "url", T.found("href", r"catoid=(\d+)", 1).alias("catoid"), T.found("href", r"coid=(\d+)", 1).alias("coid"), "href",
    ).filter(F.col("catoid").isNotNull() & F.col("coid").isNotNull())


def programme_links(links: DataFrame, keywords: str = r"computer\s+science|cs\b") -> DataFrame:
    """Links to programme pages whose text names the discipline."""
    return links.filter(
        F.col("href").contains("content.php") & F.col("href").contains("navoid")
        & F.col("link_text").rlike(f"(?iU){keywords}")
    ).select(
        "url", T.found("href", r"catoid=(\d+)", 1).alias("catoid"), T.found("href", r"navoid=(\d+)", 1).alias("navoid"), "href",
    ).filter(F.col("catoid").isNotNull() & F.col("navoid").isNotNull())


# --- prerequisite text ------------------------------------------------------

def prose_refs(description) -> Column:
    """Course references of the prerequisite sentence, first mention first."""
    sentence = F.coalesce(*[T.found(description, p, 1, "iU") for p in K.PREREQUISITE_PROSE], F.lit(""))
    return F.array_distinct(T.course_refs(sentence, K.SHORT_COURSE_CODE))


RULE = "struct<machine_checkable:boolean,verbatim_text:string,structured:string,refs:array<string>>"
# "and"/"or" also count at the end of a longer word; other text is skipped.
_TOKEN = re.compile(
    r"(?P<grade>\((?P<mark>[A-Da-d][+-]?)\s+[oO][rR]\s+[bB][eE][tT][tT][eE][rR]\))|(?P<open>\()|(?P<close>\))"
    r"|(?P<course>\b(?P<subject>[A-Z]{2,5})\s+(?P<number>\d{5}[A-Z]?)\b)|(?P<and>[aA][nN][dD]\b)|(?P<or>[oO][rR]\b)"
)
_WORD = re.compile(r"[^\W\d_]+")


def _fold(level: dict):
    items = level["items"]
    return items[0] if len(items) == 1 else {"op": level["op"], "children": items}


def _predicate(text: str, strict: bool):
    """(tree, refs) of a prerequisite text, or None if it is not a rule.

    Levels of parentheses are kept on a stack; each holds one operator only.
    """
    levels = [{"op": None, "items": []}]
    refs: list[str] = []
    want_operand, gradable, end = True, None, 0
    for token in _TOKEN.finditer(text):
        if strict and _WORD.search(text[end:token.start()]):
            return None
        end = token.end()
        kind = token.lastgroup if token.lastgroup in ("grade", "open", "close", "and", "or") else (
            "course" if token["course"] else "grade"
        )
        if want_operand and kind == "open":
            levels.append({"op": None, "items": []})
        elif want_operand and kind == "course":
            gradable = {"course_id": f"{token['subject']}-{token['number']}", "min_grade": None}
            refs.append(gradable["course_id"])
            levels[-1]["items"].append(gradable)
            want_operand = False
            continue
        elif not want_operand and kind == "grade" and gradable is not None:
            gradable["min_grade"] = token["mark"]
        elif not want_operand and kind in ("and", "or") and levels[-1]["op"] in (None, kind):
            levels[-1]["op"] = kind
            want_operand = True
        elif not want_operand and kind == "close" and len(levels) > 1:
            inner = _fold(levels.pop())
            levels[-1]["items"].append(inner)
        else:
            return None
        gradable = None
    if want_operand or len(levels) > 1 or (strict and _WORD.search(text[end:])):
        return None
    return _fold(levels[0]), refs


def prerequisite_rule(verbatim: Column | str, strict: bool = False) -> Column:
    """Struct (machine_checkable, verbatim_text, structured, refs) of a text.

    `structured` is the predicate tree as JSON, `refs` its courses in order.
    `strict` also refuses texts with words outside the grammar.
    """
    @F.pandas_udf(RULE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            tree = _predicate(text, strict) if text else None
            rows.append((
                tree is not None, text or "(empty)", json.dumps(tree[0]) if tree else None, tree[1] if tree else []
            ))
        return pd.DataFrame(rows, columns=["machine_checkable", "verbatim_text", "structured", "refs"])

    return parse(verbatim)


def prerequisite_refs(rules: DataFrame) -> DataFrame:
    """(course_id, rule_pos, ref_pos, ref, verbatim_text): one row per reference.

    `rules` is (course_id, rule_pos, rule); operators between the references are
    ignored and repeats are kept.
    """
    return rules.select(
        "course_id", "rule_pos", F.col("rule.verbatim_text").alias("verbatim_text"),
        F.posexplode("rule.refs").alias("ref_pos", "ref"),
    )


def first_wording(refs: DataFrame) -> DataFrame:
    """(course_id, ref, verbatim): the first non-empty wording of each reference."""
    wording = F.when(F.col("verbatim_text") != "", F.col("verbatim_text"))
    return refs.groupBy("course_id", "ref").agg(
        F.coalesce(F.min_by(wording, F.when(wording.isNotNull(), F.struct("rule_pos", "ref_pos"))), F.lit("")).alias("verbatim")
    )


# --- normalisation ----------------------------------------------------------

def credits(raw) -> Column:
    """Struct (min, max): (0,0) when variable or unknown, a range, one number,
    or 3 when nothing can be read."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    span = lambda n: T.found(raw, r"(\d+(?:\.\d+)?)\s+to\s+(\d+(?:\.\d+)?)", n, "iU").try_cast("double")
    single = T.found(raw, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    pair = lambda low, high: F.struct(low.alias("min"), high.alias("max"))
    return (
        F.when(raw.isNull() | (raw == "") | F.lower(raw).contains("variable"), pair(F.lit(0.0), F.lit(0.0)))
        .when(span(1).isNotNull(), pair(span(1), span(2)))
        .when(single.isNotNull(), pair(single, single))
        .otherwise(pair(F.lit(K.DEFAULT_CREDITS), F.lit(K.DEFAULT_CREDITS)))
    )


def level_from_word(raw) -> Column:
    return F.when(F.lower(F.trim(raw)) == "graduate", "graduate").otherwise("undergraduate")


def level_from_number(number) -> Column:
    """Three-digit catalogues: 500 and above is graduate."""
    return F.when(F.trim(number).try_cast("int") >= 500, "graduate").otherwise("undergraduate")


def level_from_first_digit(number) -> Column:
    """Five-digit catalogues: a first digit of 5 and above is graduate."""
    return F.when(F.substring(number, 1, 1).try_cast("int") >= 5, "graduate").otherwise("undergraduate")


def provenance(url, retrieved_at, adapter: str, version: str, revision=None) -> Column:
    return F.struct(
        url.alias("source_url"), retrieved_at.alias("retrieved_at"), F.lit(adapter).alias("adapter_name"),
        F.lit(version).alias("adapter_version"),
        (F.lit(None).cast("string") if revision is None else revision).alias("source_revision"),
    )


def normalise_courses(raw: DataFrame, adapter: str, version: str) -> DataFrame:
    """Raw courses to typed courses with their rule and cross-listing ids."""
    course_id = F.concat("subject_code", F.lit("-"), "course_number")
    cross = F.filter(
        F.transform("cross_list_raw", lambda x: F.get(T.course_refs(x, K.COURSE_CODE), F.lit(0))),
        lambda x: x.isNotNull(),
    )
    rule = prerequisite_rule("prereqs_raw")
    return raw.withColumn("rule", rule).select(
        course_id.alias("course_id"), F.lit("derived").alias("authority"), "subject_code", "course_number", "title",
        "description", credits("credits_raw").alias("credits"), level_from_word("level_raw").alias("level"),
        cross.alias("cross_listings"),
        F.when(
            F.coalesce(F.col("prereqs_raw"), F.lit("")) != "",
            F.struct(F.concat(F.lit("prereq-"), course_id).alias("rule_id"), "rule.*"),
        ).alias("prerequisite_rule"),
        provenance(F.col("source_url"), F.col("retrieved_at"), adapter, version, F.col("source_revision")).alias("provenance"),
    )


def declared_edges(courses: DataFrame) -> DataFrame:
    """Prerequisite and cross-listing edges of normalised courses.

    Edge ids are built from their ends, and a position where a reference repeats.
    """
    refs = F.coalesce("prerequisite_rule.refs", F.array().cast("array<string>"))
    tagged = lambda items, kind: F.transform(items, lambda x, i: F.struct(x.alias("to_id"), i.alias("pos"), F.lit(kind).alias("kind")))
    ends = F.concat(tagged(refs, "prerequisite"), tagged(F.col("cross_listings"), "cross_listing"))
    edge_id = F.when(
        F.col("e.kind") == "prerequisite", F.concat_ws("-", F.lit("prereq"), "course_id", "e.to_id", "e.pos")
    ).otherwise(F.concat_ws("-", F.lit("crosslist"), "course_id", "e.to_id"))
    return courses.select("course_id", "provenance", F.explode(ends).alias("e")).select(
        edge_id.alias("edge_id"), F.col("course_id").alias("from_id"), F.col("e.to_id").alias("to_id"),
        F.col("e.kind").alias("relationship_type"), "provenance",
    )


def block_courses(blocks: DataFrame, retrieved_at: Column, adapter: str, version: str) -> DataFrame:
    """Course blocks to typed courses; each prose reference is a rule of its own."""
    course_id = F.concat("prefix", F.lit("-"), "number")
    return blocks.select(
        course_id.alias("course_id"), F.lit("derived").alias("authority"), F.col("prefix").alias("subject_code"),
        F.col("number").alias("course_number"), "title", "description",
        F.struct(F.col("credits").alias("min"), F.col("credits").alias("max")).alias("credits"),
        level_from_number("number").alias("level"), F.array().cast("array<string>").alias("cross_listings"),
        prose_refs("description").alias("prerequisite_refs"),
        provenance(F.col("url"), retrieved_at, adapter, version).alias("provenance"),
    )


def reference_edges(courses: DataFrame) -> DataFrame:
    """One prerequisite edge per entry of `prerequisite_refs`."""
    return courses.select("course_id", "provenance", F.explode("prerequisite_refs").alias("to_id")).select(
        F.concat_ws("-", F.lit("prereq"), "course_id", "to_id").alias("edge_id"),
        F.col("course_id").alias("from_id"), "to_id", F.lit("prerequisite").alias("relationship_type"), "provenance",
    )


def normalise_programmes(raw: DataFrame, adapter: str, version: str, department: str = "Computer Science") -> DataFrame:
    """Raw programmes to typed ones; a programme without rules gets a placeholder."""
    kind = lambda r: (
        F.when(r["rule_type_hint"] == "hours", "minimum_credits").when(r["rule_type_hint"] == "gpa", "gpa_minimum")
        .when(r["rule_type_hint"] == "courses", "course_list").otherwise("other")
    )
    rule = lambda number, rule_type_, text: F.struct(
        F.concat(F.lit("rule-"), number.cast("string")).alias("rule_id"), rule_type_.alias("rule_type"),
        text.alias("verbatim_text"), F.lit(False).alias("machine_checkable"),
        F.lit(None).cast("string").alias("structured_predicate"),
    )
    rules = F.transform("requirement_rules", lambda r, i: rule(i, kind(r), r["verbatim_text"]))
    placeholder = F.array(rule(F.lit(0), F.lit("other"), F.lit("(no structured requirements found)")))
    slug = F.replace(F.lower(F.substring("name", 1, 40)), F.lit(" "), F.lit("-"))
    return raw.select(
        F.concat(F.lit("prog-"), slug, F.lit("-"), F.substring(F.sha2("url", 256), 1, 6)).alias("programme_id"),
        F.lit("derived").alias("authority"), "name", level_from_word("level_raw").alias("level"),
        F.lit(department).alias("department"), F.col("url").alias("catalogue_url"),
        F.when(F.size("requirement_rules") > 0, rules).otherwise(placeholder).alias("requirement_rules"),
        provenance(F.col("url"), F.col("retrieved_at"), adapter, version, F.col("source_revision")).alias("provenance"),
    )


def requirement_rules(programmes: DataFrame) -> DataFrame:
    return programmes.select("programme_id", F.explode("requirement_rules").alias("r")).select("programme_id", "r.*")


# --- second sources ---------------------------------------------------------

def cross_check(courses: DataFrame, second: DataFrame) -> DataFrame:
    """Courses unchanged, with a flag where a second source (course_number,
    description) tells a different description. The first source always wins."""
    other = second.filter(F.coalesce("description", F.lit("")) != "").groupBy("course_number").agg(
        F.max("description").alias("second_description")
    )
    differs = H.strip("second_description") != H.strip("description")
    return courses.join(other, "course_number", "left").withColumn(
        "mismatch", F.coalesce(differs, F.lit(False))
    ).drop("second_description")


def first_by_number(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per non-empty number, the first by `pos`, sorted by number."""
    rest = [c for c in listing.columns if c not in ("number", "pos")]
    unique = (
        listing.filter(F.coalesce("number", F.lit("")) != "")
        .groupBy("number").agg(F.min(F.struct("pos", *rest)).alias("first"))
        .select("number", *[F.col(f"first.{c}").alias(c) for c in rest]).orderBy("number")
    )
    return unique.limit(limit) if limit else unique


def merge_spine(spine: DataFrame, enrichment: DataFrame, base_url: str, subject: str = "CS") -> DataFrame:
    """The authoritative list, enriched by syllabus pages found by slug.

    A page's title wins over the list's, and the number stands in for both; the
    description comes from the page only, and the source is the page when it has one.
    Of several pages with one slug the first by url counts, so a course stays one row.
    """
    facts = F.struct("url", *[c for c in enrichment.columns if c not in ("url", "number_3")])
    single = enrichment.groupBy("number_3").agg(F.min_by(facts, F.struct("url", F.xxhash64(facts))).alias("page"))
    pages = single.select("number_3", "page.*").select(
        F.concat(F.lit("cs"), "number_3").alias("slug"), F.col("title").alias("page_title"),
        F.col("description").alias("page_description"), "prerequisite_refs", "has_description",
        F.col("url").alias("page_url"),
    )
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    return (
        spine.withColumn("slug", course_slug("number")).join(pages, "slug", "left")
        .select(
            F.concat(F.lit(f"{subject}-"), "number").alias("course_id"), F.lit(subject).alias("subject_code"),
            F.col("number").alias("course_number"),
            F.coalesce(given("page_title"), given("title"), F.col("number")).alias("title"),
            F.coalesce("page_description", F.lit("")).alias("description"),
            F.struct(
                F.coalesce("credit_hours", F.lit(0.0)).alias("min"), F.coalesce("credit_hours", F.lit(0.0)).alias("max")
            ).alias("credits"),
            level_from_first_digit("number").alias("level"),
            F.coalesce("prerequisite_refs", F.array().cast("array<string>")).alias("prerequisite_refs"),
            F.when(F.col("has_description"), F.col("page_url")).otherwise(f"{base_url}/Courses").alias("source_url"),
        )
    )


def union_pages(*tables: DataFrame) -> DataFrame:
    """Subject pages of several landings as one table."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


# --- outcomes ---------------------------------------------------------------

def ingest_summary(outcomes: DataFrame, alarm_pct: float = K.INGEST_FAILURE_ALARM_PCT) -> DataFrame:
    """One row from (status, reason, machine_checkable): counts by outcome, rules
    by kind, failure rate in percent and whether it is above the alarm."""
    status = F.col("status")
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("courses_attempted"), F.count_if(status == "succeeded").alias("courses_succeeded"),
        F.count_if(status == "failed").alias("courses_failed"), F.count_if(status == "skipped").alias("courses_skipped"),
        F.count_if((status == "succeeded") & F.col("machine_checkable")).alias("prereqs_structured"),
        F.count_if((status == "succeeded") & ~F.col("machine_checkable")).alias("prereqs_unstructured"),
    )
    rate = F.when(
        F.col("courses_attempted") > 0, F.col("courses_failed") / F.col("courses_attempted") * 100
    ).otherwise(F.lit(0.0))
    return counts.withColumn("failure_rate_pct", rate).withColumn("alarm", F.col("failure_rate_pct") > alarm_pct)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def described(courses: DataFrame, min_length: int = K.MIN_DESCRIPTION_LENGTH) -> DataFrame:
    """Courses whose description is long enough to extract concepts from."""
    return courses.filter(F.length(H.strip(F.coalesce("description", F.lit("")))) >= min_length)


# --- concept payloads -------------------------------------------------------

def _variant_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def concept_items(payload: Column | str) -> Column:
    """The list of concept items in a JSON payload, null when it has none.

    A list; the first known key that holds a list; a single labelled object; the
    only list under any key; an empty object, which means no concepts.
    """
    raw = F.col(payload) if isinstance(payload, str) else payload
    whole = F.try_parse_json(F.when(F.coalesce(raw, F.lit("")) == "", F.lit("{}")).otherwise(raw))
    as_list = lambda path: F.try_variant_get(whole, path, "array<variant>")
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    labelled = F.when(
        F.startswith(_variant_kind(F.try_variant_get(whole, "$.label", "variant")), F.lit("STRING")), F.array(whole)
    )
    lists = F.filter(F.map_values(fields), lambda v: F.startswith(_variant_kind(v), F.lit("ARRAY")))
    only = F.when(F.size(lists) == 1, F.try_variant_get(F.get(lists, F.lit(0)), "$", "array<variant>"))
    empty = F.when(F.size(fields) == 0, F.array().cast("array<variant>"))
    return F.coalesce(as_list("$"), *[as_list(f"$.{k}") for k in K.CONCEPT_LIST_KEYS], labelled, only, empty)


def concept_labels(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(concepts, rejected) from rows with `course_id` and a JSON payload.

    Concepts are (course_id, pos, label), trimmed and non-empty. A payload
    without a list, or with an object whose label is no text, is rejected whole.
    """
    items = with_once(payloads, {"items": concept_items(payload)})
    is_object = lambda v: F.startswith(_variant_kind(v), F.lit("OBJECT"))
    is_text = lambda v: F.startswith(_variant_kind(v), F.lit("STRING"))
    inner = lambda v: F.try_variant_get(v, "$.label", "variant")
    odd = F.exists("items", lambda v: is_object(v) & inner(v).isNotNull() & ~is_text(inner(v)))
    items = items.withColumn("bad", F.col("items").isNull() | F.coalesce(odd, F.lit(False)))
    label = lambda v: F.when(is_object(v), F.try_variant_get(v, "$.label", "string")).when(
        is_text(v), F.try_variant_get(v, "$", "string")
    )
    concepts = (
        items.filter("not bad").select("course_id", F.posexplode(F.transform("items", label)).alias("pos", "label"))
        .withColumn("label", H.strip("label")).filter("label <> ''")
    )
    return concepts, items.filter("bad").select("course_id", F.col(payload).alias("payload"))
