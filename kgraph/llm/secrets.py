"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is any run of characters inside a word that has the shape of a credential: at least LENGTH characters with a
digit, or at least SHORTEST behind a name that tells of one. A word may hold several (compact JSON, URLs, delimited lists).
Behind a telling name, within the word or before it, a run has whatever signs there are up to its closing quote, or without
quotes up to one of , ; & | < > ( ) [ ] { } or a quote, less punctuation at the end; the password of `scheme://user:password@`
reaches to the last @; elsewhere a run has letters, digits and + / _ . -. Names are read back for up to 64 characters. The
words before a word belong to its first run, the word after it to its last. The forest sees

* length and the shares of digits, capitals, small letters and signs, distinct characters, hexadecimal or not;
* character transitions: how often neighbouring characters change between letter, digit, capital, sign;
* dictionary coverage: the share of the candidate that consists of words of the corpus (runs of letters that occur in at
  least DICTIONARY_DOCUMENTS documents, counted over all documents);
* the path: words such as test or example in it, its depth;
* neighbouring words: credential words and decoy words in the name, among the three words before and the one after, and
  whether a sign of assignment stands before the candidate.

It is trained on labelled findings (LABELLED of each label at most, picked by hash of their content). The registered
query labels findings by published formats and by contexts that leave no doubt, and leaves the others to the forest.

Only DataFrame functions and the library's own forest are used: no Python runs in the tasks. Documents without a
candidate never leave their partition. Findings that are equal in all features' inputs are scored once.

Defined cases: null and empty texts have no candidates; a null path has no path features; repeated rows have the same
findings each; without labelled findings of both labels there is no forest, and a finding counts as a secret only if it is
labelled one (score 1, others 0); an empty table gives an empty result; further columns of any name and type are kept by `mask`.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.functions.once import with_once
from kgraph.llm.common import clean_text, quoted, table
from kgraph.sources.staging import stage

LENGTH, SHORTEST = 12, 8
LABELLED = 4000
TREES, DEPTH, SEED = 24, 8, 10
DICTIONARY_DOCUMENTS = 5
#: Shortest and longest run of letters that counts as a word of the dictionary.
WORD_LENGTHS = (3, 24)
MASK = "[secret]"

CREDENTIAL_WORDS = "pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private_?key|auth(orization)?|credentials?|bearer|aws"
DECOY_WORDS = (
    "example|sample|dummy|fake|placeholder|changeme|phone|tel|fax|card|order|invoice|isbn|doi|uuid|guid|commit|sha1|sha256|"
    "md5|checksum|hash|version|build|serial"
)
PATH_WORDS = "test|spec|example|sample|fixture|mock|docs?|vendor|third_party"
_NAME = r"[A-Za-z][A-Za-z0-9_.\-]{0,63}"
_TELLING = r"[A-Za-z0-9_.\-]{0,64}(?<![A-Za-z])(?i:%s)(?![A-Za-z])[A-Za-z0-9_.\-]{0,64}" % CREDENTIAL_WORDS.replace("(", "(?:")
_SIGN = r"""["'`\\)\]]*[=:]+>?"""
_ENDS = r"""\s"'`\\,;&|<>()\[\]{}"""
_QUOTED = "|".join(r"\\*%s([^%s\s]{%d,}[^%s\s\\])\\*%s" % (q, q, SHORTEST - 1, q, q) for q in "\"'`")
#: All runs of a word: (scheme://user, password), (name or tag, value in one of three quotes or in none), (name or tag, value).
#: A sign of assignment that begins the word stands for a telling name before it.
_RUN = (
    r"""([A-Za-z][A-Za-z0-9+.\-]{0,31}://[^\s/?#:@"'<>]{0,64}):([^\s/?#"'<>]{%d,})@""" % SHORTEST
    + rf"""|(?:({_TELLING}){_SIGN}|<({_TELLING})>|^=(?!["'`\\(\[<{{]*{_NAME}["'`\\]*[=:][^=]))[(\[{{]*"""
    + rf"""(?:{_QUOTED}|["'`\\]*([^{_ENDS}]{{{SHORTEST - 1},}}[^{_ENDS}.:!?]))"""
    + rf"""|(?:({_NAME}){_SIGN}["'`\\(\[{{]*|<({_NAME})>)?([A-Za-z0-9+/_.\-]{{{SHORTEST - 1},}}[A-Za-z0-9+/_\-]={{0,2}})"""
)
_NAMES, _VALUES = (1, 3, 4, 9, 10), (2, 5, 6, 7, 8, 11)
CONTEXT = ["value", "name", "before", "after", "path"]
FEATURES = [
    "length", "digits", "capitals", "small", "signs", "distinct", "hexadecimal", "letter_digit", "small_capital", "sign_changes",
    "coverage", "longest_run", "path_words", "path_depth", "credential_words", "decoy_words", "assigned",
]


def _words_match(words: str, text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z])({words})(?![a-z])"))


def _telling(name: Column, before: Column) -> Column:
    """How often a name, or words before that end in a sign of assignment, tell of a credential."""
    assigned = F.concat_ws(" ", name, F.when(_assigns(before), before))
    return _words_match(CREDENTIAL_WORDS, assigned) + name.contains("://").cast("int")


def _assigns(before: Column) -> Column:
    return before.rlike("[=:]>?$")


def candidates(words: Column) -> Column:
    """array<struct<position, value, name, before, after>> of the runs in the words of a text; `words` must be a column,
    since it is read at every word and an expression would be computed as often."""

    def shaped(word: Column, place: Column) -> Column:
        before = F.concat_ws(" ", *[F.get(words, place - k) for k in (3, 2, 1)])
        told = F.when(_telling(F.lit(""), before) > 0, "=").otherwise("")
        runs = F.regexp_extract_all(F.concat(told, word), F.lit(_RUN), F.lit(0))

        def part(run: Column, groups: tuple[int, ...]) -> Column:
            return F.concat(*[F.regexp_extract(run, _RUN, k) for k in groups])

        def each(found: Column) -> Column:
            return F.transform(found, lambda run, i: F.struct(
                place.alias("position"), part(run, _VALUES).alias("value"), part(run, _NAMES).alias("name"),
                F.when(i == 0, before).otherwise("").alias("before"),
                F.when(i == F.size(found) - 1, F.coalesce(F.get(words, place + 1), F.lit(""))).otherwise("").alias("after")))

        return F.flatten(F.transform(F.array(runs), each))  # bound by a lambda, so that the runs are found once

    def kept(c: Column) -> Column:
        long = (F.length(c["value"]) >= LENGTH) & c["value"].rlike("[0-9]")
        return (F.length(c["value"]) >= SHORTEST) & (long | (_telling(c["name"], c["before"]) > 0))

    # cheap conditions first: most words are shorter, or have neither digit nor sign nor a sign before them
    def likely(word: Column, place: Column) -> Column:
        signed = word.rlike("[0-9=:>]") | _assigns(F.get(words, place - 1))
        return (F.length(word) >= SHORTEST) & F.coalesce(signed, F.lit(False))

    places = F.filter(F.transform(words, lambda w, i: F.when(likely(w, i), i)), lambda i: i.isNotNull())
    return F.filter(F.flatten(F.transform(places, lambda i: shaped(F.get(words, i), i))), kept)


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the array `__candidates`."""
    cut = with_once(docs, {"__words": F.split(clean_text(text), r"\s+")})
    return with_once(cut, {"__candidates": candidates(F.col("__words"))}).drop("__words")


def find_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row for each candidate: key, position (word from 0) and CONTEXT."""
    rows = docs.select(F.col(key), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text))
    found = with_candidates(rows, text).select(key, "path", F.explode("__candidates").alias("c"))
    return found.select(key, "c.position", "c.value", "c.name", "c.before", "c.after", "path")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """`word`: runs of letters that occur in at least DICTIONARY_DOCUMENTS documents."""
    shortest, longest = WORD_LENGTHS
    runs = F.filter(
        F.array_distinct(F.split(F.lower(clean_text(text)), "[^a-z]+")), lambda w: F.length(w).between(shortest, longest))
    return docs.select(F.explode(runs).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= DICTIONARY_DOCUMENTS).select("word")


def coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """`value` and the share of its characters that lie in words of the dictionary, for distinct values."""
    shortest, _ = WORD_LENGTHS
    runs = values.select("value", F.explode(F.filter(
        F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= shortest)).alias("word"))
    known = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    return values.join(known, "value", "left").select(
        "value", (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("coverage"))


def add_features(found: DataFrame) -> DataFrame:
    """`found` (CONTEXT and coverage) with FEATURES."""
    value, size = F.col("value"), F.length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    near = F.concat_ws(" ", "name", "before", "after")
    changes = size - 1
    return found.withColumns({
        "length": size.cast("double"),
        "digits": share("[0-9]"), "capitals": share("[A-Z]"), "small": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hexadecimal": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "letter_digit": F.regexp_count(value, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / changes,
        "small_capital": F.regexp_count(value, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / changes,
        "sign_changes": F.regexp_count(value, F.lit("(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / changes,
        "longest_run": F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda r: F.length(r))) / size,
        "path_words": _words_match(PATH_WORDS, F.col("path")).cast("double"),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "credential_words": (_words_match(CREDENTIAL_WORDS, near) + F.col("name").contains("://").cast("int")).cast("double"),
        "decoy_words": _words_match(DECOY_WORDS, F.concat_ws(" ", near, value)).cast("double"),
        "assigned": ((F.col("name") != "") | _assigns(F.col("before"))).cast("double"),
    })


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from distinct findings with FEATURES and `label` (1 secret, 0 not); None without both labels.

    At most LABELLED findings of each label are used, the first by hash of their content.
    """
    order = [F.xxhash64(*CONTEXT), *CONTEXT]
    picked = [labelled.filter(F.col("label") == k).orderBy(*order).limit(LABELLED) for k in (0, 1)]
    sample = stage(picked[0].unionByName(picked[1]).select(*CONTEXT, *FEATURES, F.col("label").cast("double").alias("label")), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", maxMemoryInMB=64)
    # one partition of at most 2 * LABELLED rows in a fixed order: the same forest on any cluster
    return forest.fit(_assembled(sample.repartition(1).sortWithinPartitions(*order)).select("features", "label"))


def known_labels() -> Column:
    """1 or 0 where format and context leave no doubt, else null."""
    value = F.col("value")
    told = (F.col("credential_words") > 0) & (F.col("assigned") == 1) & (F.col("decoy_words") == 0)
    return (
        F.when(value.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") & (F.col("decoy_words") == 0), 1)
        .when(value.rlike("^gh[pousr]_[0-9A-Za-z]{36}$"), 1)
        .when(told & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16) & ~value.contains("."), 1)
        .when(value.rlike("^[0-9.+/_-]+$") & ~told, 0)
        .when((F.col("decoy_words") > 0) & (F.col("credential_words") == 0), 0)
        .when((F.col("coverage") > 0.6) & ~told, 0)
    )


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str = "source",
) -> DataFrame:
    """Every candidate with `score` (probability of a secret) and `is_secret` (score >= 0.5).

    `labelled` has CONTEXT and label; without it findings are labelled by `known_labels`.
    """
    found = stage(find_candidates(docs, key, text, path), "secret-candidates")
    contexts = found.select(*CONTEXT) if labelled is None else found.select(*CONTEXT).unionByName(labelled.select(*CONTEXT))
    distinct = contexts.distinct()
    covered = coverage(distinct.select("value").distinct(), dictionary(docs, text))
    featured = stage(add_features(distinct.join(covered, "value")), "secret-features")
    if labelled is None:
        marked = featured.withColumn("label", known_labels()).filter("label is not null")
    else:
        marked = featured.join(labelled.groupBy(*CONTEXT).agg(F.max("label").alias("label")), CONTEXT)
    model = train(marked)
    if model is None:
        told = marked.select(*CONTEXT, F.col("label").cast("double").alias("score"))
        scored = featured.select(*CONTEXT).join(told, CONTEXT, "left").na.fill(0.0, ["score"])
    else:
        scored = model.transform(_assembled(featured)).select(*CONTEXT, vector_to_array("probability")[1].alias("score"))
    return found.join(scored, CONTEXT).select(
        key, "position", "value", "name", "path", "score", (F.col("score") >= 0.5).alias("is_secret"))


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """`docs` with every secret in `text` replaced by MASK."""
    exact = lambda name: F.col("`" + name.replace("`", "``") + "`")
    named = docs.select(
        F.struct(*quoted(docs.columns)).alias("kept"), F.sha2(clean_text(f"`{text}`"), 256).alias("hash"),
        exact(text).alias("text"), exact(path).alias("path"))
    secrets = scan(named.drop("kept"), None, "hash", "text", "path").filter("is_secret").groupBy("hash").agg(
        F.collect_set("value").alias("secrets"))
    sorted_out = with_candidates(named, "text").withColumn("hit", F.size("__candidates") > 0).drop("__candidates")
    masked = sorted_out.filter("hit").join(secrets, "hash", "left").withColumn("text", F.aggregate(
        F.array_sort(F.coalesce("secrets", F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a)),
        F.col("text"), lambda t, s: F.replace(t, s, F.lit(MASK))))
    columns = [F.col("text").alias(c) if c == text else F.col("kept").getField(c).alias(c) for c in docs.columns]
    return masked.select(*columns).unionByName(sorted_out.filter("not hit").select(*columns))


def op10_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate in the documents with the forest's verdict."""
    return scan(table(spark, folder, "documents").select("doc_id", "text", "source"))


QUERIES = {"op10_secret_forest": (op10_secret_forest, None)}
