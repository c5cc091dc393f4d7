"""Scans, upserts and sinks of the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph import constants as K
from kgraph.operators import validate as V
from kgraph.sources.staging import stage

PROVENANCE = "struct<source_url:string,retrieved_at:timestamp,adapter_name:string,adapter_version:string,source_revision:string>"
RULE = "struct<rule_id:string,verbatim_text:string,machine_checkable:boolean,structured:string>"
COURSE_LINE = (
    f"provenance {PROVENANCE}, course_id string, authority string, subject_code string, course_number string, "
    "title string, description string, credits string, level string, cross_listings array<string>, "
    f"declared_prerequisites array<{RULE}>, _bad string"
)


# --- scans ------------------------------------------------------------------

def typed_credits(raw) -> Column:
    """Struct (min, max) from JSON text that is a number or a range object."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    span = F.from_json(raw, "min_credits double, max_credits double")
    low = F.coalesce(raw.try_cast("double"), span["min_credits"])
    high = F.coalesce(raw.try_cast("double"), span["max_credits"])
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("min"), high.alias("max")))


def read_courses(spark: SparkSession, path: str, subset: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(courses, rejected) of a course JSON-lines folder.

    `subset` (course_id) is applied before anything is parsed further. Lines that
    do not parse or break a course rule are rejected, the others are typed.
    """
    lines = spark.read.schema(COURSE_LINE).option("columnNameOfCorruptRecord", "_bad").json(path)
    if subset is not None:
        lines = lines.join(subset.select("course_id").distinct(), "course_id", "left_semi")
    typed = lines.withColumn("credits", typed_credits("credits")).withColumn(
        "cross_listings", F.coalesce("cross_listings", F.array().cast("array<string>"))
    )
    rules = {
        **V.course_rules(), **V.provenance_rules(),
        "line is not a JSON record": F.col("_bad").isNull(),
        "credits must be a number or a range": F.col("credits").isNotNull(),
        "level is not known": V.within("level", "level"),
        "authority is not known": V.within("authority", "authority"),
        "description must be set": F.col("description").isNotNull(),
    }
    good, bad = V.split_valid(typed, rules)
    return good.drop("_bad"), bad


def tree_refs(structured) -> Column:
    """Course ids of a predicate tree in JSON, in order, repeats kept."""
    return F.regexp_extract_all(structured, F.lit(r'"course_id"\s*:\s*"([^"]+)"'), F.lit(1))


def course_references(courses: DataFrame) -> DataFrame:
    """(course_id, rule_pos, ref_pos, ref, verbatim_text) of all declared rules."""
    rules = courses.select("course_id", F.posexplode("declared_prerequisites").alias("rule_pos", "rule"))
    return rules.select(
        "course_id", "rule_pos", F.coalesce("rule.verbatim_text", F.lit("")).alias("verbatim_text"),
        F.posexplode(tree_refs("rule.structured")).alias("ref_pos", "ref"),
    )


UNIT = "struct<ku_id:string,label:string,knowledge_area:string,knowledge_area_name:string,tier:string,source:string>"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Units of a vocabulary file; every tier but core is elective."""
    whole = spark.read.schema(f"source string, units array<{UNIT}>").option("multiLine", True).json(path)
    return whole.select(F.explode("units").alias("u")).select(
        "u.ku_id", "u.label", "u.knowledge_area",
        F.when(F.col("u.tier") == "core", "core").otherwise("elective").alias("tier"), "u.source",
    )


def named_units(units: DataFrame, area_names: DataFrame) -> DataFrame:
    """Units with the name of their area; an unnamed area keeps its code."""
    return units.join(area_names, "knowledge_area", "left").withColumn(
        "knowledge_area_name", F.coalesce("knowledge_area_name", "knowledge_area")
    )


def vocabulary_counts(units: DataFrame) -> DataFrame:
    return units.agg(
        F.count_distinct("knowledge_area").alias("knowledge_area_count"),
        F.count(F.lit(1)).alias("knowledge_unit_count"),
    )


def write_vocabulary(units: DataFrame, area_names: DataFrame, path: str) -> None:
    """Units as JSON, one folder per area, and their counts beside them."""
    named_units(units, area_names).write.mode("overwrite").partitionBy("knowledge_area").json(f"{path}/units")
    vocabulary_counts(units).write.mode("overwrite").json(f"{path}/counts")


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def odata_courses(payloads: DataFrame, subject: str) -> DataFrame:
    """(subject, id, number, title, description, credit_hours) of landed lists.

    Items whose credit hours are no number are dropped; missing hours stay null.
    `pos` orders the items as they landed: by payload (its `seq` where it has one,
    else the order of the stored rows), then by place in the list.
    """
    item = "struct<Id:string,Number:string,Title:string,Description:string,CreditHours:string>"
    hours = F.col("c.CreditHours").try_cast("double")
    landed = F.col("seq").cast("bigint") if "seq" in payloads.columns else F.monotonically_increasing_id()
    return (
        payloads.select(landed.alias("landed"), F.from_json("payload", f"value array<{item}>").alias("p"))
        .select("landed", F.posexplode("p.value").alias("place", "c"))
        .filter(F.col("c.CreditHours").isNull() | hours.isNotNull())
        .select(
            F.lit(subject).alias("subject"), F.coalesce("c.Id", F.lit("")).alias("id"),
            F.coalesce("c.Number", F.lit("")).alias("number"), F.coalesce("c.Title", F.lit("")).alias("title"),
            F.coalesce("c.Description", F.lit("")).alias("description"), hours.alias("credit_hours"), F.struct("landed", "place").alias("pos"),
        )
    )


def read_query_labels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, area): expected areas of labelled queries."""
    schema = "queries array<struct<query:string,expected_areas:array<string>>>"
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.posexplode("queries").alias("query_id", "q"))
        .select("query_id", "q.query", F.explode("q.expected_areas").alias("area"))
    )


def read_judgements(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(item_id, label); a label outside the domain fails the job when strict."""
    items = (
        spark.read.schema("items array<struct<item_id:string,label:string>>").option("multiLine", True).json(path)
        .select(F.explode("items").alias("i")).select("i.item_id", "i.label")
    )
    rules = {"label is not known": F.coalesce(F.col("label").isin(*K.JUDGEMENT_LABELS), F.lit(False))}
    return V.require_valid(items, rules) if strict else V.split_valid(items, rules)[0]


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(key, part, seed, fraction, ingestion_run_id) of a saved split; a missing
    field fails the job."""
    schema = "train array<string>, test array<string>, seed bigint, fraction double, ingestion_run_id string"
    saved = spark.read.schema(schema).option("multiLine", True).json(path)
    rules = {f"split has no {c}": F.col(c).isNotNull() for c in saved.columns}
    whole = V.require_valid(saved, rules)
    keyed = lambda part: whole.select(
        F.explode(part).alias("key"), F.lit(part).alias("part"), "seed", "fraction", "ingestion_run_id"
    )
    return keyed("train").unionByName(keyed("test"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """A run's one-row summary, None when the run left none."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else None


# --- upserts ----------------------------------------------------------------

def upsert(base: DataFrame, delta: DataFrame, keys: list[str], version: str | None = None,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Base with the rows of delta written over it, one row per key.

    Among delta rows of a key the highest `version` wins. `keep` columns hold
    their base value where the key existed. An aggregate, not a window, so a key
    written many times is combined on the map side.
    """
    names = [c for c in base.columns if c not in keys]
    order = F.struct(F.col("_new"), F.col(version) if version else F.lit(0), *names)
    merged = (
        base.withColumn("_new", F.lit(0))
        .unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*names), order).alias("_row"),
             F.max(F.when(F.col("_new") == 0, F.struct(*(keep or names)))).alias("_old"))
    )
    pick = lambda c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_row.{c}")) if c in keep else F.col(f"_row.{c}")
    return merged.select(*[pick(c).alias(c) if c in names else F.col(c) for c in base.columns])


def upsert_prerequisites(courses: DataFrame, edges: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(courses, edges) after writing (course_id, prereq_id, verbatim) rows.

    Both ends of an edge exist afterwards: unknown ones become stub courses that
    have an id and nothing else.
    """
    written = upsert(edges, delta.select("course_id", "prereq_id", F.coalesce("verbatim", F.lit("")).alias("verbatim")),
                     ["course_id", "prereq_id"])
    ends = delta.select("course_id").unionByName(delta.select(F.col("prereq_id").alias("course_id"))).distinct()
    stubs = ends.join(courses.select("course_id"), "course_id", "left_anti")
    return courses.unionByName(stubs, allowMissingColumns=True), written


def alignment_links(concepts: DataFrame, units: DataFrame) -> DataFrame:
    """(concept_id, ku_id, confidence, model_id) of aligned concepts whose unit exists."""
    return (
        concepts.filter((F.col("alignment_status") == "aligned") & F.col("knowledge_unit_id").isNotNull())
        .join(units.select(F.col("ku_id").alias("knowledge_unit_id")), "knowledge_unit_id", "left_semi")
        .select("concept_id", F.col("knowledge_unit_id").alias("ku_id"), "confidence", "model_id")
    )


def upsert_concepts(concepts: DataFrame, links: DataFrame, delta: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts, alignment links) after writing delta."""
    return (
        upsert(concepts, delta.select(*concepts.columns), ["concept_id"]),
        upsert(links, alignment_links(delta, units), ["concept_id", "ku_id"]),
    )


def skip_existing(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work that is not done yet; all of it when forced."""
    return work if force else work.join(done.select(*keys).distinct(), keys, "left_anti")


def connected_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges both of whose ends are known concepts."""
    known = concepts.select("concept_id").distinct()
    return edges.join(known.withColumnRenamed("concept_id", "from_id"), "from_id", "left_semi").join(
        known.withColumnRenamed("concept_id", "to_id"), "to_id", "left_semi"
    )


#: Partitions of the edge table below each relationship type.
EDGE_BUCKETS = 64
#: Slices that a partition is merged in.
EDGE_SLICES = 64
EDGE = ["edge_id", "from_id", "to_id", "confidence", "model_id", "run_id", "active", "relationship_type", "bucket"]


def inferred_edges(edges: DataFrame, kind: str, run_id: str, model_id: str = "structural", active: bool = True) -> DataFrame:
    """(from_id, to_id, confidence) as rows of the edge table.

    An edge's id is a hash of its type and ends, so every run names an edge alike and an upsert finds it again.
    """
    ident = F.sha2(F.concat_ws("|", F.lit(kind), "from_id", "to_id"), 256)
    return edges.select(
        ident.alias("edge_id"), "from_id", "to_id", F.col("confidence").cast("double").alias("confidence"),
        F.lit(model_id).alias("model_id"), F.lit(run_id).alias("run_id"), F.lit(active).alias("active"),
        F.lit(kind).alias("relationship_type"), F.pmod(F.crc32(ident), F.lit(EDGE_BUCKETS)).cast("int").alias("bucket"))


def read_edges(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the edge table, deleted ones included; None where there is no table yet."""
    return spark.read.parquet(path).select(*EDGE) if exists(spark, path) else None


def write_inferred_edges(written: DataFrame, expired: DataFrame, path: str) -> None:
    """Upsert `written` and delete `expired` (both rows of the edge table) by edge id.

    Only partitions (type, bucket) that either names are read and overwritten; the others stay as they are. What such a partition will
    hold is written to the shared folder first, so a run that breaks off is repeated from there or from the
    start with the same result. A deleted edge stays as a row that is not active, since
    overwriting by partition cannot leave a partition empty.
    """
    spark = written.sparkSession
    delta = stage(written.select(*EDGE).withColumn("active", F.lit(True)).unionByName(
        expired.select(*EDGE).withColumn("active", F.lit(False))), "edge-delta")
    rows = delta.withColumn("new", F.lit(True))
    old = read_edges(spark, path)
    if old is not None:
        # at most one row for each type and bucket
        touched = delta.select("relationship_type", "bucket").distinct()
        rows = rows.unionByName(old.join(F.broadcast(touched), ["relationship_type", "bucket"], "left_semi").withColumn("new", F.lit(False)))
    # rows of one edge share type, bucket and slice: one shuffle brings them together, and a task holds few partitions to write
    key = ["relationship_type", "bucket", "slice", "edge_id"]
    rest = [c for c in EDGE if c not in key]
    fresh = (
        rows.withColumn("slice", F.pmod(F.floor(F.crc32("edge_id") / EDGE_BUCKETS), F.lit(EDGE_SLICES))).repartition(*key[:3])
        .groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("new", ~F.col("active"), "confidence")).alias("r")).select(*key, "r.*")
    )
    stage(fresh.select(*EDGE), "edge-partitions").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "relationship_type", "bucket").parquet(path)


def append_rejected_edges(rejected: DataFrame, run_id: str, path: str) -> None:
    rejected.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def stored_dependencies(edges: DataFrame) -> DataFrame:
    """(src, dst) of stored dependency edges, the seed of the cycle check."""
    return edges.filter((F.col("relationship_type") == "concept_dependency") & F.col("active")).select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst")
    )


# --- snapshots --------------------------------------------------------------

def fingerprint(table: DataFrame, name: str) -> DataFrame:
    """(name, records, mix, total): a row count and two order-free hash sums.

    A row's hash is the first 60 bits of the md5 of its values as text, by column name, with a mark for null, so another engine can
    state it too.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in sorted(table.columns)]
    text = F.concat_ws("\u001f", *[F.coalesce(c, F.lit("\u0000")) for c in quoted])
    row = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return table.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("mix"),
        F.coalesce(F.sum(F.pmod(row, F.lit(1_000_003))), F.lit(0)).alias("total"),
    ).select(F.lit(name).alias("name"), "records", "mix", "total")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [fingerprint(table, name) for name, table in tables.items()]
    whole = rows[0]
    for row in rows[1:]:
        whole = whole.unionByName(row)
    return whole


def compare_manifests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, matches) for every expected table; a missing one does not match."""
    found = actual.select("name", *[F.col(c).alias(f"a_{c}") for c in ("records", "mix", "total")])
    same = [F.col(c) == F.col(f"a_{c}") for c in ("records", "mix", "total")]
    return expected.join(found, "name", "left").select(
        "name", F.coalesce(same[0] & same[1] & same[2], F.lit(False)).alias("matches")
    )


def create_snapshot(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """Write tables and their manifest under a new name; courses are required."""
    if "courses" not in tables:
        raise FileNotFoundError("a snapshot needs a courses table")
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")
    spark = tables["courses"].sparkSession
    written = {table: spark.read.parquet(f"{root}/{name}/{table}") for table in tables}
    manifest(written).write.mode("errorifexists").parquet(f"{root}/{name}/_manifest")


def resolve_snapshot(spark: SparkSession, root: str, name: str, table: str = "courses") -> DataFrame:
    path = f"{root}/{name}/{table}"
    if not exists(spark, path):
        raise FileNotFoundError(f"snapshot '{name}' has no {table}")
    return spark.read.parquet(path)


def verify_snapshot(spark: SparkSession, root: str, name: str) -> bool:
    """True when every table of the snapshot still has its fingerprint."""
    where = f"{root}/{name}"
    if not exists(spark, f"{where}/_manifest"):
        return False
    expected = spark.read.parquet(f"{where}/_manifest")
    names = [r["name"] for r in expected.select("name").collect()]
    present = {n: spark.read.parquet(f"{where}/{n}") for n in names if exists(spark, f"{where}/{n}")}
    if len(present) < len(names):
        return False
    return compare_manifests(expected, manifest(present)).filter("not matches").isEmpty()


def write_artefact(table: DataFrame, root: str, run_id: str, name: str) -> None:
    """One artefact of an evaluation run; a run is never written over."""
    table.write.mode("errorifexists").parquet(f"{root}/run_id={run_id}/{name}")


def finish_run(spark: SparkSession, root: str, run_id: str, names: list[str]) -> DataFrame:
    """Fingerprints of a run's artefacts, stored with the run."""
    where = f"{root}/run_id={run_id}"
    listed = manifest({n: spark.read.parquet(f"{where}/{n}") for n in names})
    listed.write.mode("errorifexists").parquet(f"{where}/_manifest")
    return spark.read.parquet(f"{where}/_manifest")
