"""Record rules: every failure is collected, none stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAINS = {
    "authority": ("registrar", "derived"),
    "level": ("undergraduate", "graduate"),
    "tier": ("core", "elective"),
    "alignment_status": ("aligned", "unaligned", "low_confidence_unaligned"),
    "rule_type": ("minimum_credits", "course_list", "course_set_reference", "gpa_minimum", "other"),
    "declared_type": ("prerequisite", "programme_membership", "cross_listing", "corequisite"),
    "inferred_type": ("concept_dependency", "concept_similarity", "concept_membership"),
}


def filled(column: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(column).cast("string"))) > 0, F.lit(False))


def within(column: str, domain: str) -> Column:
    return F.coalesce(F.col(column).isin(*DOMAINS[domain]), F.lit(False))


def in_unit_interval(column: str) -> Column:
    return F.coalesce((F.col(column) >= 0) & (F.col(column) <= 1), F.lit(False))


def _filled_all(*columns: str) -> dict[str, Column]:
    return {f"{c} must be a non-empty string": filled(c) for c in columns}


def provenance_rules(column: str = "provenance") -> dict[str, Column]:
    url = f"{column}.source_url"
    return {
        **_filled_all(url, f"{column}.adapter_name", f"{column}.adapter_version"),
        f"{url} must start with 'http'": F.coalesce(F.col(url).startswith("http"), F.lit(False)),
        f"{column}.retrieved_at must be set": F.col(f"{column}.retrieved_at").isNotNull(),
    }


def course_rules() -> dict[str, Column]:
    low, high = F.col("credits.min"), F.col("credits.max")
    return {
        **_filled_all("course_id", "subject_code", "course_number", "title"),
        "credits must be non-negative": F.coalesce((low >= 0) & (high >= 0), F.lit(True)),
        "credits.min must be <= credits.max": F.coalesce(low <= high, F.lit(True)),
    }


def prerequisite_rule_rules() -> dict[str, Column]:
    checkable = F.col("machine_checkable")
    return {
        "structured must be set when machine_checkable": ~checkable | F.col("structured").isNotNull(),
        "structured must be null when not machine_checkable": checkable | F.col("structured").isNull(),
        "verbatim_text must be non-empty when not machine_checkable": checkable | filled("verbatim_text"),
    }


def declared_edge_rules() -> dict[str, Column]:
    return {
        **_filled_all("edge_id", "from_id", "to_id"),
        "relationship_type is not declared": within("relationship_type", "declared_type"),
    }


def inferred_rules() -> dict[str, Column]:
    return {**_filled_all("model_id"), "confidence must be in [0, 1]": in_unit_interval("confidence")}


def inferred_edge_rules() -> dict[str, Column]:
    return {
        **inferred_rules(), **_filled_all("edge_id", "from_id", "to_id"),
        "relationship_type is not inferred": within("relationship_type", "inferred_type"),
    }


def knowledge_unit_rules(source: str) -> dict[str, Column]:
    return {
        **_filled_all("ku_id", "label", "knowledge_area"),
        f"source must be '{source}'": F.coalesce(F.col("source") == source, F.lit(False)),
    }


def concept_rules() -> dict[str, Column]:
    return {
        **inferred_rules(), **_filled_all("concept_id", "label", "source_course_id"),
        "authority must be derived": F.coalesce(F.col("authority") == "derived", F.lit(False)),
    }


def programme_rules() -> dict[str, Column]:
    return {
        **_filled_all("programme_id", "name", "department", "catalogue_url"),
        "requirement_rules must hold at least one": F.coalesce(F.size("requirement_rules") > 0, F.lit(False)),
    }


def requirement_rule_rules() -> dict[str, Column]:
    checkable = F.col("machine_checkable")
    return {
        "verbatim_text must be non-empty when not machine_checkable": checkable | filled("verbatim_text"),
        "structured_predicate must be null when not machine_checkable": checkable | F.col("structured_predicate").isNull(),
    }


def course_set_rules() -> dict[str, Column]:
    return {
        "verbatim_description must be set for an open set": ~F.col("open_enumeration")
        | (F.length(F.coalesce("verbatim_description", F.lit(""))) > 0),
    }


def with_failures(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `failures`, the names of all rules that a record breaks."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return records.withColumn("failures", F.array_compact(F.array(*broken)))


def split_valid(records: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(passed, failed); failed rows keep `failures`."""
    checked = with_failures(records, rules)
    return checked.filter(F.size("failures") == 0).drop("failures"), checked.filter(F.size("failures") > 0)


def require_valid(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Records unchanged; the job fails at the first broken rule."""
    checked = with_failures(records, rules)
    message = F.concat(F.lit("invalid record: "), F.array_join("failures", "; "))
    kept = F.when(F.size("failures") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.filter(kept).drop("failures")


def to_json_rows(records: DataFrame) -> DataFrame:
    """Each record as one JSON text; nulls are written so nothing is lost."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(rows: DataFrame, schema) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")
