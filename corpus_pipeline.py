"""From raw documents to token ids: five stages, each one operator of kgraph.llm.

1. quality: documents that the classifier rejects go; labels of the held-out third are not learned from;
2. near duplicates: one document of each class stays;
3. decontamination: documents that contain a benchmark item go;
4. secrets: credentials in texts are masked (`n_chars` follows);
5. byte-level BPE: texts become ids; `is_exact` tells whether they decode to the same bytes.

Every stage works on what its predecessor kept and is written as Parquet in the shared folder before the next one
reads it. Null and empty texts pass the stages like other documents: they get the classifier's bias, are no near
duplicates (equal empty texts are one class), contain nothing, hide nothing and have no ids. Columns that documents have
beyond the usual ones are kept up to the last stage. Repeated rows count as copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm import bpe, decontaminate, near_dup, quality, secrets
from kgraph.llm.common import clean_text, is_held_out, quoted, table, without
from kgraph.sources.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~is_held_out("doc_id", 3, 1))
    model = quality.train(docs, labels)
    score = quality.score_column(spark, model)
    return docs.filter(score >= 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    size = F.when(F.col("text").contains(secrets.MASK), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", size)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(docs))
    kept = quoted(without(docs, ["text", "ids", "n_tokens", "is_exact"]))
    return coded.select(
        *kept, "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == clean_text().cast("binary")).alias("is_exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: The classifier, the sketches and the tokenizer are beyond SQL; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
