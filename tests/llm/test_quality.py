import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kgraph.llm import quality as q
from kgraph.llm.common import is_held_out, remainder

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def corpus(n=900, seed=1):
    """Prose, and junk of three kinds; no word of one text helps with another."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [word() for _ in range(rng.randint(20, 60))]
        if not good:
            words = [[w.upper() + "!!" for w in words], [words[0]] * 40, [w + "###" for w in words]][i % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = q.op2_quality(spark, str(tmp_path)).collect()
    want = dict(labels)
    held = [r for r in out if r.held_out]
    assert len(out) == 900 and 200 < len(held) < 400
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_folded_scores_are_those_of_the_network():
    docs, labels = corpus(40)
    texts = pa.array([t for _, t in docs] + ["", "x"], pa.large_string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array([k for _, k in labels] + [0, 1]), texts], ["key", "label", "text"])
    bags = next(q.bags([batch]))
    buckets, shares = [x.values.to_numpy() for x in bags["buckets"]], [x.values.to_numpy() for x in bags["shares"]]
    model = q.fit(buckets, shares, bags["label"].to_numpy(), np.ones(42, np.float32))
    want = []
    for at, share in zip(buckets, shares):
        logits = model.layer @ (share @ model.vectors[at]) + model.bias
        want.append(np.exp(logits[1]) / np.exp(logits).sum())
    assert np.allclose(model.score(texts, model.folded()), want, atol=1e-4)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(60)
    d, rows = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    seen = rows.filter(~is_held_out("doc_id", 3, 1))
    flipped = rows.withColumn("quality", F.when(is_held_out("doc_id", 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = q.train(d, seen), q.train(d, flipped.filter(~is_held_out("doc_id", 3, 1)))
    assert (one.vectors == two.vectors).all()
    assert rows.select(remainder("doc_id", 3)).distinct().count() == 3


def test_odd_rows(spark):
    docs, labels = corpus(40)
    docs += [(None, None), (1000, ""), (1000, None), (3, "another text"), (1001, "x" * 200000), (1002, " \n ")]
    labels += [(3, None), (4, 7), (None, 1), (5, 1), (5, 1)]
    d = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("mine"))
    model = q.train(d, spark.createDataFrame(labels, LABELS))
    out = q.score_texts(d, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    empty = {r.score for r in rows if not (r.text or "").strip()}
    assert len(rows) == len(docs) and len(empty) == 1 and 0 <= empty.pop() <= 1


def test_missing_labels_and_empty_tables(spark):
    docs, labels = corpus(20)
    d, rows = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert {r.score for r in q.score_texts(d, q.train(d, rows.limit(0))).collect()} == {0.5}
    one = q.score_texts(d, q.train(d, rows.filter("quality = 1"))).collect()
    assert all(r.predicted == 1 for r in one)
    assert q.score_texts(d.limit(0), q.train(d.limit(0), rows)).collect() == []


def test_only_folded_numbers_come_to_the_driver(spark, monkeypatch):
    docs, labels = corpus(300)
    monkeypatch.setattr(q, "fit", None)  # tasks fit, not the driver
    model = q.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert model.vectors.shape == (q.BUCKETS, 1) and model.folded().any()
