import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgraph.llm import near_dup as nd
from kgraph.llm import shingles as sh
from kgraph.llm.components import components

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def brute_classes(rows):
    """Class of each row by union of all similar or equal texts; null texts stay alone."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [None if t is None else shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                continue
            if rows[i][1].lower().split() == rows[j][1].lower().split() or jaccard(a, b) >= 0.8:
                parent[find(i)] = find(j)
    return [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += ["", "  ", "", "one", "One", "one two", "same same " * 30, "same same " * 31, "a b c d e"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_against_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_a_chain_of_near_copies_is_one_class(spark):
    """Texts of one bucket that are not similar to its smallest node are still linked to each other."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):
        words[7 * k + 5] = f"x{k}"
        rows.append((k, " ".join(words)))
    sets = [shingle_set(t) for _, t in rows]
    assert jaccard(sets[0], sets[1]) >= 0.8 > jaccard(sets[0], sets[-1])
    out = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in out} == {0} and all(r.links for r in out)


def test_one_of_each_class_stays(spark):
    rows = corpus(5) + [(2, "one"), (None, "one"), (7, None), (7, None), (None, None), (None, "null id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class_id", F.lit("mine"))
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    kept = kept.collect()
    found = nd.near_duplicates(df).filter("node is not null").select("class_node").distinct().count()
    assert sum(r.text is not None for r in kept) == found
    assert sum(r.text is None for r in kept) == 3
    exact = spark.createDataFrame([(1, "a b c d e f")] * 4, SCHEMA)
    assert nd.keep_one(exact).collect() == exact.take(1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(empty).collect() == [] and nd.keep_one(empty).collect() == []


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    x, y = np.arange(0, 200), np.arange(100, 300)
    wx, wy = rng.uniform(0.5, 4, 200), rng.uniform(0.5, 4, 200)
    m = 4096
    sig = nd.prob_minhash(
        np.concatenate([items[x], items[y]]), np.repeat([0, 1], 200), np.concatenate([wx, wy]), 2, m)
    full = np.zeros((2, 300))
    full[0, x], full[1, y] = wx, wy
    both = np.flatnonzero((full > 0).all(axis=0))
    want = sum(1 / np.maximum(full[0] / full[0, i], full[1] / full[1, i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want / m)


def test_registers_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    items, weights = rng.integers(0, 2 ** 63, 50).astype(np.uint64), rng.uniform(1, 3, 50)
    alone = nd.prob_minhash(items, np.zeros(50, int), weights, 1)
    others = rng.integers(0, 2 ** 63, 90000).astype(np.uint64)
    among = nd.prob_minhash(
        np.concatenate([items, others]), np.repeat([0, 1], [50, 90000]), np.concatenate([weights, np.ones(90000)]), 2)
    assert (alone[0] == among[0]).all()


def test_shingles_against_plain_python():
    texts = ["a b c d e f", "", " A  b\tC d\n e F ", "x", None, "a b c d", "é É x y z é"]
    words, begins = sh.word_hashes(pa.array(texts))
    assert np.diff(begins).tolist() == [6, 0, 6, 1, 0, 4, 6]
    values, rows = sh.shingle_hashes(words, begins)
    assert np.bincount(rows, minlength=7).tolist() == [2, 0, 2, 1, 0, 1, 2]
    assert values[rows == 0].tolist() == values[rows == 2].tolist()
    assert sh.shingle_hashes(words, begins, short=False)[1].tolist() == [0, 0, 2, 2, 6, 6]
    assert len(set(values.tolist())) == 6


@pytest.mark.parametrize("links, want", [
    ([], {}),
    ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}),
    ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0)),
])
def test_components(spark, links, want):
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in out} == want


def test_unevenly_repeated_passages(spark):
    """Similarity of sets decides, so a repeated passage must not hide a pair from the bands or the registers."""
    rng = random.Random(6)
    rows = []
    for k in range(24):
        base = [f"w{k}x{rng.randrange(10 ** 6)}" for _ in range(200)]
        copy = base + base[:40] * [50, 300, 1000][k % 3]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert all(jaccard(shingle_set(rows[i][1]), shingle_set(rows[i + 1][1])) > 0.9 for i in range(0, len(rows), 2))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
