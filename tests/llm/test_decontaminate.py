import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kgraph.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        have = shingle_set(text)
        for i, t in items:
            want = shingle_set(t)
            if want and len(want & have) >= threshold * len(want):
                out.add((d, i, len(want & have), len(want)))
    return out


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([5, 9, 14, 37, 59, 130, 600])))) for i in range(60)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "only four words here"), (104, "a a a a a a a a a")]
    docs = []
    for d in range(60):
        body = text(rng.choice([0, 3, 30, 300, 4000]))
        for _ in range(rng.choice([0, 1, 2])):
            passage = rng.choice(items)[1]
            passage = (passage or "").split()
            if rng.random() < 0.4 and len(passage) > 12:  # near the threshold, on both sides
                for _ in range(rng.choice([1, len(passage) // 45 + 1])):
                    passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((d, "\n ".join(body).upper() if d % 3 else " ".join(body)))
    return docs + [(None, None), (200, ""), (201, "A a a a a a"), (201, "A a a a a a")], items


def test_pairs_against_all_pairs(spark):
    docs, items = corpus()
    out = dc.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.shared, r.size) for r in out} == brute(docs, items)
    words = {d: (t or "").lower().split() for d, t in docs}
    for r in out:
        if r.containment == 1 and r.last_word - r.first_word + 1 == r.size + 4:
            assert words[r.doc_id][r.first_word:r.last_word + 1] == dict(items)[r.item_id].lower().split()


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(dc, "BLOCK_WORDS", 1500)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert len(dc.item_blocks(i, "item_id", "text")) > 2
    assert {(r.doc_id, r.item_id, r.shared, r.size) for r in dc.find_items(d, i).collect()} == brute(docs, items)
    hit = {x[0] for x in brute(docs, items)}
    kept = dc.decontaminate(d.withColumn("containment", F.lit(1)), i)
    assert kept.columns == ["doc_id", "text", "containment"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (x is None, x or 0) for x, _ in docs if x not in hit)


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert dc.find_items(d, i.limit(0)).collect() == [] and dc.find_items(d.limit(0), i).collect() == []
    assert dc.decontaminate(d, i.limit(0)).count() == len(docs)


def test_recall_of_the_search_at_the_threshold():
    """Candidates alone, for items of which a fifth of the shingles is gone, in documents of 20,000 words."""
    rng = np.random.default_rng(5)
    texts, items = [], []
    for k in range(80):
        item = [f"i{k}_{j}" for j in range(33)]
        items.append(" ".join(item))
        body = [f"b{x}" for x in rng.integers(0, 10 ** 6, 20000 if k < 5 else 2000)]
        at = int(rng.integers(0, len(body)))
        texts.append(" ".join([*body[:at], *item[:27], *body[at:]]))
    index = dc.ItemIndex(list(range(80)), items)
    found = index.search(pa.array(texts), 0.79)
    assert [[f["item_id"] for f in one] for one in found] == [[k] for k in range(80)]
