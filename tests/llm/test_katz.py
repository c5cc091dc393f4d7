import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgraph.llm import katz as kz
from kgraph.sources.staging import stage

SCHEMA = "doc_id long, text string"


def tokens_of(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", text) + ["</s>"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            s = ["<s>"] + tokens_of(t)
            self.words.update(s[1:])
            self.pairs.update(zip(s, s[1:]))
        self.n = sum(self.words.values())
        self.totals = Counter()
        for (v, _), c in self.pairs.items():
            self.totals[v] += c
        of = lambda counts: kz.discounts([sum(c == r for c in counts.values()) for r in range(1, kz.MOST + 2)])
        self.d1, self.d2 = of(self.words), of(self.pairs)

    def own(self, w):
        if w in self.words:
            c = self.words[w]
            return self.d1[c if c <= kz.MOST else 0] * c / self.n
        return 1 - sum(self.own(x) for x in self.words) if self.n else 1.0

    def seen(self, v, w):
        c = self.pairs[v, w]
        return self.d2[c if c <= kz.MOST else 0] * c / self.totals[v]

    def p(self, v, w):
        if not self.totals[v]:
            return self.own(w)
        if (v, w) in self.pairs:
            return self.seen(v, w)
        after = [x for u, x in self.pairs if u == v]
        return (1 - sum(self.seen(v, x) for x in after)) / (1 - sum(self.own(x) for x in after)) * self.own(w)

    def score(self, text):
        s = ["<s>"] + tokens_of(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip(s, s[1:]))

    def base(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.n + len(self.words) + 1)) for w in tokens_of(text))


def corpus(n=80, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "a b", "The"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 30])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words[min(int(rng.expovariate(0.08)), 62)] for _ in range(k))))
    return rows + [(500, None), (501, ""), (next(i for i in range(502, 600) if held(i)), "unknown words here w0 new"), (700, "w0 w1 " * 3000), (7, rows[7][1]), (7, rows[7][1])]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("part_bytes, chunk, hot", [(1 << 24, 1 << 20, 10_000), (2000, 300, 20), (5000, 2000, 3)])
def test_scores_against_dictionaries(spark, tmp_path, monkeypatch, part_bytes, chunk, hot):
    monkeypatch.setattr(kz, "PART_BYTES", part_bytes)
    monkeypatch.setattr(kz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(kz, "HOT", hot)
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(kz.op5_katz(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    model = Plain([t for i, t in rows if not held(i)])
    rows = sorted(rows, key=lambda r: r[0])
    assert [r.doc_id for r in out] == [i for i, _ in rows]
    for r, (i, t) in zip(out, rows):
        tokens = tokens_of(t)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(tokens), model.n)
        assert r.n_known == sum(w in model.words for w in tokens)
        assert r.base_score == pytest.approx(model.base(t), rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-9)
    assert any(r.held_out and r.n_known < r.n_tokens for r in out)


def test_every_context_sums_to_one():
    model = Plain([t for _, t in corpus()])
    for v in ["<s>", "w0", "w3", "w17", "never"]:
        assert sum(model.p(v, w) for w in [*model.words, "not among them"]) == pytest.approx(1)


def test_good_turing_discounts():
    d = kz.discounts([5040, 1680, 840, 504, 336, 240])
    assert all(0 < x < 1 for x in d[1:]) and d[1:] == sorted(d[1:])
    freed = sum(n * r * (1 - x) for r, (n, x) in enumerate(zip([5040, 1680, 840, 504, 336], d[1:]), 1))
    assert freed == pytest.approx(5040)
    assert kz.discounts([3, 0, 0, 0, 0, 0])[1] == 0.5


def test_no_training_texts_and_empty_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, "a b"), (1, None)], SCHEMA)
    out = kz.score(df, F.lit(True)).collect()
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in out} == {(0.0, 0.0, 0, 0)}
    assert kz.score(df.limit(0), F.lit(False)).collect() == []


def test_packed_arrays_come_back():
    arrays = [np.array(x, np.uint64) for x in ([], [0, 1, 255], [256], [2 ** 40], [2 ** 64 - 1, 0])]
    got = kz.unpack(kz.pack(*arrays))
    assert [g.tolist() for g in got] == [a.tolist() for a in arrays] and [g.itemsize for g in got] == [1, 1, 2, 8, 8]
    common, words = np.array([5, 9, 2 ** 63], np.uint64), np.array([9, 7, 2 ** 63, 2 ** 64 - 1], np.uint64)
    for known in (common, common[:0]):
        assert kz.decoded(4, *kz.coded(words, known), known).tolist() == words.tolist()


@pytest.mark.parametrize("common", [1, 30, 1 << 18])
def test_what_parts_write_stays_small(spark, tmp_path, monkeypatch, common):
    """Per token: a few bytes from chunks and parts, whatever share of words is common; scores stay the same."""
    monkeypatch.setattr(kz, "COMMON", common)
    monkeypatch.setattr(kz, "HOT", 20)
    monkeypatch.setattr(kz, "PART_BYTES", 4000)
    written = {}

    def staged(df, name):
        out = stage(df, name)
        if name == "katz-answers":
            sums = out.filter("kind = 'counts'").agg(F.sum(F.octet_length("pairs") + F.octet_length("docs"))).first()[0]
            written[name] = sums
        return out

    monkeypatch.setattr(kz, "stage", staged)
    rows = corpus()
    out = kz.score(spark.createDataFrame(rows, SCHEMA).repartition(2), kz.is_held_out("doc_id", 7, 2)).collect()
    model = Plain([t for i, t in rows if not held(i)])
    text = dict(rows)
    for r in out:
        assert r.score == pytest.approx(model.score(text[r.doc_id]), rel=1e-9)
        assert r.base_score == pytest.approx(model.base(text[r.doc_id]), rel=1e-9)
    assert written["katz-answers"] < 12 * sum(r.n_tokens for r in out)
