import random

import numpy as np
from pyspark.sql import functions as F

from kgraph.llm import language as ln

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": "the and ing er on th".split(), "bb": "der sch ung ein ö ß".split(), "cc": "les que é eau ou è".split()}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 20, 80]))]
        rows.append((i, " ".join(words).capitalize() + ". 12", lang))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = ln.op3_language(spark, str(tmp_path)).collect()
    want = {i: k for i, _, k in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == 240 and 30 < len(held) < 90
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and np.mean([r.rejected for r in out]) < 0.1


def plain_model(texts):
    """Kneser-Ney with dictionaries: probability of a character after a history."""
    counts = [{} for _ in range(ln.ORDER + 1)]
    for t in texts:
        for w in ln._WORD.findall(t.lower()):
            s = ["<"] + list(w) + [">"]
            for i in range(1, len(s)):
                for n in range(1, ln.ORDER + 1):
                    if i - n + 1 >= 0:
                        g = tuple(s[i - n + 1:i + 1])
                        counts[n][g] = counts[n].get(g, 0) + 1
    used = [dict(c) for c in counts]
    for n in range(1, ln.ORDER):
        for g in used[n]:
            before = sum(h[1:] == g for h in counts[n + 1])
            used[n][g] = before or counts[n][g]

    def p(history, c):
        def level(n):
            if n == 0:
                return 1 / ln.ALPHABET
            context = tuple(history[len(history) - n + 1:]) if n > 1 else ()
            if n - 1 > len(history):
                return level(n - 1)
            same = {g: v for g, v in used[n].items() if g[:-1] == context}
            if not same:
                return level(n - 1)
            ones, twos = sum(v == 1 for v in used[n].values()), sum(v == 2 for v in used[n].values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = sum(same.values())
            return max(same.get(context + (c,), 0) - d, 0) / total + d * len(same) / total * level(n - 1)
        return level(min(ln.ORDER, len(history) + 1))

    return p


def test_probabilities_against_dictionaries(spark):
    texts = [t for _, t, k in corpus(30) if k == "aa"]
    model = ln.train(spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], SCHEMA))
    p = plain_model(texts)
    for text in [texts[0], "zzz thq", "the", "éa b"]:
        bits, size = 0.0, 0
        for w in ln._WORD.findall(text.lower()):
            s = ["<"] + list(w) + [">"]
            for i in range(1, len(s)):
                bits -= np.log2(p(s[max(0, i - ln.ORDER + 1):i], s[i]))
                size += 1
        assert abs(model.cross_entropies([text])[0, 0] - bits / size) < 1e-9
    seen = {c for t in texts for w in ln._WORD.findall(t.lower()) for c in [*w, ">"]}
    for history in (["<"], ["<", "t", "h"], ["t", "h", "e"], ["q", "q", "q"]):
        rest = (ln.ALPHABET - len(seen)) * p(history, "unseen")
        assert abs(sum(p(history, c) for c in seen) + rest - 1) < 1e-9


def test_odd_texts(spark):
    rows = corpus(60) + [(100, None, "aa"), (101, "", "bb"), (102, "12 34 !?", "cc"), (103, "the theand", None), (None, "thing", "aa"),
                         (104, "que " * 50000, "cc"), (105, "日本語 text", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine"))
    model = ln.train(df.drop("score"))
    out = ln.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "aa" and got[104].lang_pred == "cc" and got[105].rejected
    empty = ln.train(df.limit(0).drop("score"))
    assert {r.lang_pred for r in ln.identify(df, empty).collect()} == {"und"}
    assert ln.identify(df.limit(0), model).collect() == []
