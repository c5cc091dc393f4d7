import random

import tiktoken

import corpus_pipeline as cp
from kgraph.llm import bpe, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"
OTHER = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    text = lambda: " ".join(word() for _ in range(60))
    item = " ".join(word() for _ in range(30))
    docs, labels, want = [], [], {}
    add = lambda t: docs.append((len(docs), t, "en", f"s{len(docs) % 3}", None if t is None else len(t), "mine")) or len(docs) - 1
    for k in range(400):
        if k % 4 == 0:
            words = text().upper().split()
            labels.append((add(" ".join(w + "!!" for w in words)), 0, 0))
            continue
        body, kind, secret = text(), k % 10, None
        if kind == 1:
            labels.append((add(body[:100] + " " + item + " " + body[100:]), 1, 0))
            continue
        if kind == 2:
            secret = draw(18)
            body += f" password={secret} end"
        if kind == 3:
            body += f" order {rng.randint(10 ** 15, 10 ** 16 - 1)} end"
        i = add(body)
        labels.append((i, 1, 0))
        want[i] = body.replace(secret, secrets.MASK) if secret else body
        if kind == 5:
            add(body)
            add(body + " changed")
    return docs, labels, [(1, item), (2, None)], want


def test_every_stage_takes_effect(spark, tmp_path):
    docs, labels, items, want = corpus()
    folder = write(spark, tmp_path, docs, labels, items)
    out = cp.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(want)
    for r in out:
        assert r.ids == OTHER.encode_ordinary(want[r.doc_id]) and r.n_tokens == len(r.ids) and r.is_exact
        assert r.n_chars == len(want[r.doc_id])
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "byte_bpe"]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = [(None, None, None, None, None, None), (1, "", None, None, 0, None), (2, "", "en", "s", 0, None), (3, None, "en", "s", None, None),
            (4, "long " * 30000, "en", "s", 150000, None), (5, "a b", "en", None, 3, None), (5, "a b", "en", None, 3, None)]
    out = cp.run(spark, write(spark, tmp_path, docs, [(None, 1, 0), (5, 1, None), (4, None, None)], [(1, "a b")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, write(spark, tmp_path, [], [], [])).collect() == []
