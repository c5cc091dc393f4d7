import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgraph.llm import bpe

RANKS = bpe.read_ranks(bpe.RANKS)
DESCRIBED = bpe.tokenizer_json(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", "a", "'s it's 're", "   x\n\n  y \t", "é中😀e\u0301", "<|endoftext|>", "aaaaaaaaaaaaa", "0123456789 12", "\x00\u2028",
        "x" * 300, "= " * 50, "\ufeffword"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_other_library(text):
    ids, starts, ends = bpe.encode_text(DESCRIBED, text, True)
    assert ids.tolist() == OTHER.encode_ordinary(text) == bpe.encode_text(DESCRIBED, text)[0].tolist()
    table = bpe._byte_table(DESCRIBED)
    assert b"".join(table[i] for i in ids) == text.encode()
    for i, a, b in zip(ids, starts, ends):
        assert table[i] in text[a:b].encode()


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert bpe.encode_text(DESCRIBED, text)[0].tolist() == OTHER.encode_ordinary(text)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(bpe, "CUT", 20)
    text = "".join(np.random.default_rng(1).choice([" ", "  ", "\n", "ab", "'s", "é", "12", "word"], 3000))
    ids, starts, ends = bpe.encode_text(DESCRIBED, text, True)
    assert len(bpe._parts(text)) > 20 and "".join(bpe._parts(text)) == text
    assert ids.tolist() == OTHER.encode_ordinary(text)
    assert starts[0] == 0 and ends[-1] == len(text) and (np.diff(starts) >= 0).all()


def test_frames_round_trip_with_nulls_and_clashes(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("mine"))
    out = bpe.decode(bpe.encode(df, offsets=True))
    assert out.columns == ["doc_id", "text", "ids", "starts", "ends", "decoded"]
    for r in out.collect():
        assert r.decoded == (r.text or "").encode() and len(r.ids) == len(r.starts) == len(r.ends)
    assert bpe.encode(df.limit(0)).collect() == []


def test_split_characters_come_out_whole(spark):
    ids = OTHER.encode_ordinary("😀中")
    df = spark.createDataFrame([(ids,), (ids[:1],), (None,)], "ids array<int>")
    codec = bpe.Codec(spark)
    got = [r[0] for r in df.select(codec.text(F.col("ids"))).collect()]
    assert got[0] == "😀中" and "\ufffd" in got[1] and got[2] == ""
    assert len(ids) > 2


def test_registered_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op1_byte_bpe(spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = OTHER.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
