"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file (base64 bytes and rank per line). The pattern cuts a text into pieces, and the
library's model merges each piece. The model works on characters, so every byte is written as one printable
character; merges are all splits of a token into two tokens, in rank order, so that any two neighbours that make up
a token are merged, lowest rank first. A piece that is a token is taken whole.
Decoding looks up the characters of each id, turns them back into bytes and only then into text, so characters
that were split over tokens come out whole.

The work is a scan: no shuffle. The vocabulary is read on the driver once and sent to the tasks (a few megabytes, fixed).
Texts beyond CUT characters are encoded in parts, cut before a space that follows an ASCII letter or digit: the
pattern always ends a match there, so the ids are the same and memory stays bounded.

Defined cases: a null or empty text has no ids and decodes to the empty text; null ids decode like empty ones;
an unknown id raises an error; bytes that are not UTF-8 decode to U+FFFD in the text and unchanged in the bytes;
repeated rows are encoded alike; an empty table gives an empty result; input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgraph.llm.common import clean_text, quoted, small_batches, table, without

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a text that are encoded at once.
CUT = 1 << 16
#: Pieces whose ids a worker remembers, and the longest of them.
CACHED, SHORT = 1 << 18, 48
_CUT_AT = re.compile(r"(?<=[A-Za-z0-9])[ \n]")


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str = PATTERN) -> str:
    """The library's own description of the tokenizer."""
    letters = byte_characters()

    def shown(token: bytes) -> str:
        return "".join(letters[b] for b in token)

    merges = [
        (shown(token[:i]), shown(token[i:]))
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(len(token) - 1, 0, -1) if token[:i] in ranks and token[i:] in ranks
    ]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
            "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
            "vocab": {shown(t): r for t, r in ranks.items()}, "merges": merges,
        },
    })


class Encoder:
    """The library's model behind the splitting pattern; pieces that come again are merged once.

    At most CACHED short pieces are remembered, so memory stays bounded however many there are.
    """

    def __init__(self, described: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(described).model
        splitter = json.loads(described)["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(splitter["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_characters()))
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: str) -> list:
        """The library's tokens of one piece, on one character per byte."""
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.pieces.findall(text):
            found = known.get(piece)
            if found is None:
                found = [t.id for t in self.merged(piece)]
                if len(piece) <= SHORT:
                    if len(known) >= CACHED:
                        known.clear()
                    known[piece] = found
            out += found
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Id, first and end character of each token; a split character belongs to all its tokens."""
        out = []
        for match in self.pieces.finditer(text):
            piece = match.group()
            at = [match.start() + i for i, c in enumerate(piece) for _ in c.encode()]
            first = 0
            for token in self.merged(piece):
                last = first + len(token.value)  # one character per byte
                out.append((token.id, at[first], at[last - 1] + 1))
                first = last
        return out


@lru_cache(maxsize=4)
def _encoder(described: str) -> Encoder:
    return Encoder(described)


@lru_cache(maxsize=4)
def _byte_table(described: str) -> dict[int, bytes]:
    """The bytes of each id, by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return {i: bytes(back[c] for c in t) for t, i in json.loads(described)["model"]["vocab"].items()}


def _parts(text: str) -> list[str]:
    """`text` in parts of about CUT characters whose ids together are the ids of the text."""
    out, begin = [], 0
    while len(text) - begin > CUT:
        found = _CUT_AT.search(text, begin + CUT)
        if not found:
            break
        out.append(text[begin:found.start()])
        begin = found.start()
    return [*out, text[begin:]]


def encode_text(described: str, text: str, offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of one text and, if wanted, the first and the end character of each."""
    encoder = _encoder(described)
    none = np.empty(0, np.int32)
    if not offsets:
        return np.concatenate([none, *(np.array(encoder.ids(p), np.int32) for p in _parts(text))]), none, none
    spans, at = [np.empty((0, 3), np.int32)], 0
    for part in _parts(text):
        spans.append(np.array(encoder.spans(part), np.int32).reshape(-1, 3) + np.array([0, at, at], np.int32))
        at += len(part)
    whole = np.concatenate(spans)
    return whole[:, 0], whole[:, 1], whole[:, 2]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


class Codec:
    """A vocabulary on a cluster: columns for ids, offsets, bytes and text."""

    def __init__(self, spark: SparkSession, ranks_path: str = RANKS, pattern: str = PATTERN):
        small_batches(spark)
        self.described: Broadcast = spark.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path), pattern))

    def ids(self, text: Column) -> Column:
        """array<int> of a text without nulls."""
        described = self.described

        @F.arrow_udf("array<int>")
        def encoded(texts: pa.Array) -> pa.Array:
            return _lists([encode_text(described.value, t)[0] for t in texts.to_pylist()])

        # else the planner would copy the call into every column that is made from the ids
        return encoded.asNondeterministic()(text)

    def tokens(self, text: Column) -> Column:
        """struct<ids, starts, ends>: ids with the characters that each covers, a split character under all its tokens."""
        described = self.described

        @F.arrow_udf("struct<ids: array<int>, starts: array<int>, ends: array<int>>")
        def encoded(texts: pa.Array) -> pa.Array:
            found = [encode_text(described.value, t, True) for t in texts.to_pylist()]
            return pa.StructArray.from_arrays([_lists([f[i] for f in found]) for i in range(3)], ["ids", "starts", "ends"])

        return encoded(text)

    def bytes(self, ids: Column) -> Column:
        """The bytes that ids stand for."""
        described = self.described

        @F.arrow_udf("binary")
        def decoded(rows: pa.Array) -> pa.Array:
            known = _byte_table(described.value).__getitem__
            values, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            return pa.array(
                [b"".join(map(known, values[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])], pa.binary())

        return decoded(ids)

    def text(self, ids: Column) -> Column:
        """The text that ids stand for; characters split over tokens are whole again."""
        return F.make_valid_utf8(self.bytes(ids).cast("string"))


def encode(df: DataFrame, text: str = "text", ranks_path: str = RANKS, offsets: bool = False) -> DataFrame:
    """`df` with `ids` and, if wanted, `starts` and `ends` (characters)."""
    codec = Codec(df.sparkSession, ranks_path)
    if not offsets:
        return df.select(*quoted(without(df, ["ids"])), codec.ids(clean_text(text)).alias("ids"))
    kept = quoted(without(df, ["ids", "starts", "ends"]))
    return df.select(*kept, codec.tokens(clean_text(text)).alias("__tokens")).select(*kept, "__tokens.*")


def decode(df: DataFrame, ids: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """`df` with `decoded` (bytes)."""
    return df.select(*quoted(without(df, ["decoded"])), Codec(df.sparkSession, ranks_path).bytes(F.col(ids)).alias("decoded"))


@F.arrow_udf(StringType())
def ids_sha256(rows: pa.Array) -> pa.Array:
    """sha256 of ids as little-endian unsigned 32-bit integers."""
    values, ends = rows.values.to_numpy(zero_copy_only=False).astype("<u4"), rows.offsets.to_numpy()
    return pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string())


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    coded = decode(encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_byte_bpe": (op1_byte_bpe, None)}
