"""Language-model scores by Katz back-off over word pairs.

Counts of words and of word pairs are discounted by Good-Turing up to MOST occurrences; what the discounts free in a
context goes to the words not seen in it, in proportion to their own discounted probability:

    P(w | v) = d(c(v w)) c(v w) / c(v)          where the pair was seen in training,
    P(w | v) = alpha(v) P(w)                     where it was not,
    P(w)     = d(c(w)) c(w) / N, and the rest for all unknown words together,

with alpha(v) = (1 - sum of the first line over the words seen after v) / (1 - sum of P over the same words), so every context
sums to one exactly. A context that was never seen is left out (P(w)). Counts above MOST lose a millionth, so that every
context leaves some mass; where counts are too few for Good-Turing (an empty class of counts, or a discount outside (0, 1]),
half an occurrence is taken off instead.

Tables: word counts are grouped by word. Pairs travel once, packed: a chunk of texts sends one row to each part, a part being
the pairs of the contexts with one hash; the row holds each pair once, and which texts of the chunk have it. Contexts with more
than 1 / HOT of all tokens are spread over the parts by their second word; their counts (at most HOT) are broadcast, and so
are those of the words with more than 1 / COMMON of all tokens (at most COMMON), which travel as short numbers. A part is about
PART_BYTES of text. It knows all counts of its pairs and answers each chunk with them; sums are made where a chunk meets its
answers. It passes on the pairs not seen, the counts of their contexts and those words behind them that are not common, which
are then joined with the word counts. Everything covers all training texts and grows with them; nothing is collected but
totals, count-of-counts and words above these shares.

Defined cases: a null or empty text is one end token; repeated rows count as often as they are there and get equal rows; without
training texts every text has base_score and score 0; rows without doc_id are never learned from; an empty table gives
an empty result; the result has the named columns only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import clean_text, is_held_out, small_batches, table
from kgraph.llm.shingles import mix
from kgraph.sources.staging import stage

MOST = 5
LARGE = 1 - 1e-6
HOT = 10_000
COMMON = 1 << 18
PART_BYTES = 4 << 20
CHUNK_TOKENS = 1 << 20
BEGIN, END, NONE = np.uint64(1), np.uint64(2), np.uint64(0)
CHUNKS = "part int, chunk long, pairs binary, docs binary, ids array<long>, held array<boolean>, tokens array<long>"
ANSWERS = ("kind string, chunk long, a array<long>, b array<long>, c array<long>, x array<double>, ids array<long>, "
           "held array<boolean>, pairs binary, docs binary")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in the smallest type that holds it, compressed together."""
    narrow = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
    head = "".join(f"{a.dtype.itemsize}:{len(a)} " for a in narrow).encode()
    body = b"".join(a.tobytes() for a in narrow)
    sizes = np.array([len(head), len(body)], np.int64).tobytes()
    return sizes + head + pa.compress(body, "zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    head, body = np.frombuffer(packed, np.int64, 2)
    data = pa.decompress(packed[16 + head:], int(body), "zstd", asbytes=True)
    out, at = [], 0
    for shape in packed[16:16 + head].decode().split():
        width, n = map(int, shape.split(":"))
        out.append(np.frombuffer(data, f"u{width}", n, at))
        at += width * n
    return out


def coded(words: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Words as places in `common`, which is sorted, and in full where they are not there."""
    at = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
    known = common[at] == words if len(common) else np.zeros(len(words), bool)
    return [np.packbits(known), at[known], words[~known]]


def decoded(n: int, known: np.ndarray, at: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    known = np.unpackbits(known, count=n).astype(bool)
    words = np.empty(n, np.uint64)
    words[known], words[~known] = common[at], rest
    return words


def runs(new: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin where `new` is true."""
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z in lower case, ASCII white space between them), and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = pc.dictionary_encode(lists.flatten())
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    hashes = np.where(hashes <= END, hashes + np.uint64(3), hashes)  # three values are taken
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.array([bool(w) for w in words], bool)[index] if len(words) else np.empty(0, bool)
    return hashes[index][full], np.concatenate([[0], np.cumsum(full)])[offsets].astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, begins = words_of(batch["text"])
        keys, counts = np.unique(words, return_counts=True)
        keys, counts = np.append(keys, END), np.append(counts, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["w", "n"])


def parts_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    spread = np.isin(v, hot)
    return (mix(np.where(spread, v ^ mix(w), v)) % np.uint64(parts)).astype(np.int32)


def make_chunks(batches: Iterator[pa.RecordBatch], hot: np.ndarray, common: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Per chunk one row of the texts (ids, fold, number of tokens), and a row of sorted pairs for each part.

    `pairs` has the contexts, the number of pairs of each, the second words, and how often each pair is learned from; `docs`
    has the number of texts with each pair, and for each of these the text and how often. A text is twice its place in its
    chunk, plus one if it is held out.
    """
    kept: list[pa.RecordBatch] = []
    size = number = 0
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("docs", pa.binary()),
                        ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64()))])

    def packed(v: np.ndarray, w: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
        new_v = np.ones(len(v), bool)
        new_v[1:] = v[1:] != v[:-1]
        new = new_v.copy()
        new[1:] |= w[1:] != w[:-1]
        learned = np.add.reduceat(np.where(doc % 2 == 0, n, 0), np.flatnonzero(new))
        return pack(*coded(v[new_v], common), runs(new_v[new]), *coded(w[new], common), learned), pack(runs(new), doc, n)

    def chunk() -> pa.RecordBatch:
        whole = pa.Table.from_batches(kept).combine_chunks()
        words, begins = words_of(whole["text"].combine_chunks())
        sizes, held = np.diff(begins), whole["held"].to_numpy(zero_copy_only=False).astype(bool)
        # each text: BEGIN, its words, END
        ends = np.cumsum(sizes + 1)
        second = np.full(len(words) + len(sizes), END)
        is_word = np.ones(len(second), bool)
        is_word[ends - 1] = False
        second[is_word] = words
        first = np.concatenate([[BEGIN], second[:-1]]).astype(np.uint64)
        first[ends - sizes - 1] = BEGIN
        doc = np.repeat(2 * np.arange(len(sizes)) + held, sizes + 1).astype(np.int32)
        part = parts_of(first, second, hot, parts)
        order = np.lexsort((doc, second, first, part))
        part, first, second, doc = part[order], first[order], second[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(doc))).astype(np.int32)
        part, first, second, doc = part[at], first[at], second[at], doc[at]
        present, cuts = np.unique(part, return_index=True)
        name = (TaskContext.get().partitionId() << 32) + number
        blobs = [packed(first[a:b], second[a:b], doc[a:b], times[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]
        last = [None] * len(present)
        return pa.RecordBatch.from_arrays([
            pa.array([*present.tolist(), name % parts], pa.int32()), pa.array([name] * (len(present) + 1), pa.int64()),
            pa.array([*(p for p, _ in blobs), None], pa.binary()), pa.array([*(d for _, d in blobs), None], pa.binary()),
            pa.array([*last, whole["doc_id"].to_pylist()], schema.field("ids").type), pa.array([*last, held], schema.field("held").type),
            pa.array([*last, sizes + 1], schema.field("tokens").type)], schema=schema)

    for batch in batches:
        kept.append(batch)
        size += batch.num_rows + batch["text"].nbytes // 6
        if size >= CHUNK_TOKENS:
            yield chunk()
            kept, size, number = [], 0, number + 1
    if kept:
        yield chunk()


def answer_part(rows: pa.Table, hot: np.ndarray, hot_counts: np.ndarray, common: np.ndarray, shares: np.ndarray) -> pa.Table:
    """What one part has to say: counts for each chunk, unseen pairs, their contexts with all followers, count-of-counts.

    `shares` are the discounted probabilities of the common words.
    """
    out: list[dict] = []
    texts = rows.filter(pc.is_valid(rows["ids"]))
    for r in texts.select(["chunk", "ids", "held", "tokens"]).to_pylist():
        out.append({"kind": "texts", "chunk": r["chunk"], "ids": r["ids"], "held": r["held"], "a": r["tokens"]})
    rows = rows.filter(pc.is_valid(rows["pairs"])).select(["chunk", "pairs", "docs"])
    if rows.num_rows:
        ids, of_docs = rows["chunk"].to_pylist(), rows["docs"].to_pylist()
        vs, ws, learned, each = [], [], [], []  # each: pairs of every context, by chunk
        for packed in rows["pairs"]:
            v_known, v_at, v_rest, n_pairs, *second, times = unpack(packed.as_py())
            size = int(n_pairs.sum(dtype=np.int64))
            vs.append(np.repeat(decoded(len(n_pairs), v_known, v_at, v_rest, common), n_pairs))
            ws.append(decoded(size, *second, common))
            learned.append(times)
            each.append(n_pairs)
        borders = np.cumsum([0, *map(len, ws)])
        v, w, learned = np.concatenate(vs), np.concatenate(ws), np.concatenate(learned)
        del vs, ws
        order = np.lexsort((w, v))
        pv, pw = v[order], w[order]
        new = np.ones(len(v), bool)
        new[1:] = (pv[1:] != pv[:-1]) | (pw[1:] != pw[:-1])
        pair = np.empty(len(v), np.int64)
        pair[order] = np.cumsum(new) - 1
        pv, pw = pv[new], pw[new]
        counts = np.bincount(pair, learned, len(pv)).astype(np.int64)
        contexts, context = np.unique(pv, return_inverse=True)
        totals = np.bincount(context, counts).astype(np.int64)
        at = np.minimum(np.searchsorted(hot, contexts), max(0, len(hot) - 1))
        is_hot = hot[at] == contexts if len(hot) else np.zeros(len(contexts), bool)
        totals[is_hot] = hot_counts[at[is_hot]]
        needed = is_hot.copy()
        for k, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
            c, total = counts[pair[a:b]], totals[context[pair[a:b]]]
            heads = np.cumsum(each[k], dtype=np.int64) - each[k]
            out.append({"kind": "counts", "chunk": ids[k], "docs": of_docs[k],
                        "pairs": pack(each[k], c, total[heads], v[a:b][heads] == BEGIN)})
            if not c.all():
                n_docs, doc, n = unpack(of_docs[k])
                none = np.flatnonzero(np.repeat(c == 0, n_docs))
                i = np.repeat(np.arange(a, b), n_docs)[none]
                needed[context[pair[i]]] = True
                out.append({"kind": "unseen", "chunk": ids[k], "a": doc[none].astype(np.int64) // 2,
                            "b": np.where(total[i - a] > 0, v[i], NONE).view(np.int64), "c": w[i].view(np.int64),
                            "ids": n[none].astype(np.int64)})
        mine = np.flatnonzero(needed[context] & (counts > 0))
        if len(mine):
            at = np.minimum(np.searchsorted(common, pw[mine]), max(0, len(common) - 1))
            known = common[at] == pw[mine] if len(common) else np.zeros(len(mine), bool)
            covered = np.bincount(context[mine[known]], shares[at[known]], len(contexts))
            rare = mine[~known]
            out.append({"kind": "followers", "a": pv[rare].view(np.int64), "b": pw[rare].view(np.int64)})
            shape = np.zeros((len(contexts), MOST + 1), np.int64)
            large = counts[mine] > MOST
            np.add.at(shape, (context[mine[large]], 0), counts[mine[large]])
            np.add.at(shape, (context[mine[~large]], counts[mine[~large]]), 1)
            has = np.unique(context[mine])
            out.append({"kind": "contexts", "a": contexts[has].view(np.int64), "b": totals[has], "c": shape[has].ravel(),
                        "x": covered[has]})
        out.append({"kind": "histogram", "a": np.bincount(np.minimum(counts, MOST + 2), minlength=MOST + 3)[1:MOST + 2]})
    lists = pa.list_(pa.int64())
    return pa.table({
        "kind": pa.array([o["kind"] for o in out], pa.string()), "chunk": pa.array([o.get("chunk") for o in out], pa.int64()),
        **{k: pa.array([o.get(k) for o in out], lists) for k in "abc"}, "x": pa.array([o.get("x") for o in out], pa.list_(pa.float64())),
        "ids": pa.array([o.get("ids") for o in out], lists), "held": pa.array([o.get("held") for o in out], pa.list_(pa.bool_())),
        **{k: pa.array([o.get(k) for o in out], pa.binary()) for k in ("pairs", "docs")},
    })


def discounts(histogram: list[int]) -> list[float]:
    """d(0) for counts above MOST, and d(1) to d(MOST), from the numbers of items seen once, twice, and so on."""
    n = [0, *histogram]
    halves = [LARGE, *(1 - 0.5 / r for r in range(1, MOST + 1))]
    if 0 in n[1:MOST + 2]:
        return halves
    rest = (MOST + 1) * n[MOST + 1] / n[1]
    found = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest != 1 else 0.0 for r in range(1, MOST + 1)]
    return [LARGE, *found] if all(0 < d <= 1 for d in found) else halves


class Totals(NamedTuple):
    tokens: int
    words: int
    ends: int
    single: list[float]  # discounts of words
    double: list[float]  # discounts of pairs
    unknown: float  # probability of all unknown words together


def _discounted(count: Column, d: list[float]) -> Column:
    """d(count) * count."""
    factor = F.lit(d[0])
    for r in range(1, MOST + 1):
        factor = F.when(count == r, F.lit(d[r])).otherwise(factor)
    return factor * count


def score(docs: DataFrame, held: Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", clean_text(text).alias("text"), held.alias("held"))
    size = docs.agg(F.sum(F.octet_length(text) + 8)).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))

    counts = stage(
        rows.filter(~F.col("held")).select("text").mapInArrow(count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")),
        "katz-words")
    classes = [F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, MOST + 2)]
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("w") == int(END), F.col("n"))).alias("e"), *classes).first()
    tokens, words, ends = whole.n or 0, whole.v, whole.e or 0
    single = discounts([whole[f"n{r}"] for r in range(1, MOST + 2)])
    own = counts.select(F.col("w"), (_discounted(F.col("n"), single) / F.lit(max(1, tokens))).alias("p"))
    often = own.join(counts.filter(F.col("n") > tokens / max(HOT, COMMON)), "w").toArrow().sort_by("w")
    often_words, often_counts = often["w"].to_numpy().view(np.uint64), often["n"].to_numpy()
    is_hot = (often_counts > tokens / HOT) & (often_words != END)
    hot = sorted([*zip(often_words[is_hot].tolist(), often_counts[is_hot].tolist()), (int(BEGIN), ends)])
    hot_words, hot_counts = np.array([h for h, _ in hot], np.uint64), np.array([n for _, n in hot], np.int64)
    order = np.argsort(often_words)
    held_words = spark.sparkContext.broadcast((hot_words, hot_counts, often_words[order], often["p"].to_numpy()[order]))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _, common, _ = held_words.value
        return make_chunks(batches, hot, common, parts)

    chunks = rows.mapInArrow(chunked, CHUNKS)
    answers = stage(chunks.groupBy("part").applyInArrow(lambda t: answer_part(t, *held_words.value), ANSWERS), "katz-answers")

    def kind(name: str) -> DataFrame:
        return answers.filter(F.col("kind") == name)

    histogram = kind("histogram").agg(*[F.sum(F.col("a")[r]) for r in range(MOST + 1)]).first()
    double = discounts([x or 0 for x in histogram])
    mass = counts.agg(F.sum(_discounted(F.col("n"), single))).first()[0] or 0.0
    found = Totals(tokens, words, ends, single, double, 1 - mass / tokens if tokens else 1.0)

    pairs = kind("followers").select(F.explode(F.arrays_zip("a", "b")).alias("r")).select(F.col("r.a").alias("v"), F.col("r.b").alias("w"))
    covered = pairs.join(own, "w").groupBy("v").agg(F.sum("p").alias("covered"))
    places = F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.struct(
        F.get("a", i).alias("v"), F.get("b", i).alias("total"), F.get("x", i).alias("common"), F.slice("c", i * (MOST + 1) + 1, MOST + 1).alias("shape")))
    shapes = kind("contexts").select(F.explode(places).alias("r")).select("r.*").groupBy("v").agg(
        F.max("total").alias("total"), F.sum("common").alias("common"), *[F.sum(F.col("shape")[r]).alias(f"s{r}") for r in range(MOST + 1)])
    used = sum((F.col(f"s{r}") * (double[r] * max(1, r)) for r in range(MOST + 1)), F.lit(0.0))
    seen_after = F.col("common") + F.coalesce("covered", F.lit(0.0))
    alphas = shapes.join(covered, "v", "left").select("v", F.log10((1 - used / F.col("total")) / (1 - seen_after)).alias("alpha"))

    zipped = F.arrays_zip(F.col("a"), F.col("b"), F.col("c"), F.col("ids"))
    unseen = kind("unseen").select("chunk", F.explode(zipped).alias("r")).select(
        "chunk", F.col("r.a").alias("doc"), F.col("r.b").alias("v"), F.col("r.c").alias("w"), F.col("r.ids").alias("n"))
    backed = unseen.join(own, "w", "left").join(alphas, "v", "left").groupBy("chunk", "doc").agg(F.sum(
        F.col("n") * (F.log10(F.coalesce("p", F.lit(found.unknown))) + F.coalesce("alpha", F.lit(0.0)))).alias("backed"))
    packed = backed.groupBy("chunk").agg(F.collect_list("doc").alias("a"), F.collect_list("backed").alias("x")).select(
        F.lit("backed").alias("kind"), "chunk", "a", "x")
    said = answers.filter(F.col("kind").isin("texts", "counts")).unionByName(packed, allowMissingColumns=True)
    return said.groupBy("chunk").applyInArrow(lambda t: sum_chunk(t, found), (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def sum_chunk(rows: pa.Table, found: Totals) -> pa.Table:
    """The texts of one chunk, from what all parts say about them."""
    texts = [r for r in rows.filter(pc.equal(rows["kind"], "texts")).to_pylist()][0]
    size = len(texts["ids"])
    tokens = np.array(texts["a"], np.int64)
    score_, base, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    logs = np.log10(found.double)
    for r in rows.filter(pc.equal(rows["kind"], "counts")).select(["pairs", "docs"]).to_batches():
        for packed, docs in zip(r["pairs"], r["docs"]):
            each, c, total, begin = unpack(packed.as_py())
            n_docs, doc, n = unpack(docs.as_py())
            at, n = doc.astype(np.int64) // 2, n.astype(np.int64)
            c, total, begin = (np.repeat(x, n_docs) for x in (c.astype(np.int64), np.repeat(total.astype(np.int64), each), np.repeat(begin, each)))
            seen, word = c > 0, begin == 0
            place = logs[np.where(c > MOST, 0, c)[seen]]
            score_ += np.bincount(at[seen], n[seen] * (np.log10(c[seen]) - np.log10(total[seen]) + place), size)
            base += np.bincount(at[word], n[word] * np.log10(total[word] + 1.0), size)
            known += np.bincount(at[word], n[word] * (total[word] > 0), size).astype(np.int64)
    for r in rows.filter(pc.equal(rows["kind"], "backed")).select(["a", "x"]).to_pylist():
        np.add.at(score_, np.array(r["a"], np.int64), np.array(r["x"]))
    base += np.log10(found.ends + 1) - tokens * np.log10(found.tokens + found.words + 1)
    known += found.ends > 0
    return pa.table({
        "doc_id": pa.array(texts["ids"], pa.int64()), "held_out": pa.array(texts["held"], pa.bool_()), "n_tokens": tokens,
        "n_known": known, "train_tokens": np.full(size, found.tokens, np.int64), "base_score": base, "score": score_})


def op5_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability; a seventh is held out."""
    return score(table(spark, folder, "documents").select("doc_id", "text"), is_held_out("doc_id", 7, 2))


QUERIES = {"op5_katz": (op5_katz, None)}
