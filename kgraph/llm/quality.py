"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its words, their character n-grams, n-grams of their character classes and pairs of
neighbouring words (a word after itself is one feature of its own). Every feature has a learned vector; a text is the
average of its vectors, and a softmax layer turns the average into class probabilities. Vectors and layer are trained
by stochastic gradient descent in numpy, one text at a time, on a bounded sample of labelled texts (SAMPLE rows at most,
half of them from each class where there are enough; weights undo the choice, so scores keep the true shares).

Between the vectors and the two classes everything is linear, so for scoring each feature's vector is folded with the
output layer into one number; a text's score is the logistic function of a mean. The model that travels to the tasks
has 2^18 numbers (1 MB) at any input size, and scoring is a scan without a shuffle. One task fits the model from the
sample's features; only the folded numbers come to the driver.

Defined cases: null and empty texts have no features and get the bias alone; without any usable label the score is 0.5,
with labels of one class the model learns just that class; labels that are null or not 0 or 1 are left out; a labelled
doc_id with several texts is learned from one of them; repeated rows are scored alike; an empty table gives an empty
result; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import clean_text, is_held_out, quoted, small_batches, table, without
from kgraph.llm.shingles import mix

BUCKETS = 1 << 18
DIMENSION = 16
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 3000
#: Passes over the sample; small samples are gone over until there were STEPS texts.
EPOCHS, STEPS = 5, 8000
RATE = 1.0
N_GRAMS = (2, 3, 4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ECHO = np.uint64(0xEC40)


class Features(NamedTuple):
    """Buckets of single words and of pairs, of a batch of texts."""

    word: np.ndarray  # distinct word of each token
    row: np.ndarray  # text of each token
    owner: np.ndarray  # distinct word of each word feature
    bucket: np.ndarray  # bucket of each word feature
    pair_row: np.ndarray
    pair_bucket: np.ndarray


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, other bytes by themselves, bytes of longer characters together."""
    out = np.arange(256)
    for chars, to in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (range(128, 256), 2)):
        out[list(chars)] = to
    return out.astype(np.uint64)


_CLASS = _classes()


def _grams(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside the words, and the word of each."""
    folded = np.full(max(0, len(data) - n + 1), np.uint64(salt))
    for j in range(n):
        folded = folded * np.uint64(0x100000001B3) ^ data[j:j + len(folded)]
    counts = np.maximum(sizes - n + 1, 0)
    at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return folded[at], np.repeat(np.arange(len(sizes)), counts)


def features(texts: pa.Array, buckets: int = BUCKETS) -> Features:
    lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = pc.dictionary_encode(lists.flatten())
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [f"<{w}>".encode() for w in coded.dictionary.to_pylist()]
    full = np.array([len(w) > 2 for w in words], bool)[index] if len(words) else np.empty(0, bool)
    index, row = index[full], row[full]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8)
    plain, shaped = data.astype(np.uint64), _CLASS[data]
    found = [_grams(plain, begins, sizes, n, n) for n in N_GRAMS] + [_grams(shaped, begins, sizes, 3, 99)]
    # the whole word: a product over its bytes that does not depend on neighbours
    places = np.arange(len(data)) - np.repeat(begins, sizes)
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, np.repeat(np.arange(len(words)), sizes), mix(plain + (places.astype(np.uint64) + np.uint64(1)) * _STEP))
    whole = mix(whole)
    found.append((whole, np.arange(len(words))))
    token = whole[index]
    same_row = row[1:] == row[:-1]
    pair = np.where(token[1:] == token[:-1], _ECHO, mix(token[:-1] + _STEP) ^ token[1:])[same_row]
    low = np.uint64(buckets - 1)
    return Features(
        index, row, np.concatenate([f[1] for f in found]), (mix(np.concatenate([f[0] for f in found])) & low).astype(np.int32),
        row[1:][same_row], (mix(pair) & low).astype(np.int32))


class Model(NamedTuple):
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> np.ndarray:
        """One number for each feature: what it adds to the log odds of class 1."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)

    def score(self, texts: pa.Array, folded: np.ndarray) -> np.ndarray:
        n, f = len(texts), features(texts, len(folded))
        words = int(f.owner.max(initial=-1)) + 1
        value = np.bincount(f.owner, folded[f.bucket], words)
        count = np.bincount(f.owner, minlength=words)
        total = np.bincount(f.row, value[f.word], n) + np.bincount(f.pair_row, folded[f.pair_bucket], n)
        size = np.bincount(f.row, count[f.word], n) + np.bincount(f.pair_row, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.bias[1] - self.bias[0])))


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text and the share that each has in it."""
    for batch in batches:
        lists, shares = [], []
        for text in batch["text"].to_pylist():
            f = features(pa.array([text], pa.large_string()))
            times = np.bincount(f.word, minlength=int(f.owner.max(initial=-1)) + 1)
            all_buckets = np.concatenate([f.bucket, f.pair_bucket])
            weights = np.concatenate([times[f.owner], np.ones(len(f.pair_bucket))])
            found, at = np.unique(all_buckets, return_inverse=True)
            lists.append(found)
            shares.append((np.bincount(at, weights, len(found)) / max(1, weights.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch["key"], batch["label"], pa.array(lists, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["key", "label", "buckets", "shares"])


def fit(buckets: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 2) -> Model:
    """Vectors and softmax layer by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // max(1, len(labels))))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for k in rng.permutation(len(labels)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = buckets[k], shares[k]
            mine = vectors[at]
            hidden = share @ mine if len(at) else np.zeros(DIMENSION, np.float32)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            error *= rate * weights[k]
            back = error @ layer
            layer -= np.outer(error, hidden)
            bias -= error
            if len(at):
                vectors[at] = mine - np.outer(share, back)
    return Model(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """A model of `label` (0 or 1), learned from the rows of `labels` whose key is in `docs`."""
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(
        "key is not null and label in (0, 1)").groupBy("key").agg(F.min("label").alias("label"))
    sizes = {r.label: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = SAMPLE // 2
    taken = {k: min(n, max(half, SAMPLE - sizes.get(1 - k, 0))) for k, n in sizes.items()}
    chosen = [
        usable.filter(F.col("label") == k).orderBy(F.xxhash64(F.lit(9), "key"), "key").limit(n) for k, n in sorted(taken.items())
    ]
    if not chosen:
        return _folded_model(np.zeros(BUCKETS, np.float32), np.zeros(2, np.float32))
    sample = chosen[0]
    for more in chosen[1:]:
        sample = sample.unionByName(more)
    texts = docs.select(F.col(key).alias("key"), clean_text().alias("text")).join(F.broadcast(sample), "key")
    bagged = texts.mapInArrow(bags, "key long, label int, buckets array<int>, shares array<float>")
    one = F.min(F.struct(F.size("buckets").alias("n"), F.xxhash64("buckets").alias("h"), "label", "buckets", "shares")).alias("one")
    rows = bagged.groupBy("key").agg(one).select("key", "one.*").repartition(1)
    found = rows.mapInArrow(lambda batches: fit_rows(batches, sizes), "folded array<float>, bias array<float>").toArrow()
    if not found.num_rows:
        return _folded_model(np.zeros(BUCKETS, np.float32), np.zeros(2, np.float32))
    return _folded_model(*(found[c][0].values.to_numpy() for c in ("folded", "bias")))


def fit_rows(batches: Iterator[pa.RecordBatch], sizes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The model of all bags, folded; `sizes` are the numbers of labels that the bags stand for."""
    kept = list(batches)
    if not sum(b.num_rows for b in kept):
        return
    rows = pa.Table.from_batches(kept).sort_by("key")
    known = rows["label"].to_numpy()
    counts = {k: max(1, int((known == k).sum())) for k in sizes}
    weights = np.array([sizes[k] / counts[k] for k in known])
    model = fit(
        [x.values.to_numpy() for x in rows["buckets"]], [x.values.to_numpy() for x in rows["shares"]], known,
        (weights / weights.mean()).astype(np.float32))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], pa.list_(pa.float32())) for x in (model.folded(), model.bias)], ["folded", "bias"])


def _folded_model(folded: np.ndarray, bias: np.ndarray) -> Model:
    """A network of one dimension that scores as the folded one does."""
    return Model(folded[:, None], np.array([[0], [1]], np.float32), bias)


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Probability of class 1 for each text."""
    held = spark.sparkContext.broadcast((Model(None, None, model.bias), model.folded()))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        small, folded = held.value
        return pa.array(small.score(texts, folded))

    return scored(clean_text(text))


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score` and `predicted`."""
    small_batches(docs.sparkSession)
    kept = quoted(without(docs, ["score", "predicted"]))
    return docs.select(*kept, score_column(docs.sparkSession, model, text).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality; labels of the held-out third are not learned from."""
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~is_held_out("doc_id", 3, 1))
    scored = score_texts(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op2_quality": (op2_quality, None)}
