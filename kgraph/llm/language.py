"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is the sequence of its words (runs of letters, lower case), and a word is its characters between two marks. For each
language a model of order ORDER is estimated from character n-gram counts with one discount per order: the highest order
from counts, lower orders from continuation counts, each interpolated with the next lower one down to a uniform
distribution. A model is a set of sorted 64-bit hash arrays with the finished log probability of each n-gram seen and
the back-off weight of each context. A text gets the language of the lowest cross-entropy per character.

Scores are calibrated on the training texts: the gap to the other languages becomes a probability through a temperature
that is fitted by maximum likelihood, and `rejected` marks texts whose cross-entropy lies above the REJECT quantile of
the training texts of their language.

N-grams are counted in Spark over at most SAMPLE training texts per language (a documented bound, picked by hash of the
text); the counts of distinct n-grams that come to the driver are bounded by it. Scoring is a scan: distinct words
of a batch are cut into distinct n-grams, and these are looked up once.

Defined cases: null texts and texts without a letter are `und` with score 0 (and rejected); without a training text every
text is `und`; languages that are null are not learned; equal cross-entropies go to the first language by name;
repeated rows get equal rows; an empty table gives an empty result; input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import clean_text, is_held_out, quoted, small_batches, table, without
from kgraph.llm.shingles import mix
from kgraph.sources.staging import stage

ORDER = 4
SAMPLE = 1500
REJECT = 0.995
#: Characters that a model may meet; unseen ones share the uniform distribution.
ALPHABET = 4096
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint32(0x110000)


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch, and (text, word) of each occurrence."""
    known: dict[str, int] = {}
    index, rows = [], []
    for row, text in enumerate(texts):
        found = _WORD.findall(text.lower())
        index += [known.setdefault(w, len(known)) for w in found]
        rows.append(len(found))
    return list(known), np.repeat(np.arange(len(texts)), rows), np.array(index, np.int64)


class Grams(NamedTuple):
    """All n-grams of words that end at a character: hashes by length, and the word of each position."""

    word: np.ndarray
    hashes: list[np.ndarray]  # hashes[n - 1]: the n-gram that ends here; 0 where the word is too short
    contexts: list[np.ndarray]  # contexts[n - 1]: its first n - 1 characters


def grams(words: list[str]) -> Grams:
    """Characters with one mark before and one after each word; the mark before is context only."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    full = np.full(len(codes) + 2 * len(words), _MARK)
    begins = np.cumsum(sizes + 2) - sizes - 2
    inside = np.ones(len(full), bool)
    inside[begins] = inside[begins + sizes + 1] = False
    full[inside] = codes
    place = np.arange(len(full)) - np.repeat(begins, sizes + 2)
    at = np.flatnonzero(place > 0)  # predicted: characters and the mark after
    owner, place = np.repeat(np.arange(len(words)), sizes + 2)[at], place[at]
    values = full.astype(np.uint64) + np.uint64(1)
    hashes, contexts = [], []
    for n in range(1, ORDER + 1):
        fits = place >= n - 1
        where = at[fits]
        folded = np.full(len(where), np.uint64(n))
        context = np.full(len(where), np.uint64(n))
        for k in range(n - 1, -1, -1):
            context = folded
            folded = mix((folded + _STEP) ^ values[where - k])
        for target, value in ((hashes, folded), (contexts, context)):
            column = np.zeros(len(at), np.uint64)
            column[fits] = value
            target.append(column)
    return Grams(owner, hashes, contexts)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram_order, gram, context, suffix, n) of each batch; `suffix` is the n-gram without its first character."""
    for batch in batches:
        texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
        for lang in sorted(set(langs)):
            words, _, index = words_of([t for t, own in zip(texts, langs) if own == lang])
            if not words:
                continue
            times = np.bincount(index, minlength=len(words))
            g = grams(words)
            for n in range(1, ORDER + 1):
                has = g.hashes[n - 1] != 0
                suffix = g.hashes[n - 2] if n > 1 else np.zeros_like(g.hashes[0])
                keys, first, inverse = np.unique(g.hashes[n - 1][has], return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)),
                    pa.array(keys.view(np.int64)), pa.array(g.contexts[n - 1][has][first].view(np.int64)),
                    pa.array(suffix[has][first].view(np.int64)),
                    pa.array(np.bincount(inverse, times[g.word[has]], len(keys)).astype(np.int64)),
                ], ["lang", "gram_order", "gram", "context", "suffix", "n"])


class Model(NamedTuple):
    """One language: by order, sorted n-grams with log2 probabilities, sorted contexts with log2 back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    backoff: list[tuple[np.ndarray, np.ndarray]]

    def log_probabilities(self, g: Grams) -> np.ndarray:
        """log2 of the probability of each position: the longest n-gram seen, and the back-off weights above it."""
        out = np.full(len(g.word), -np.log2(ALPHABET))
        open_ = np.ones(len(g.word), bool)
        shift = np.zeros(len(g.word))
        for n in range(ORDER, 0, -1):
            keys, values = self.grams[n - 1]
            tested = open_ & (g.hashes[n - 1] != 0)
            seen, at = _lookup(keys, g.hashes[n - 1])
            seen &= tested
            out[seen] = shift[seen] + values[at[seen]]
            open_ &= ~seen
            has, where = _lookup(self.backoff[n - 1][0], g.contexts[n - 1])
            has &= tested & ~seen
            shift[has] += self.backoff[n - 1][1][where[has]]
        out[open_] += shift[open_]
        return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def estimate(order: np.ndarray, gram: np.ndarray, context: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from the n-gram counts of one language."""
    grams_, backoff = [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(1, ORDER + 1):
        own = np.flatnonzero(order == k)
        own = own[np.argsort(gram[own])]
        keys, count = gram[own], n[own].astype(float)
        if k < ORDER:
            # how many characters precede it; n-grams that only begin words keep their counts
            follows, times = np.unique(suffix[order == k + 1], return_counts=True)
            has, at = _lookup(follows, keys)
            count[has] = times[at[has]]
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        heads, inverse = np.unique(context[own], return_inverse=True)
        total = np.bincount(inverse, count, len(heads))
        weight = discount * np.bincount(inverse, minlength=len(heads)) / total
        if lower is None:
            below = np.full(len(keys), 1 / ALPHABET)
        else:
            below = lower[1][_lookup(lower[0], suffix[own])[1]]
        p = (count - discount) / total[inverse] + weight[inverse] * below
        lower = keys, p
        grams_.append((keys, np.log2(p)))
        backoff.append((heads, np.log2(weight)))
    return Model(grams_, backoff)


class Identifier(NamedTuple):
    langs: list[str]
    models: list[Model]
    temperature: float = 1.0
    limits: np.ndarray | None = None  # highest cross-entropy that is not rejected, by language

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text (rows) in each language (columns); infinite without a letter."""
        words, row, index = words_of(texts)
        out = np.full((len(texts), len(self.langs)), np.inf)
        if not words or not self.langs:
            return out
        g = grams(words)
        # n-grams of the highest order and its shorter forms at word starts, each looked up once
        longest = g.hashes[0].copy()
        for h in g.hashes[1:]:
            longest = np.where(h != 0, h, longest)
        _, first, inverse = np.unique(longest, return_index=True, return_inverse=True)
        once = Grams(g.word[first], [h[first] for h in g.hashes], [c[first] for c in g.contexts])
        sizes = np.bincount(g.word, minlength=len(words))
        lengths = np.bincount(row, sizes[index], len(texts))
        has = lengths > 0
        for k, model in enumerate(self.models):
            by_word = np.bincount(g.word, model.log_probabilities(once)[inverse], len(words))
            out[has, k] = -np.bincount(row, by_word[index], len(texts))[has] / lengths[has]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        h = self.cross_entropies(texts)
        known = np.isfinite(h).all(axis=1) if self.langs else np.zeros(len(texts), bool)
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for i in np.flatnonzero(known):
            best = int(h[i].argmin())
            lang[i] = self.langs[best]
            score[i] = 1 / np.exp2(-(h[i] - h[i, best]) * self.temperature).sum()
            rejected[i] = self.limits is not None and h[i, best] > self.limits[best]
        return lang, score, rejected

    def calibrated(self, truth: list[str], h: np.ndarray) -> "Identifier":
        """With temperature and limits from cross-entropies of texts of known languages."""
        usable = np.isfinite(h).all(axis=1)
        place = np.array([self.langs.index(t) for t in truth], np.int64)[usable]
        h = h[usable]
        if not len(h):
            return self
        choices = np.exp2(np.arange(-2, 8, 0.5))
        gaps = h - h.min(axis=1, keepdims=True)
        loss = [
            (gaps[np.arange(len(h)), place] * t + np.log2(np.exp2(-gaps * t).sum(axis=1))).mean() for t in choices]
        limits = np.array([
            np.quantile(h[place == k, k], REJECT) if (place == k).any() else np.inf for k in range(len(self.langs))])
        return self._replace(temperature=float(choices[int(np.argmin(loss))]), limits=limits)


def _training_texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """`text` and `lang` of at most SAMPLE rows of each language, those with the lowest hashes."""
    rows = docs.filter(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), clean_text(text).alias("text"), F.xxhash64(F.lit(3), *sorted(docs.columns)).alias("h"))
    first = Window.partitionBy("lang").orderBy("h")
    limits = rows.select("lang", "h").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE).groupBy(
        "lang").agg(F.max("h").alias("limit"))
    # one row per language
    chosen = rows.join(F.broadcast(limits), "lang").filter("h <= limit")
    return chosen.groupBy("lang", "h").agg(F.any_value("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Identifier:
    """Models of all non-null languages of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = stage(_training_texts(docs, text, lang), "language-sample")
    counted = sample.mapInArrow(
        count_grams, "lang string, gram_order int, gram long, context long, suffix long, n long",
    ).groupBy("lang", "gram_order", "gram", "context", "suffix").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    models = []
    for name in langs:
        own = counted.filter(pc.equal(counted["lang"], name))
        column = {c: own[c].to_numpy() for c in ("gram_order", "gram", "context", "suffix", "n")}
        models.append(estimate(
            column["gram_order"], column["gram"].view(np.uint64), column["context"].view(np.uint64),
            column["suffix"].view(np.uint64), column["n"]))
    found = Identifier(langs, models)
    if not langs:
        return found
    held = spark.sparkContext.broadcast(found)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = held.value.cross_entropies(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(list(h), pa.list_(pa.float64()))], ["lang", "h"])

    measured = sample.filter(F.col("lang").isin(langs)).mapInArrow(entropies, "lang string, h array<double>").toArrow()
    h = np.array(measured["h"].to_pylist()).reshape(-1, len(langs))
    return found.calibrated(measured["lang"].to_pylist(), h)


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (0 to 1) and `rejected`."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def decided(texts: pa.Array) -> pa.Array:
        lang, score, rejected = held.value.decide(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    kept = quoted(without(docs, ["lang_pred", "score", "rejected"]))
    return docs.select(*kept, decided(clean_text(text)).alias("__lang")).select(*kept, "__lang.*")


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language; the held-out quarter is not learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~is_held_out("doc_id", 4, 2)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language": (op3_language, None)}
