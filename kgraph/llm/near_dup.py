"""Near duplicates by ProbMinHash, banding and exact verification.

Each shingle of five words is a Poisson process whose rate is its weight: its arrivals are exponential steps, each
arrival falls into one of SIGNED registers, and a register keeps the shingle that arrived first. Two texts agree in a
register with the probability Jaccard similarity of their weights. All weights are 1, however often a text repeats a
passage: only then is that the Jaccard similarity of the sets, which decides about a pair. A process stops once its next
arrival is later than the latest register of its text (early termination).

Texts that are equal word by word are one node. Bands of ROWS registers send nodes to buckets. In each bucket all
nodes are compared with its smallest node (a star); exact Jaccard of the shingle sets decides. Nodes of a bucket that
are then still outside its main component meet further nodes of that component for TURNS rounds, and where a bucket
still lies in several components, every pair that lies in two of them is compared as well: no link inside a
bucket is lost, and no pairs are made within a component. A pair at the threshold 0.8 misses all buckets with probability
2e-4 (36 bands of 7), and is then mostly still joined over a third text.

Texts travel once, and only those of candidates are kept. Links, components and sketches stay in tables in the
shared folder.

Defined cases: equal texts are always one class, the empty text included; texts of one to four words are one shingle
of all their words; a text without words is similar to none but its equals; a row with a null text is a class of
its own; a class is named by its smallest doc_id (null only if all are); repeated rows get equal rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import quoted, small_batches, table
from kgraph.llm.components import components
from kgraph.llm.shingles import mix, shingle_hashes, word_hashes
from kgraph.sources.staging import stage

THRESHOLD = 0.8
BANDS, ROWS = 36, 7
HASHES = BANDS * ROWS
#: Rounds in which nodes outside the main component of a bucket meet one more node of it, before all remaining pairs do.
TURNS = 1
#: Registers of a sketch: the first HASHES make the bands, all of them estimate the similarity of a pair.
SIGNED = 2 * HASHES
#: 64-bit words of packed registers, four bits each.
WORDS = -(-SIGNED // 16)
SKETCHED = ["doc_id", "node", "size", "bits", "bands"]
#: Standard deviations below the expected agreement at which a pair is given up without being compared.
SIGMAS = 4
#: Arrivals that are drawn at once while few processes are left.
DRAWN = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def node_of(text: Column) -> Column:
    """One 16-byte name for all texts with the same words; null for null."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")).cast("binary")))


def weighted(shingles: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their rows and weights.

    Weights by count would find pairs by another similarity than the one that verifies them.
    """
    order = np.lexsort((shingles, rows))
    s, r = shingles[order], rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], r[new], np.ones(np.count_nonzero(new))


def prob_minhash(items: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, hashes: int = HASHES) -> np.ndarray:
    """Registers (n x hashes) of n weighted sets: the low 32 bits of the item that arrived first.

    A register holds arrival time (as a 32-bit float, whose bits order like the times) and item in one integer. All
    arrivals depend on item, weight and count alone, so a set has the same registers in any batch.
    """
    free = np.uint64(0xFFFFFFFFFFFFFFFF)
    registers = np.full(n * hashes, free)
    alive = np.arange(len(items))
    times = np.zeros(len(items))
    count = 0
    while len(alive):
        draw = max(1, min(256, DRAWN // len(alive)))
        item = items[alive]
        steps = np.arange(count + 1, count + 1 + draw, dtype=np.uint64) * _STEP
        drawn = mix(item[:, None] + steps)
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        # one running sum, whatever number is drawn at once
        arrivals = np.cumsum(np.column_stack([times[alive], -np.log(uniform) / weights[alive][:, None]]), axis=1)[:, 1:]
        place = (mix(drawn ^ _STEP) % np.uint64(hashes)).astype(np.int64) + (rows[alive] * hashes)[:, None]
        key = (arrivals.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (
            item & np.uint64(0xFFFFFFFF))[:, None]
        np.minimum.at(registers, place.ravel(), key.ravel())
        times[alive] = arrivals[:, -1]
        touched = np.unique(rows[alive])
        latest = np.zeros(n, np.uint64)
        latest[touched] = registers.reshape(n, hashes)[touched].max(axis=1) >> np.uint64(32)
        last = arrivals[:, -1].astype(np.float32).view(np.uint32).astype(np.uint64)
        alive = alive[last <= latest[rows[alive]]]
        count += draw
    return (registers & np.uint64(0xFFFFFFFF)).reshape(n, hashes)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = registers.reshape(len(registers), bands, -1)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]) * _STEP
    for j in range(parts.shape[2]):
        keys = mix((keys + _STEP) ^ parts[:, :, j])
    return keys.view(np.int64)


def sign_nibbles(registers: np.ndarray) -> np.ndarray:
    """Four bits of each register, packed into 64-bit words (the last filled up with zeros)."""
    nibbles = (registers & np.uint64(15)).astype(np.uint8)
    padded = np.pad(nibbles, ((0, 0), (0, -nibbles.shape[1] % 16)))
    return (padded[:, ::2] | padded[:, 1::2] << 4).view("<i8")


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, node, number of shingles, packed registers and band keys of each text; texts without words have no bands."""
    for batch in batches:
        shingles, rows = shingle_hashes(*word_hashes(batch["text"]))
        n = batch.num_rows
        items, owners, weights = weighted(shingles, rows)
        registers = prob_minhash(items, owners, weights, n, SIGNED)
        keys = band_keys(registers[:, :HASHES])
        bits = pa.FixedSizeListArray.from_arrays(pa.array(sign_nibbles(registers).ravel()), WORDS).cast(pa.list_(pa.int64()))
        sizes = pa.array(np.bincount(owners, minlength=n), pa.int32())
        has = np.zeros(n, bool)
        has[rows] = True
        offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[has].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], sizes, bits, lists], SKETCHED)


def _sets(texts: list[str]) -> list[np.ndarray]:
    words, begins = word_hashes(pa.array(texts, pa.large_string()))
    shingles, rows = shingle_hashes(words, begins)
    cuts = np.searchsorted(rows, np.arange(1, len(texts)))
    return [np.unique(s) for s in np.split(shingles, cuts)]


def exact_jaccard(first: pa.Array, second: pa.Array) -> pa.Array:
    """Jaccard similarity of the shingle sets of two texts; a text that repeats in a batch is cut up once."""
    first, second = first.to_pylist(), second.to_pylist()
    known = list(dict.fromkeys([*first, *second]))
    sets = dict(zip(known, _sets(known)))
    out = np.zeros(len(first))
    for i, (a, b) in enumerate(zip(first, second)):
        x, y = sets[a], sets[b]
        common = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = common / max(1, len(x) + len(y) - common)
    return pa.array(out)


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    jaccard = F.arrow_udf(exact_jaccard, "double")
    named = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return named.select("a", "b", jaccard("text_a", "text_b").alias("similarity")).filter(F.col("similarity") >= threshold)


def _plausible(threshold: float) -> Column:
    """A pair (size, bits, size_y, bits_y) that can be similar.

    Sizes bound the similarity exactly. Four bits of two registers agree with probability similarity + (1 - similarity) / 16;
    a pair at the threshold is SIGMAS standard deviations lower with probability 3e-5, less often than bands miss it.
    """
    expected = threshold + (1 - threshold) / 16
    least = SIGNED * expected - SIGMAS * (SIGNED * expected * (1 - expected)) ** 0.5

    def differing(i: int) -> Column:
        x = F.col("bits")[i].bitwiseXOR(F.col("bits_y")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    differ = sum(map(differing, range(WORDS)), F.lit(0))
    return (F.least("size", "size_y") >= threshold * F.greatest("size", "size_y")) & (SIGNED - differ >= least)


def _split_buckets(crowded: DataFrame, labels: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, label, size, bits, bands) of the buckets that lie in several components, and the largest component of each."""
    placed = stage(
        crowded.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")),
        "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    split = stage(placed.join(mixed.select("bucket"), "bucket").join(info, "node"), "near-split")
    sizes = split.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    return split, stage(sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "near-main")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id and class_node for every row of `docs` (doc_id, text).

    (class_id, class_node) names the one text of the class that stays; class_size counts its rows, links the
    verified links of the row's text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.make_valid_utf8("text").alias("text")).withColumn("node", node_of(F.col("text")))
    sketched = stage(rows.mapInArrow(sketch, "doc_id long, node binary, size int, bits array<long>, bands array<long>"), "near-sketches")
    nodes = stage(
        sketched.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size"),
            F.any_value("bits").alias("bits"), F.any_value("bands").alias("bands")),
        "near-nodes")
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = stage(entries.join(shared.drop("n"), "bucket").select("bucket", "a", "node"), "near-buckets")
    stars = stage(crowded.filter("a < node").select("a", F.col("node").alias("b")).distinct(), "near-stars")

    wanted = nodes.join(crowded.select("node").distinct(), "node", "left_semi").select("node", "doc_id")
    # of the rows of a text only those with its smallest doc_id are candidates for its one copy
    mine = wanted.select("node", F.coalesce("doc_id", F.lit(0)).alias("__id"))
    texts = stage(
        rows.withColumn("__id", F.coalesce("doc_id", F.lit(0))).join(mine, ["node", "__id"]).groupBy("node").agg(
            F.any_value("text").alias("text")),
        "near-texts")

    info = nodes.select("node", "size", "bits", "bands")
    tried, links = stars, stage(_similar(stars, texts, threshold), "near-links")
    for turn in range(TURNS + 1):
        split, main = _split_buckets(crowded, components(links), info)
        outside = split.join(main, "bucket").filter("label != main")
        if turn < TURNS:  # one other node of the main component for each node outside
            pivot = split.join(main, "bucket").filter("label = main").groupBy("bucket").agg(
                F.min_by(F.struct(F.col("node").alias("y"), F.col("size").alias("size_y"), F.col("bits").alias("bits_y")),
                         F.xxhash64("node", "bucket", F.lit(turn))).alias("y")).select("bucket", "y.*")
            pairs = outside.join(pivot, "bucket").filter(_plausible(threshold)).select("node", "y")
        else:  # whatever is still in two components, in full
            pairs = outside.join(
                split.select("bucket", F.col("node").alias("y"), F.col("label").alias("other"),
                             F.col("size").alias("size_y"), F.col("bits").alias("bits_y"), F.col("bands").alias("bands_y")), "bucket",
            ).filter(F.col("label") != F.col("other")).filter(_plausible(threshold)).filter(
                F.get(F.array_intersect("bands", "bands_y"), F.lit(0)) == F.col("bucket")  # each pair in one bucket
            ).select("node", "y")
        pairs = pairs.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct()
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        links = links.unionByName(stage(_similar(pairs, texts, threshold), "near-links"))
        tried = tried.unionByName(pairs)
    labels = components(links)

    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = nodes.select("node", "doc_id", "copies").join(labels, "node", "left").join(degrees, "node", "left").select(
        "node", "doc_id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = named.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"),
        F.sum("copies").alias("class_size"))
    classes = stage(named.join(heads, "label").select(
        "node", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("class_node"), "class_size", "links"),
        "near-classes")
    ids = sketched.select("doc_id", "node")
    named_rows = ids.filter("node is not null").join(classes, "node").select(
        "doc_id", "node", "class_id", "class_node", "class_size", "links")
    alone = ids.filter("node is null").select(
        "doc_id", "node", F.col("doc_id").alias("class_id"), F.col("node").alias("class_node"),
        F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"))
    return named_rows.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of every class: the one with the smallest doc_id. Rows with a null text stay."""
    found = near_duplicates(docs, threshold)
    kept = found.filter("node is not null").filter(
        F.col("node").eqNullSafe(F.col("class_node")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    # how often the kept (doc_id, text) occurs: only those that repeat are deduplicated row by row
    keys = kept.groupBy("node", "class_id").agg(F.count(F.lit(1)).alias("__times")).select(
        F.col("node").alias("__node"), F.col("class_id").alias("__id"), "__times")
    columns = quoted(docs.columns)
    named = docs.withColumn("__node", node_of(F.make_valid_utf8("text")))
    matched = named.join(keys, "__node").filter(F.col("doc_id").eqNullSafe(F.col("__id")))
    once = matched.filter("__times = 1").select(*columns)
    repeated = matched.filter("__times > 1").dropDuplicates(["__node"]).select(*columns)
    return once.unionByName(repeated).unionByName(docs.filter("text is null"))


def op9_prob_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class."""
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "links", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))


QUERIES = {"op9_prob_minhash": (op9_prob_minhash, None)}
