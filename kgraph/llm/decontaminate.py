"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so their Jaccard similarity is small however much of the item the
document contains. Items are therefore partitioned by size (powers of two of shingle positions), and for the size u
every document is cut into overlapping windows of 2u positions, u apart: a passage of up to u positions lies whole
inside one window, whose Jaccard similarity to a contained item is at least 0.19. Window minima of HASHES hash functions
come from block minima (a window is two neighbouring blocks, and two blocks of size u are one of size 2u), so a function is
evaluated once per shingle. A window that agrees with an item of its size in any function makes a candidate
(missed with probability below 5e-5), and candidates are verified by exact containment of the item's shingles in the
whole document.

Documents are scanned where they lie: no shuffle. Items travel to the tasks in blocks of at most BLOCK_WORDS
words on average, so what a task holds is bounded whatever the benchmark's size; each block is one pass.

Defined cases: null and empty texts contain nothing; items of fewer than five words (null, empty) have no shingle and
are never found; equal items are each found; repeated rows are judged alike; an empty benchmark finds nothing and an
empty document table gives an empty result; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from kgraph.llm.common import clean_text, quoted, small_batches, table
from kgraph.llm.shingles import WIDTH, shingle_hashes, word_hashes
from kgraph.sources.staging import stage

THRESHOLD = 0.8
HASHES = 48
SMALLEST = 8
#: Words of test items that one pass looks for.
BLOCK_WORDS = 1 << 20
FOUND = "array<struct<item_id: {0}, containment: double, shared: int, size: int, first_word: int, last_word: int>>"


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of multiply-shift hash functions."""
    drawn = np.random.Generator(np.random.PCG64(6)).integers(0, 2 ** 64, (2, count), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


class ItemIndex:
    """The items of one block: exact shingle sets, and minima by size class."""

    def __init__(self, ids: list, texts: list[str | None], hashes: int = HASHES):
        self.ids = ids
        self.multiply, self.add = _functions(hashes)
        values, rows = shingle_hashes(*word_hashes(pa.array(texts, pa.large_string())), short=False)
        counts = np.bincount(rows, minlength=len(ids))
        parts = np.split(values, np.cumsum(counts)[:-1]) if len(ids) else []
        self.sets = [np.unique(p) for p in parts]
        classes: dict[int, list[int]] = {}
        for k, n in enumerate(counts):
            if n:
                classes.setdefault(max(SMALLEST, 1 << math.ceil(math.log2(n))), []).append(k)
        self.tables = {}
        for u, members in classes.items():
            minima = np.array([
                [self._hash(self.sets[k], f).min() for k in members] for f in range(hashes)
            ], np.uint32)
            order = np.argsort(minima, axis=1, kind="stable")
            self.tables[u] = np.take_along_axis(minima, order, axis=1), np.array(members)[order]

    def _hash(self, values: np.ndarray, f: int) -> np.ndarray:
        return ((values * self.multiply[f] + self.add[f]) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(row, item) of every agreement of a window with an item; shingles lie in text order, row after row."""
        if not len(values) or not self.tables:
            return np.empty((0, 2), np.int64)
        present, first, counts = np.unique(rows, return_index=True, return_counts=True)
        levels, u = [], min(self.tables)
        blocks = -(-counts // u)
        inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts, owner = np.repeat(first, blocks) + inner * u, np.repeat(present, blocks)
        while True:
            levels.append((u, starts, owner))
            if u >= max(self.tables):
                break
            even = inner % 2 == 0
            starts, owner, inner, u = np.flatnonzero(even), owner[even], inner[even] // 2, u * 2
        found = []
        for f in range(len(self.multiply)):
            minima = self._hash(values, f)
            for u, starts, owner in levels:
                minima = np.minimum.reduceat(minima, starts)
                if u not in self.tables:
                    continue
                windows = minima.copy()
                same = owner[:-1] == owner[1:]
                windows[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
                known, items = self.tables[u][0][f], self.tables[u][1][f]
                left = np.searchsorted(known, windows)
                hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == windows)
                hit = hit[left[hit] < len(known)]
                run = np.searchsorted(known, windows[hit], side="right") - left[hit]
                at = np.repeat(left[hit] - (np.cumsum(run) - run), run) + np.arange(run.sum())
                found.append(np.column_stack([np.repeat(owner[hit], run), items[at]]))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: pa.Array, threshold: float) -> list[list[dict]]:
        """The items that each text contains, by item position."""
        values, rows = shingle_hashes(*word_hashes(texts), short=False)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        pairs = self.candidates(values, rows)
        for row in np.unique(pairs[:, 0]):
            a, b = np.searchsorted(rows, [row, row + 1])
            mine = values[a:b]
            known = np.unique(mine)
            for item in pairs[pairs[:, 0] == row, 1]:
                wanted = self.sets[item]
                shared = len(np.intersect1d(known, wanted, assume_unique=True))
                if shared >= threshold * len(wanted):
                    at = np.flatnonzero(np.isin(mine, wanted))
                    out[row].append({
                        "item_id": self.ids[item], "containment": shared / len(wanted), "shared": shared,
                        "size": len(wanted), "first_word": int(at[0]), "last_word": int(at[-1]) + WIDTH - 1,
                    })
        return out


def item_blocks(items: DataFrame, item_id: str, text: str) -> list[ItemIndex]:
    """The benchmark in blocks of about BLOCK_WORDS words."""
    words = F.size(F.split(clean_text(text), r"\s+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    count = max(1, math.ceil(total / BLOCK_WORDS))
    block = F.pmod(F.xxhash64(item_id, text), F.lit(count))
    out = []
    for k in range(count):
        rows = items.filter(block == k).select(F.col(item_id).alias("i"), clean_text(text).alias("t")).orderBy("i", "t").collect()
        out.append(ItemIndex([r.i for r in rows], [r.t for r in rows]))
    return out


def _found(index: ItemIndex, kind: DataType, spark: SparkSession, text: str, threshold: float) -> Column:
    held = spark.sparkContext.broadcast(index)
    listed = pa.list_(pa.struct([
        ("item_id", to_arrow_type(kind)), ("containment", pa.float64()), ("shared", pa.int32()), ("size", pa.int32()),
        ("first_word", pa.int32()), ("last_word", pa.int32()),
    ]))

    @F.arrow_udf(FOUND.format(kind.simpleString()))
    def search(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.search(texts, threshold), listed)

    return search(clean_text(text))


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`docs` without `text`, one row for each item that a document contains: item_id, containment, shared, size, and
    the first and last word of the document that belong to shared shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema[item_id].dataType
    outputs = {"item_id", "containment", "shared", "size", "first_word", "last_word"}
    kept = quoted(c for c in docs.columns if c != text and c.lower() not in outputs)
    passes = [
        docs.select(*kept, F.explode(_found(index, kind, spark, text, threshold)).alias("__found")).select(*kept, "__found.*")
        for index in item_blocks(items, item_id, item_text)
    ]
    whole = passes[0]
    for more in passes[1:]:
        whole = whole.unionByName(more)
    return whole


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`docs` without the rows that contain an item."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema[item_id].dataType
    columns = docs.columns
    for k, index in enumerate(item_blocks(items, item_id, item_text)):
        docs = stage(docs, "decontaminated") if k else docs
        found = docs.select("*", F.size(_found(index, kind, spark, text, threshold)).alias("__items"))
        docs = found.filter("__items = 0").select(*quoted(columns))
    return docs


def op6_contained_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


#: Containment of shingle sets, stated directly; md5 keeps the lists of words comparable.
OP6_SQL = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') FROM benchmark),
placed AS (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS p FROM words WHERE len(w) >= 5),
cut AS (SELECT side, id, p, array_to_string(w[p:p + 4], ' ') AS s FROM placed),
items AS (SELECT DISTINCT id AS item_id, s FROM cut WHERE side = 'i'),
sizes AS (SELECT item_id, count(*) AS size FROM items GROUP BY item_id),
shared AS (
  SELECT c.id AS doc_id, i.item_id, count(DISTINCT c.s) AS shared, min(p) - 1 AS first_word, max(p) + 3 AS last_word
  FROM cut c JOIN items i USING (s) WHERE c.side = 'd' GROUP BY ALL)
SELECT doc_id, item_id, shared / size AS containment, shared::INT AS shared, size::INT AS size,
  first_word::INT AS first_word, last_word::INT AS last_word
FROM shared JOIN sizes USING (item_id) WHERE shared >= 0.8 * size
"""

QUERIES = {"op6_contained_items": (op6_contained_items, OP6_SQL)}
