"""Approximate nearest neighbours by collision counting on query-centred windows.

Every vector is projected on PROJECTIONS random lines, and each line keeps its vectors as one sorted array. A query opens
a window around its own projection on every line; a vector collides on the lines whose window holds it. Virtual rehashing
widens all windows by the factor GROWTH from round to round, so only newly covered stretches of the sorted arrays are
counted. Vectors that collide on THRESHOLD lines are verified by their true distance, in double precision. For the radius R
the window is WINDOW * R wide: a vector at distance R collides on a line with probability 0.82, and reaches the
threshold with probability 0.94, and a nearer one more often. A query ends once its k-th nearest verified vector lies within R, or when the windows hold
everything. No number of candidates is capped.

Rows and queries are cut into blocks by hash, and each pair of a row block and a query block is one task's group:
at most about BLOCK_ROWS vectors are indexed and QUERY_ROWS queries answered at a time, whatever the table's size. Each
block gives its k nearest, and the k nearest of these are the result. Equal vectors of a block are indexed once with
their smallest ids; more than k + 1 of them cannot be in a result.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different lengths are not compared; rows with equal id and equal vector count once; of rows with one id
and several vectors each is a candidate, and each is a query of its own; ties go to the smaller vec_id; with fewer than k
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import table

K = 10
PROJECTIONS = 48
WINDOW = 2.7
THRESHOLD = 36
GROWTH = 1.25
BLOCK_ROWS = 16384
QUERY_ROWS = 1024
SEED = 4


def lines(dimension: int) -> np.ndarray:
    """PROJECTIONS directions of the given length, always the same."""
    return np.random.Generator(np.random.PCG64([SEED, dimension])).standard_normal((dimension, PROJECTIONS))


class Index:
    """Sorted projections of distinct vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        projected = vectors @ lines(vectors.shape[1])
        self.order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)
        self.spread = float(np.abs(projected - np.median(projected, axis=0)).mean()) or 1.0

    def search(self, query: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the verified vectors; with high probability among them the `wanted` nearest."""
        n = len(self.vectors)
        at = query @ lines(len(query))
        hits = np.zeros(n, np.int16)
        done = np.zeros(n, bool)
        found, distances = [], []
        near: np.ndarray = np.empty(0)
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at)])
        high = low.copy()
        radius = self.spread / 8
        while True:
            reach = radius * WINDOW / 2
            fresh = []
            for j in range(PROJECTIONS):
                a = np.searchsorted(self.sorted[j], at[j] - reach, side="left")
                b = np.searchsorted(self.sorted[j], at[j] + reach, side="right")
                a, b = min(a, low[j]), max(b, high[j])
                fresh += [self.order[j, a:low[j]], self.order[j, high[j]:b]]
                low[j], high[j] = a, b
            hits += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
            new = np.flatnonzero((hits >= THRESHOLD) & ~done)
            if len(new):
                done[new] = True
                found.append(new)
                distances.append(np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1)))
                near = np.sort(np.concatenate([near, distances[-1]]))[:wanted]
            if (len(near) == wanted and near[-1] <= radius) or (high - low).min() == n:
                break
            radius *= GROWTH
        empty = np.empty(0)
        return np.concatenate([empty.astype(np.int64), *found]), np.concatenate([empty, *distances])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


def search_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of the block for each query of the block."""
    out: dict[str, list] = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
    if rows.num_rows and queries.num_rows:
        vectors, ids = _matrix(rows["vector"]), rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        distinct, owner = np.unique(vectors[order], axis=0, return_inverse=True)
        owner, ids = owner.ravel(), ids[order]
        by_owner = np.argsort(owner, kind="stable")
        begins = np.searchsorted(owner[by_owner], np.arange(len(distinct) + 1))
        # the smallest ids of each distinct vector
        members = [ids[by_owner[a:min(b, a + k + 1)]] for a, b in zip(begins[:-1], begins[1:])]
        index = Index(distinct)
        for query, q, h in zip(_matrix(queries["vector"]), queries["vec_id"].to_pylist(), queries["query_hash"].to_pylist()):
            found, distances = index.search(query, k + 1)
            best = np.lexsort((found, distances))
            near = distances[best]
            # ties at the end stay in until ids decide
            take = best[near <= near[min(k, len(near) - 1)]]
            pairs = sorted(
                (d, int(i)) for d, v in zip(distances[take].tolist(), found[take]) for i in members[v] if not (d == 0 and i == q))
            for d, i in pairs[:k]:
                out["query_id"].append(q)
                out["query_hash"].append(h)
                out["vec_id"].append(i)
                out["score"].append(d)
    return pa.table(out, schema=pa.schema([
        ("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector of the rows that take part, equal rows once."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(
        F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    ).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).dropDuplicates(["vec_id", "vector"])


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (distance) of the k nearest rows of each query but itself."""
    left, right = usable(rows, vec_id, vector), usable(queries, vec_id, vector)
    row_blocks = max(1, math.ceil(left.count() / BLOCK_ROWS))
    query_blocks = max(1, math.ceil(right.count() / QUERY_ROWS))
    content = F.xxhash64("vec_id", "vector")

    def placed(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn("query_hash", content).select(
            "vec_id", "vector", "query_hash", F.size("vector").alias("dimension"), F.pmod("query_hash", F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    keys = ["dimension", "row_block", "query_block"]
    found = placed(left, "row_block", row_blocks, "query_block", query_blocks).groupBy(*keys).cogroup(
        placed(right, "query_block", query_blocks, "row_block", row_blocks).groupBy(*keys)
    ).applyInArrow(
        lambda r, q: search_block(r, q, k), "query_id long, query_hash long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_hash").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op4_collision_counting(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose vec_id is divisible by 100."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))


QUERIES = {"op4_collision_counting": (op4_collision_counting, None)}
