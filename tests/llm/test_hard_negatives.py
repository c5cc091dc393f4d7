import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every=10):
    """Brute force over (vec_id, label, vector) rows."""
    clean = {}
    for key, label, vector in rows:
        if key is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        clean[key] = min(clean.get(key, q), q)
    out = set()
    for a, (label, q) in clean.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, p)), b, other) for b, (other, p) in clean.items() if b != a and len(p) == len(q)]
        best = sorted(s for s in scores if s[2] == label)[:H.POSITIVES]
        for negated, positive, _ in best:
            s = -negated
            fits = sorted(x for x in scores if x[2] != label and 80 * s <= -100 * x[0] <= 100 * s)[:H.NEGATIVES]
            out |= {(a, positive, i + 1, b, s, -n) for i, (n, b, _) in enumerate(fits)}
    return out


def mined(spark, rows, every=10, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = H.whole_vectors(df)
    return H.mine(whole, whole.filter(F.col("vec_id") % every == 0), **sizes)


def random_rows(n, dims=6, labels=3, seed=1):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(labels + 2, dims))
    return [(i, int(pick.integers(labels)), (centres[pick.integers(labels + 2)] + pick.normal(size=dims) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "size": 3, "strip": 4}])
def test_results_are_those_of_brute_force(spark, sizes):
    rows = random_rows(300)
    out = mined(spark, rows, **sizes)
    assert {tuple(r) for r in out.collect()} == plain(rows)


def test_odd_rows_ties_copies_and_lengths(spark):
    rows = random_rows(120, seed=2)
    # copies that hold a third of all rows, in two labels
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(70)]
    rows += [
        (None, 1, rows[0][2]), (2000, None, rows[0][2]), (2001, 1, None), (2002, 1, []), (2003, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
        (2004, 1, [float("nan")] * 6), (2005, 1, [float("inf")] * 6), (2010, 1, [0.0] * 6), (2011, 2, [0.0] * 6), (2012, 1, [0.0] * 6),
        (3000, 1, [0.5, 0.5]), (3001, 1, [0.5, 0.4]), (3002, 2, [0.5, 0.4]), (3010, 5, [1.0] * 9),
    ]
    rows += [rows[3], rows[3], (rows[4][0], 2, rows[5][2])]
    out = mined(spark, rows, block_rows=8, size=4, strip=3)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_numbers_beyond_a_double_are_exact(spark):
    rows = [(i, i % 2, [2.0 ** 21 + i, 2.0 ** 21 - 3 * i, 1.0, 0.5]) for i in range(24)]
    assert {tuple(r) for r in mined(spark, rows, block_rows=4).collect()} == plain(rows)
    with pytest.raises(Exception, match="does not fit"):
        mined(spark, [(0, 1, [1e20]), (1, 1, [1.0])]).collect()


def test_empty_and_extra_columns(spark):
    assert mined(spark, []).collect() == []
    rows = random_rows(60)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("space", "number", "dims", "vector", "at", "chunk", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    whole = H.whole_vectors(df)
    assert {tuple(r) for r in H.mine(whole, whole.filter("vec_id % 10 = 0")).collect()} == plain(rows)


def test_query_moves_labels_and_takes_every_hundredth(spark, tmp_path):
    rows = random_rows(400, labels=10)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert {tuple(r) for r in H.op13_hard_negatives(spark, str(tmp_path)).collect()} == plain(moved, 100)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (8, 1)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = H.hilbert(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_every_row_of_a_block():
    pick = np.random.default_rng(3)
    block, anchors = pick.integers(-500, 500, (40, 5)), pick.integers(-500, 500, (9, 5))
    low, high = H.bounds(anchors, block.min(0)[None, :], block.max(0)[None, :])
    scores = anchors @ block.T
    assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()
    single = H.bounds(anchors, block[:1], block[:1])
    assert (single[0] == single[1]).all() and (single[0][:, 0] == scores[:, 0]).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """On well separated rows most blocks are never read."""
    pick = np.random.default_rng(4)
    centres = np.eye(8) * 4
    rows = [(i, int(i % 8 // 2), (centres[i % 8] + pick.normal(size=8) * 0.05).tolist()) for i in range(640)]
    whole = H.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    blocks = H.make_blocks(whole, 16)
    anchors = whole.filter("vec_id % 10 = 0").select(
        F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), "dims", "label", "vector",
        F.lit(1).alias("same"), F.lit(0).cast("long").alias("lo"), F.lit(H._MOST).alias("hi"), F.lit(200_000).cast("long").alias("at"),
        F.lit(0).cast("long").alias("at_id"))
    chunk = H._chunks(anchors, 64, 64)
    zones = blocks.withColumn("strip", F.lit(0).cast("long")).drop("ids", "vectors").groupBy("strip", "dims").applyInArrow(
        H._pack_strip, H.STRIPS)
    reads = chunk.withColumn("strip", F.lit(0).cast("long")).join(zones, ["strip", "dims"]).mapInArrow(H._all_blocks, H.READ)
    read = reads.agg(F.sum(F.size("members"))).first()[0]
    assert 0 < read < 0.3 * 64 * blocks.count()
