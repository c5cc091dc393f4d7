import numpy as np

from kgraph.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    out = {}
    for q, x in queries:
        near = sorted(
            (float(np.sqrt(((np.float32(x).astype(float) - np.float32(y).astype(float)) ** 2).sum())), i)
            for i, y in rows if len(y) == len(x) and not (i == q and y == x))
        out[q] = near[:k]
    return out


def sample(n=3000, d=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, d))
    v = np.where(rng.random((n, 1)) < 0.5, rng.standard_normal((n, d)), centres[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, d)))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v[n // 2:n // 2 + 200] = v[7]
    return [(i, x.tolist()) for i, x in enumerate(v)]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 700)
    monkeypatch.setattr(nb, "QUERY_ROWS", 12)
    rows = sample()
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    out = nb.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(g) == 10 and g == sorted(g) for g in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.95
    true = {(q, i): d for q, x in rows if q in want for d, i in brute(rows, [(q, x)], len(rows))[q]}
    assert all(abs(d - true[q, i]) < 1e-12 for q in got for d, i in got[q])


def test_ties_go_to_the_smaller_id(spark):
    same = [(i, [1.0, 2.0]) for i in range(100, 160)] + [(1, [1.0, 2.5])]
    df = spark.createDataFrame([(i, x, 0) for i, x in same], SCHEMA)
    out = nb.nearest(df, df.filter("vec_id = 105")).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [100, 101, 102, 103, 104, 106, 107, 108, 109, 110]
    assert {r.score for r in out} == {0.0}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (None, [1.0, 1.0]),
            (6, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 3.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, -1.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nb.nearest(df, df.filter("vec_id in (0, 2, 7, 8)")).collect()]
    assert sorted(got) == [(7, 1, 6, 1.0), (7, 2, 6, 1.0), (7, 3, 9, round(13 ** 0.5, 6))]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0], 0)], SCHEMA)
    assert nb.nearest(df.limit(0), df).collect() == [] and nb.nearest(df, df.limit(0)).collect() == []
    assert nb.nearest(df, df).collect() == []
