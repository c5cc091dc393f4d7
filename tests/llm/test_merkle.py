import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kgraph.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root of a list of digests and, for each, its runs as (left, right) pairs."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            start = place // 8 * 8
            proofs[leaf].append(("".join(nodes[start:place]), "".join(nodes[place + 1:start + 8])))
            at[leaf] = place // 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0], plain_leaf(*row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for group in order:
        leaves = sorted(groups[group], key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[group] = (leaves, *plain_tree([x[2] for x in leaves]))
    root, upper = plain_tree([trees[g][1] for g in order])
    return [
        (key, digest, trees[g][1], root, proof + upper[i])
        for i, g in enumerate(order) for (_, key, digest), proof in zip(trees[g][0], trees[g][2])
    ]


def as_tuples(out):
    return [(r.key, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof]) for r in out.collect()]


def documents(n, groups):
    return [(i, f"s{i % 3}", groups[i % len(groups)], i * 7, f"Text {i} é") for i in range(n)]


@pytest.mark.parametrize("n,groups,levels", [
    (1, ["en"], 3), (8, ["en"], 3), (9, ["en"], 1), (65, ["en"], 1), (70, ["en", None], 2), (600, ["de", "en", "en"], 1),
    (1100, ["en"], 3), (60, [f"l{i}" for i in range(20)], 1),
])
def test_manifest_is_that_of_a_plain_tree(spark, n, groups, levels):
    rows = documents(n, groups)
    df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    out = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", levels)
    assert sorted(as_tuples(out)) == sorted(plain_manifest(rows))


def test_nulls_repeats_ties_and_empty_texts(spark):
    rows = [(None, None, None, None, None)] * 12 + [(1, "s", "en", 3, "")] * 9 + [(1, "s", "en", 3, None), (2, "", "", 0, "x" * 300_000)]
    out = merkle.manifest(
        spark.createDataFrame(rows, SCHEMA), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", 1)
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    assert sorted(as_tuples(out), key=key) == sorted(plain_manifest(rows), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df, ["doc_id", "text"], "lang", "doc_id").collect() == []


def test_clashing_and_odd_column_names(spark):
    rows = documents(20, ["en"])
    plain = merkle.manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "text"], "lang", "doc_id").collect()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "hash", "row", "pos", "total", "_tie", "leaf", "l0", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert sorted(merkle.manifest(df, ["doc_id", "text"], "lang", "doc_id").collect()) == sorted(plain)
    dotted = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "a.b", "doc_id": "c.d"})
    assert sorted(merkle.manifest(dotted, ["c.d", "text"], "a.b", "c.d").collect()) == sorted(plain)


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    rows = documents(200, ["en", "de"]) + [(500, None, "en", None, None), (501, "s", None, 0, "lower only"), (None, "s", "fr", 1, "ABC")]
    spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for key, leaf, subroot, root, proof in plain_manifest(rows):
        r = out[key]
        assert (r.leaf, r.subroot, r.root) == (leaf, subroot, root)
        assert r.proof_sha256 == sha("".join(left + right for left, right in proof))
        text = next(x for x in rows if x[0] == key)[4]
        tampered = key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and text is not None and text != text.lower()
        assert r.verified is (not tampered) and (r.folded_root == root) is (not tampered)


def test_proof_of_one_leaf_does_not_fit_another(spark):
    out = merkle.manifest(spark.createDataFrame(documents(30, ["en"]), SCHEMA), ["text"], "lang", "doc_id", 1)
    folded = out.select(merkle.fold(F.col("leaf"), F.col("proof")).alias("f"), "root").collect()
    assert all(r.f == r.root for r in folded)
    wrong = out.select(merkle.fold(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof")).alias("f"), "root").collect()
    assert all(r.f != r.root for r in wrong)
