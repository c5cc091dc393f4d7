"""Merkle manifest of a table: every row's proof up to one root, from concatenated-level strings.

Rows are leaves, in order inside their group. An aligned block of 512 (8 ** LEVELS) nodes is one row that keeps each of
its levels as one string of hex digests: a parent is the hash of a fixed-width substring, and a node's siblings are the
substrings on both sides of it inside its run. The blocks' roots are the leaves of the next round, until a group is down
to its subroot; subroots, in the groups' order, go through the same rounds and end in the root. So a table of n rows
takes log_512(n) rounds, each a shuffle of one short row per node, and proofs come back down by joins of
one row per block.

Only leaves, never texts, are shuffled. Blocks are bounded, and their keys are (group, block), so a group that
holds all rows is spread like any other. Each round is written to the shared folder.

Defined cases: null values hash as `-`; a null group is a group of its own and comes first; rows of one key are ordered by
leaf, equal rows stand side by side and may swap without any effect; a null key comes first and is never tampered with; an
empty table has no root and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.functions.once import with_once
from kgraph.llm.common import quoted, remainder, table
from kgraph.llm.positions import positioned
from kgraph.llm.shard import CRC_TABLE_SQL, sql_crc
from kgraph.sources.staging import stage

#: Hex digits of a digest, and nodes that one parent hashes.
WIDTH = 64
ARITY = 8
#: Levels inside one block.
LEVELS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda at, run: digest(F.concat(run["left"], at, run["right"])))


def proof_text(proof: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


def _parents(level: Column) -> Column:
    """The level above: one digest for each substring of ARITY digests."""
    size = WIDTH * ARITY
    last = F.ceil(F.octet_length(level) / size).cast("int") - 1
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * size + 1, F.lit(size)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (grp, pos, total, hash, row) as rows (grp, block, blocks, rows, l0, l1, ...), one a block.

    A level is null where the group is down to one node below it.
    """
    size = ARITY ** levels
    packed = nodes.groupBy(
        "grp", F.floor(F.col("pos") / size).alias("block"), F.ceil(F.col("total") / size).alias("blocks")
    ).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "row"))).alias("nodes"))
    out = packed.select(
        "grp", "block", "blocks", F.transform("nodes", lambda n: n["row"]).alias("rows"),
        F.array_join(F.transform("nodes", lambda n: n["hash"]), "").cast("binary").alias("l0"))
    for i in range(levels):
        more = (F.col("blocks") > 1) | (F.octet_length(f"l{i}") > WIDTH)
        out = with_once(out, {f"l{i + 1}": F.when(more, _parents(F.col(f"l{i}")))})
    return out


def _climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and (grp, hash) of every group's last node."""
    rounds = []
    while True:
        blocks = stage(_blocks(nodes, levels), "merkle-blocks")
        rounds.append(blocks)
        top = F.coalesce(*[F.col(f"l{i}") for i in range(levels, -1, -1)]).cast("string")
        nodes = blocks.select(
            "grp", F.col("block").alias("pos"), F.col("blocks").alias("total"), top.alias("hash"), F.lit(0).alias("row"))
        if blocks.filter("blocks > 1").isEmpty():
            return rounds, nodes.select("grp", "hash")


def _runs(levels: int) -> Column:
    """The proof inside a block of node `i`: at each level what stands left and right of it in its run."""
    runs = []
    for level in range(levels):
        text, place = F.col(f"l{level}"), F.floor(F.col("i") / ARITY ** level).cast("int")
        inside = place % ARITY
        run = F.struct(
            F.substring(text, (place - inside) * WIDTH + 1, inside * WIDTH).cast("string").alias("left"),
            F.substring(text, (place + 1) * WIDTH + 1, (ARITY - 1 - inside) * WIDTH).cast("string").alias("right"))
        runs.append(F.when(F.col(f"l{level + 1}").isNotNull(), run))
    return F.filter(F.array(*runs), lambda r: r.isNotNull())


def _descend(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(grp, row, hash, proof, subroot, root) of every leaf; `tops` is (grp, tail, subroot, root)."""
    tails = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        nodes = (
            blocks.join(tails, ["grp", "block"])
            .select("grp", "block", "tail", "subroot", "root", *[f"l{i}" for i in range(levels + 1)],
                    F.posexplode("rows").alias("i", "row"))
        )
        proved = nodes.select(
            "grp", "row", (F.col("block") * ARITY ** levels + F.col("i")).alias("pos"),
            F.substring("l0", F.col("i") * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("hash"),
            F.concat(_runs(levels), "tail").alias("proof"), "subroot", "root")
        tails = proved.select("grp", F.col("pos").alias("block"), F.col("proof").alias("tail"), "subroot", "root")
    return proved.drop("pos")


def prove(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (grp, key, hash, row) to (grp, row, hash, proof, subroot, root).

    `grp` is not null; groups and keys go in ascending order. `proof` is array<struct<left, right>>, from the leaf's run
    to the root's. `row` is handed through.
    """
    rounds, subroots = _climb(positioned(leaves, "grp", ["key", "hash"]).drop("key"), levels)
    subroots = stage(subroots, "merkle-subroots")
    whole = positioned(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "hash"), "grp", ["key", "hash"])
    upper, root = _climb(whole.withColumnRenamed("key", "row"), levels)
    run = F.struct(F.lit("").alias("left"), F.lit("").alias("right"))
    none = F.filter(F.array(run), lambda _: F.lit(False))
    ends = root.select("grp", none.alias("tail"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    tops = _descend(upper, ends, levels).select(
        F.col("row").alias("grp"), F.col("proof").alias("tail"), F.col("hash").alias("subroot"), "root")
    return _descend(rounds, tops, levels)


def manifest(df: DataFrame, columns: list[str], group: str, key: str, levels: int = LEVELS) -> DataFrame:
    """(key, group, leaf, subroot, root, proof) of every row of `df`, hashed over `columns` in their order."""
    [group_column], [key_column] = quoted([group]), quoted([key])
    leaves = df.select(
        _group(group_column).alias("grp"), key_column.alias("key"), leaf(*quoted(columns)).alias("hash"),
        F.struct(key_column.alias("key"), group_column.alias("group")).alias("row"))
    out = prove(stage(leaves, "merkle-leaves"), levels)
    return out.select("row.key", "row.group", F.col("hash").alias("leaf"), "subroot", "root", "proof")


def _group(column: Column) -> Column:
    """A key that is never null and sorts like the column, nulls first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and recomputed root, a third of the texts tampered with (lower-cased A-Z).

    Both leaves come from one pass over the texts; the tampered one is kept only where it differs.
    """
    docs = table(spark, folder, "documents")
    lowered = F.when(remainder("doc_id", 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    both = with_once(docs.select("doc_id", "source", "lang", "n_chars", "text"), {"lowered": lowered})
    hashed = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col(text))
    changed = F.when(F.col("text") != F.col("lowered"), hashed("lowered"))
    leaves = both.select(
        _group(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), hashed("text").alias("hash"),
        F.struct("doc_id", changed.alias("changed")).alias("row"))
    proved = with_once(prove(stage(leaves, "merkle-leaves")), {
        "proof_sha256": digest(proof_text(F.col("proof"))),
        "folded_root": fold(F.coalesce("row.changed", "hash"), F.col("proof")),
    })
    return proved.select(
        "row.doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """Nodes (grp, level, pos, n, hash) of all levels."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, pos, n, hash FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(hash, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY grp, level, pos // {ARITY}, n)"""


def _sql_runs(name: str, tree: str) -> str:
    """(grp, level, pos, l, r): the siblings of every node that has a parent."""
    run = f"OVER (PARTITION BY grp, level, pos // {ARITY} ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (
  SELECT grp, level, pos, coalesce(string_agg(hash, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {tree} WHERE n > 1)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
marked AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce('=' || lang, '') AS grp,
    CASE WHEN {sql_crc("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS lowered
  FROM documents, crc_table),
hashed AS (SELECT doc_id, grp, {_sql_leaf("text")} AS hash, {_sql_leaf("lowered")} AS changed FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM hashed),
{_sql_tree("tree", "placed")},
subroots AS (SELECT grp AS sub, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, hash
  FROM tree WHERE n = 1),
{_sql_tree("upper_tree", "subroots")},
{_sql_runs("runs", "tree")},
{_sql_runs("upper_runs", "upper_tree")},
steps AS (
  SELECT p.grp, p.pos, list({{'l': r.l, 'r': r.r}} ORDER BY r.level) AS steps FROM placed p
  JOIN runs r ON r.grp = p.grp AND r.pos = p.pos // ({ARITY}::BIGINT ** r.level)::BIGINT GROUP BY ALL),
upper_steps AS (
  SELECT s.sub, list({{'l': r.l, 'r': r.r}} ORDER BY r.level) AS steps FROM subroots s
  JOIN upper_runs r ON r.pos = s.pos // ({ARITY}::BIGINT ** r.level)::BIGINT GROUP BY ALL),
proofs AS (
  SELECT p.doc_id, p.hash AS leaf, p.changed, s.hash AS subroot, (SELECT hash FROM upper_tree WHERE n = 1) AS root,
    list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM placed p JOIN subroots s ON s.sub = p.grp LEFT JOIN steps a ON a.grp = p.grp AND a.pos = p.pos
  LEFT JOIN upper_steps b ON b.sub = p.grp),
folded AS (
  SELECT *, sha256(coalesce(list_reduce(list_transform(steps, lambda x: x.l || x.r), lambda a, b: a || b), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': changed, 'r': ''}}, steps),
      lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

QUERIES = {"op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL)}
