"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..n-1 from its content, the permutation sends the number to a position, and
the position alone gives shard (position mod shards) and slot (position div shards). Shards differ by one row
at most, slots have no gaps, and shard and slot of any row number can be computed without the table.

Only DataFrame functions are used. Rows that are equal in all columns are counted once before the first
shuffle and numbered together, so a row repeated millions of times is one row of the shuffle. Numbers come from
a per-bucket row_number plus a per-bucket offset; the offsets are a table of `buckets` rows, which bounds
what is broadcast. No step needs all rows in one task.

Defined cases: null values are values like others (nulls first); repeated rows get different positions; an
empty table gives an empty result; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import quoted, table, without

SHARDS = 40
SEED = 20
#: Row-numbering buckets. The offset table has this many rows at any input size.
BUCKETS = 4096
#: Round pairs of the permutation; each pair changes both halves once.
ROUND_PAIRS = 4
#: Modulus of the round function (2^31 - 1). Halves are below 2^31 for fewer than 2^62 rows, so products stay
#: below 2^63.
PRIME = 2147483647
#: Walks after the first. The halves are a x b with a = ceil(sqrt n) and 0 <= a * b - n < a, so a walk
#: leaves the range with probability below 1 / sqrt n: beyond 1,000 rows 32 walks in a row do so with
#: probability below 10^-48; below 1,000 rows 32 walks visit every number outside the range.
WALKS = 32


def round_keys(seed: int) -> list[tuple[int, ...]]:
    """Six coefficients below PRIME for each round pair, from the seed."""
    keys = []
    for pair in range(ROUND_PAIRS):
        digest = hashlib.sha256(f"{seed}/{pair}".encode()).digest()
        keys.append(tuple(1 + int.from_bytes(digest[4 * i:4 * i + 4], "big") % (PRIME - 1) for i in range(6)))
    return keys


def _div(value: Column, by: Column) -> Column:
    """Whole quotient of values that are not negative, exact beyond the 53 bits of a double."""
    return F.call_function("div", value, by)


def _mix(value: Column, a: Column, b: Column, c: Column) -> Column:
    """A quadratic polynomial modulo PRIME, by Horner's rule."""
    return (((value % PRIME) * a + b) % PRIME * (value % PRIME) + c) % PRIME


def permute(number: Column, total: Column, seed: int = SEED) -> Column:
    """Position of row `number` (0 <= number < total) in the shuffle of `total` rows."""
    left_size = F.ceil(F.sqrt(total)).cast("long")
    right_size = _div(total + left_size - 1, left_size)
    keys = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(key)]) for key in round_keys(seed)
    ])

    def pair(state: Column, key: Column) -> Column:
        left = (state["l"] + _mix(state["r"], key["k0"], key["k1"], key["k2"])) % left_size
        right = (state["r"] + _mix(left, key["k3"], key["k4"], key["k5"])) % right_size
        return F.struct(left.alias("l"), right.alias("r"))

    def walk(x: Column) -> Column:
        start = F.struct(_div(x, right_size).alias("l"), (x % right_size).alias("r"))
        return F.aggregate(keys, start, pair, lambda s: s["l"] * right_size + s["r"])

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), walk(number),
        lambda x, _: F.when(x < total, x).otherwise(walk(x)),
        lambda x: F.when(x < total, x).otherwise(F.raise_error(F.lit("the permutation left its range"))),
    )


def number_rows(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`df` with `row_number` (0..n-1, decided by the rows' content alone) and `row_total` (n)."""
    kept = without(df, ["row_number", "row_total"])
    columns = quoted(kept)
    content = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    counted = (
        df.groupBy(F.struct(*columns).alias("row"), F.pmod(F.crc32(content), F.lit(buckets)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    per_bucket = counted.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_bucket.select(
        "bucket", (F.sum("rows").over(running) - F.col("rows")).alias("offset"),
        F.sum("rows").over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("row_total"),
    )
    within = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("end", F.sum("copies").over(within)).join(F.broadcast(offsets), "bucket")
    first = F.col("offset") + F.col("end") - F.col("copies")
    return placed.select(
        "row", "row_total", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("row_number"),
    ).select("row.*", "row_number", "row_total")


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """`df` with `position`, `shard` and `slot`."""
    numbered = number_rows(df.select(*quoted(without(df, ["position", "shard", "slot"]))), buckets)
    placed = numbered.withColumn("position", permute(F.col("row_number"), F.col("row_total"), seed))
    return placed.drop("row_number", "row_total").withColumns({
        "shard": (F.col("position") % shards).cast("int"),
        "slot": _div(F.col("position"), F.lit(shards)),
    })


def op7_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in SHARDS shards under the law `rows`.

    Only id, size and checksum of a text travel. The law spreads equal texts over the shards like other rows.
    """
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sql_crc(text: str) -> str:
    """crc32 of a text expression in the check SQL."""
    pairs = f"string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter({pairs}, "
        "lambda h: h <> ''), lambda h: ('0x' || h)::BIGINT)), "
        "lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)))"
    )


#: The table `t` that sql_crc reads.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))"""


def _sql_walk(source: str) -> str:
    """One walk of the permutation over a relation with the column x, as nested selects."""
    step = f"SELECT *, x // b AS l, x % b AS r FROM ({source})"
    for k in round_keys(SEED):
        def mix(v, i):
            return f"((({v} % {PRIME}) * {k[i]} + {k[i + 1]}) % {PRIME} * ({v} % {PRIME}) + {k[i + 2]}) % {PRIME}"
        step = f"SELECT * REPLACE ((l + {mix('r', 0)}) % a AS l) FROM ({step})"
        step = f"SELECT * REPLACE ((r + {mix('l', 3)}) % b AS r) FROM ({step})"
    return f"SELECT k, a, b, n, l * b + r AS x FROM ({step})"


OP7_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {sql_crc("coalesce(text, '')")} AS text_crc32, t
  FROM documents, crc_table),
keyed AS (
  SELECT doc_id, size, text_crc32,
    {sql_crc("coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR || '|' || text_crc32::VARCHAR")} % {BUCKETS} AS bucket
  FROM sized),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS k,
    count(*) OVER () AS n
  FROM keyed),
ranged AS (
  SELECT k, n, k AS x, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b
  FROM numbered),
walked AS (
  {_sql_walk("SELECT k, a, b, n, x FROM ranged")}
  UNION ALL
  {_sql_walk("SELECT k, a, b, n, x FROM walked WHERE x >= n")})
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard,
  (x // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN walked USING (k) WHERE walked.x < walked.n
"""

QUERIES = {"op7_feistel_shards": (op7_feistel_shards, OP7_SQL)}
