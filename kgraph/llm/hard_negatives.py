"""Hard negatives: exact windows of inner products over Hilbert-ordered blocks with zone maps.

Rows of one label are ordered along a Hilbert curve (through the CURVE_DIMENSIONS components of largest variance) and cut
into blocks of BLOCK_ROWS rows. A block is one row of a Parquet table: its ids and vectors, and its zone map, the
smallest and largest value of every component. Interval arithmetic on a zone map bounds the inner product of an anchor
with every row of the block from both sides, so zone maps alone decide which blocks an anchor has to read.

A request is an anchor with a label rule (its own label for positives, another for negatives) and a window of scores. It
is answered in two passes: the block that promises most is read first, and the k-th best row found there is a threshold;
then every block is read whose bounds meet the window and can still beat the threshold (at equal scores, by its smallest
id). Nothing is approximate: blocks left out cannot hold a row of the result.

Zone maps are packed in strips of STRIP and requests in chunks of about REQUESTS, so bounds are four matrix products a
pair of strip and chunk, and a block meets the requests that chose it chunk by chunk. Blocks, strips and chunks are rows
of tables that Spark joins and shuffles; each task holds a few of them. Labels or copies that hold a third of all rows are many
blocks, dealt out like others.

Defined cases: rows without id, label or vector, with an empty vector or with a null or non-finite component take no part;
vectors of different lengths do not meet; a repeated id counts once, with its least (label, vector); a window whose
lower end lies above its upper one (a negative positive score) holds nothing; an anchor without another row of its label
gives no rows; an empty table gives an empty result; further columns are ignored. Components must stay within 32 bits
once multiplied and floored, scores within 64; beyond that the job fails and says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import small_batches, table
from kgraph.llm.positions import positioned
from kgraph.sources.staging import stage

POSITIVES = NEGATIVES = 5
#: A negative scores between LOW percent of its positive's score and all of it.
LOW = 80
SCALE = 256
CURVE_DIMENSIONS, CURVE_BITS = 8, 4
BLOCK_ROWS = 512
STRIP = 1024
REQUESTS = 512
_LEAST, _MOST = -(2 ** 63), 2 ** 63 - 1

BLOCK = "space string, number long, dims int, label int, least_id long, ids binary, vectors binary, low binary, high binary"
REQUEST = ["anchor_id", "positive_id", "dims", "label", "vector", "same", "lo", "hi", "at", "at_id"]
CHUNK = (
    "chunk long, dims int, anchors binary, positives binary, labels binary, vectors binary, same binary, lo binary, hi binary, "
    "at binary, at_id binary"
)
FOUND = "anchor_id long, positive_id long, vec_id long, score long"


# --- numbers ----------------------------------------------------------------

def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object)
    if max(abs(whole.min()), abs(whole.max())) > _MOST:
        raise OverflowError("a score does not fit 64 bits")
    return whole.astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between `low` and `high` of each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell coordinates (0 .. 2 ** bits - 1).

    From the highest bit down, the part of the cube that a point lies in mirrors the finer coordinates (bit set) or
    swaps them with the first one (bit not set); a Gray code then numbers the parts.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        finer = (1 << bit) - 1
        for i in range(len(x)):
            inside = (x[i] >> bit) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ x[i]) & finer)
            x[0] ^= np.where(inside, finer, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    position = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(len(x)):
            position = (position << 1) | ((x[i] >> bit) & 1)
    return position


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _read(cell: pa.Scalar, kind: type, dims: int | None = None) -> np.ndarray:
    flat = np.frombuffer(cell.as_py(), dtype=kind)
    return flat if dims is None else flat.reshape(-1, dims)


# --- blocks -----------------------------------------------------------------

def whole_vectors(df: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label, dims and the components times SCALE, floored, of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    whole = F.transform(v, lambda x: F.when(
        (scaled(x) >= -(2 ** 31)) & (scaled(x) < 2 ** 31), scaled(x).cast("int")).otherwise(
        F.raise_error(F.lit("a component does not fit 32 bits")).cast("int")))
    return (
        df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .filter(F.coalesce(finite, F.lit(False)))
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), whole.alias("vector"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
        .select("vec_id", "r.label", F.size("r.vector").alias("dims"), "r.vector")
    )


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        lengths = batch["dims"].to_numpy()
        for dims in np.unique(lengths):
            x = _matrix(batch["vector"].filter(pa.array(lengths == dims)), int(dims)).astype(np.float64)
            sums[dims] = sums.get(dims, 0) + np.stack([np.full(dims, float(len(x))), x.sum(0), (x * x).sum(0)])
    for dims, part in sums.items():
        yield pa.RecordBatch.from_pydict({
            "dims": np.full(dims, dims, np.int32), "at": np.arange(dims, dtype=np.int32), "n": part[0], "s": part[1], "q": part[2]})


def moments(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and spread of every component, by vector length: a few numbers a component."""
    parts = rows.select("dims", "vector").mapInArrow(_partial_moments, "dims int, at int, n double, s double, q double")
    found: dict[int, dict[int, tuple]] = {}
    for r in parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        found.setdefault(r["dims"], {})[r["at"]] = (r["s"] / r["n"], max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5)
    return {
        dims: (np.array([at[i][0] for i in range(dims)]), np.array([at[i][1] for i in range(dims)])) for dims, at in found.items()}


def _curve(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Hilbert positions by the components of largest spread, cells spanning two spreads either side."""
    chosen = np.argsort(-spread, kind="stable")[:CURVE_DIMENSIONS]
    side = 1 << CURVE_BITS
    unit = (x[:, chosen] - mean[chosen]) / np.where(spread[chosen] > 0, spread[chosen], 1.0)
    return hilbert(np.clip(np.floor((unit + 2) / 4 * side), 0, side - 1), CURVE_BITS)


def _pack_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("vec_id")
    dims = rows["dims"][0].as_py()
    vectors = np.ascontiguousarray(_matrix(rows["vector"], dims), dtype=np.int32)
    ids = rows["vec_id"].to_numpy()
    return pa.Table.from_pylist([{
        "space": rows["space"][0].as_py(), "number": rows["number"][0].as_py(), "dims": dims, "label": rows["label"][0].as_py(),
        "least_id": int(ids[0]), "ids": ids.tobytes(), "vectors": vectors.tobytes(), "low": vectors.min(0).tobytes(),
        "high": vectors.max(0).tobytes(),
    }], schema=_arrow(BLOCK))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(),
             "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def make_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` (see whole_vectors) as the table BLOCK, written to the shared folder."""
    stats = moments(rows)

    def with_curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["dims"].to_numpy()
            curve = np.zeros(len(lengths), np.int64)
            for dims in np.unique(lengths):
                here = lengths == dims
                curve[here] = _curve(_matrix(batch["vector"].filter(pa.array(here)), int(dims)), *stats[int(dims)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve)], [*batch.schema.names, "curve"])

    curved = rows.select("vec_id", "label", "dims", "vector").mapInArrow(
        with_curve, "vec_id long, label int, dims int, vector array<int>, curve long")
    placed = positioned(curved.withColumn("space", F.concat_ws("/", "dims", "label")), "space", ["curve", "vec_id"])
    blocks = placed.withColumn("number", F.floor(F.col("pos") / block_rows)).drop("pos", "total", "curve").groupBy(
        "space", "number").applyInArrow(_pack_block, BLOCK)
    return stage(blocks, "vector-blocks")


# --- requests ---------------------------------------------------------------

def _pack_chunk(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("anchor_id", "ascending"), ("positive_id", "ascending")])
    dims = rows["dims"][0].as_py()
    flat = lambda name, kind=np.int64: np.ascontiguousarray(rows[name].to_numpy(), dtype=kind).tobytes()
    return pa.Table.from_pylist([{
        "chunk": rows["chunk"][0].as_py(), "dims": dims, "anchors": flat("anchor_id"), "positives": flat("positive_id"),
        "labels": flat("label"), "vectors": np.ascontiguousarray(_matrix(rows["vector"], dims), dtype=np.int32).tobytes(),
        "same": flat("same", np.int8), "lo": flat("lo"), "hi": flat("hi"), "at": flat("at"), "at_id": flat("at_id"),
    }], schema=_arrow(CHUNK))


def _chunks(requests: DataFrame, count: int, size: int) -> DataFrame:
    chunk = F.pmod(F.xxhash64("anchor_id", "positive_id"), F.lit(max(1, math.ceil(count / size))))
    packed = requests.withColumn("chunk", chunk).select("chunk", *REQUEST).groupBy("chunk", "dims").applyInArrow(_pack_chunk, CHUNK)
    return stage(packed, "request-chunks")


def _pack_strip(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("space", "ascending"), ("number", "ascending")])
    joined = lambda name: b"".join(rows[name].to_pylist())
    return pa.Table.from_pylist([{
        "strip": rows["strip"][0].as_py(), "dims": rows["dims"][0].as_py(), "spaces": "\n".join(rows["space"].to_pylist()),
        "numbers": rows["number"].to_numpy().tobytes(), "zone_labels": rows["label"].to_numpy().astype(np.int64).tobytes(),
        "least_ids": rows["least_id"].to_numpy().tobytes(), "low": joined("low"), "high": joined("high"),
    }], schema=_arrow(STRIPS))


STRIPS = "strip long, dims int, spaces string, numbers binary, zone_labels binary, least_ids binary, low binary, high binary"


def _plausible(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the requests and zones of a row: which zones a request may need, and how much each promises."""
    cell = lambda name: batch[name][i]
    dims = cell("dims").as_py()
    labels, same = _read(cell("labels"), np.int64), _read(cell("same"), np.int8) == 1
    lo, hi, at, at_id = (_read(cell(n), np.int64)[:, None] for n in ("lo", "hi", "at", "at_id"))
    least, most = bounds(_read(cell("vectors"), np.int32, dims), _read(cell("low"), np.int32, dims), _read(cell("high"), np.int32, dims))
    matches = (labels[:, None] == _read(cell("zone_labels"), np.int64)[None, :]) == same[:, None]
    best = np.minimum(most, hi)
    beats = (best > at) | ((best == at) & (_read(cell("least_ids"), np.int64)[None, :] <= at_id))
    wanted = matches & (least <= hi) & (most >= lo) & beats
    # a positive is sought where the bound is greatest, a negative where the middle of the bounds is nearest to its window's end
    promise = np.where(same[:, None], most.astype(np.float64), -np.abs((least / 2 + most / 2) - hi))
    return wanted, promise, hi


PROBE = "chunk long, dims int, request int, promise double, space string, number long"
READ = "chunk long, dims int, space string, number long, members array<int>"


def _first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each request's most promising block of a strip."""
    for batch in batches:
        for i in range(batch.num_rows):
            wanted, promise, _ = _plausible(batch, i)
            promise = np.where(wanted, promise, -np.inf)
            pick = promise.argmax(axis=1)
            who = np.flatnonzero(wanted.any(axis=1))
            spaces, numbers = batch["spaces"][i].as_py().split("\n"), _read(batch["numbers"][i], np.int64)
            yield pa.RecordBatch.from_pydict({
                "chunk": np.full(len(who), batch["chunk"][i].as_py(), np.int64), "dims": np.full(len(who), batch["dims"][i].as_py(), np.int32),
                "request": who.astype(np.int32), "promise": promise[who, pick[who]],
                "space": [spaces[z] for z in pick[who]], "number": numbers[pick[who]]}, schema=_arrow(PROBE))


def _all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block of a strip that some request has to read, with these requests."""
    for batch in batches:
        for i in range(batch.num_rows):
            wanted, _, _ = _plausible(batch, i)
            spaces, numbers = batch["spaces"][i].as_py().split("\n"), _read(batch["numbers"][i], np.int64)
            zones = np.flatnonzero(wanted.any(axis=0))
            yield pa.RecordBatch.from_pylist([{
                "chunk": batch["chunk"][i].as_py(), "dims": batch["dims"][i].as_py(), "space": spaces[z], "number": int(numbers[z]),
                "members": np.flatnonzero(wanted[:, z]).astype(np.int32)} for z in zones], schema=_arrow(READ))


def _answer(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of a block for each request that reads it."""
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name: batch[name][i]
                dims = cell("dims").as_py()
                who = np.array(cell("members").as_py(), np.int64)
                pick = lambda name, kind=np.int64: _read(cell(name), kind)[who]
                ids = _read(cell("ids"), np.int64)
                anchors = pick("anchors")
                scores = product(_read(cell("vectors"), np.int32, dims)[who], _read(cell("block_vectors"), np.int32, dims))
                at, at_id = pick("at")[:, None], pick("at_id")[:, None]
                fits = (scores >= pick("lo")[:, None]) & (scores <= pick("hi")[:, None]) & (ids[None, :] != anchors[:, None])
                fits &= (scores > at) | ((scores == at) & (ids[None, :] <= at_id))
                request, row = np.nonzero(fits)
                found = scores[request, row]
                order = np.lexsort((ids[row], -found, request))
                request, row, found = request[order], row[order], found[order]
                rank = np.arange(len(request)) - np.searchsorted(request, request)
                top = rank < k
                yield pa.RecordBatch.from_pydict({
                    "anchor_id": anchors[request[top]], "positive_id": pick("positives")[request[top]], "vec_id": ids[row[top]],
                    "score": found[top]}, schema=_arrow(FOUND))

    return read


def search(requests: DataFrame, blocks: DataFrame, k: int, size: int = REQUESTS, strip: int = STRIP) -> DataFrame:
    """(anchor_id, positive_id, rank, vec_id, score): the k best rows in the window of every request.

    `requests` has anchor_id, positive_id (together a key), dims, label, vector, same, lo and hi; `blocks` is BLOCK.
    """
    requests = stage(requests.withColumns({"at": F.lit(_LEAST), "at_id": F.lit(_MOST)}).select(*REQUEST), "requests")
    count = requests.count()
    strips = max(1, math.ceil(blocks.count() / strip))
    zones = blocks.select("space", "number", "dims", "label", "least_id", "low", "high").withColumn(
        "strip", F.pmod(F.xxhash64("space", "number"), F.lit(strips)))
    zones = stage(zones.groupBy("strip", "dims").applyInArrow(_pack_strip, STRIPS), "zone-strips")
    stored = blocks.select("space", "number", "ids", F.col("vectors").alias("block_vectors"))

    def met(chunks: DataFrame) -> DataFrame:
        dealt = chunks.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))))
        return dealt.join(zones, ["strip", "dims"]).drop("strip", "anchors", "positives")

    def read(reads: DataFrame, chunks: DataFrame) -> DataFrame:
        joined = reads.join(chunks.drop("labels", "same"), ["chunk", "dims"]).join(stored, ["space", "number"])
        return joined.drop("space", "number").mapInArrow(_answer(k), FOUND)

    chunks = _chunks(requests, count, size)
    first = met(chunks).mapInArrow(_first_blocks, PROBE).groupBy("chunk", "dims", "request").agg(
        F.max(F.struct("promise", "space", "number")).alias("b"))
    first = first.groupBy("chunk", "dims", "b.space", "b.number").agg(F.sort_array(F.collect_list("request")).alias("members"))
    # what one block holds for a request is no more than k rows
    worst = F.min(F.struct("score", (-F.col("vec_id")).alias("later")))
    reached = read(first, chunks).groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n"), worst.alias("w"))
    known = reached.filter(F.col("n") == k).select("anchor_id", "positive_id", "w.score", (-F.col("w.later")).alias("least"))
    narrowed = requests.join(known, ["anchor_id", "positive_id"], "left").withColumns({
        "at": F.coalesce("score", "at"), "at_id": F.coalesce("least", "at_id")}).select(*REQUEST)
    chunks = _chunks(narrowed, count, size)
    reads = met(chunks).mapInArrow(_all_blocks, READ)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return read(reads, chunks).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", "vec_id", "score")


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
    block_rows: int = BLOCK_ROWS, size: int = REQUESTS, strip: int = STRIP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` and `anchors` are as made by `whole_vectors`; anchors are among the rows.
    """
    small_batches(rows.sparkSession)
    rows = stage(rows, "vectors")
    blocks = make_blocks(rows, block_rows)
    anchors = stage(anchors, "anchors")
    first = anchors.select(
        F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), "dims", "label", "vector",
        F.lit(1).alias("same"), F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi"))
    near = stage(search(first, blocks, positives, size, strip).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the least whole number that is not below `low` percent; a negative score leaves no room
    floor = F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / 100).cast("long")
    second = near.filter("positive_score >= 0").join(
        anchors.withColumnRenamed("vec_id", "anchor_id"), "anchor_id"
    ).select("anchor_id", "positive_id", "dims", "label", "vector", F.lit(0).alias("same"), floor.alias("lo"),
             F.col("positive_score").alias("hi"))
    return search(second, blocks, negatives, size, strip).join(near, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100; labels of each seventh are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stage(whole_vectors(table(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")), "vectors")
    return mine(rows, rows.filter("vec_id % 100 = 0"))


OP13_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""

QUERIES = {"op13_hard_negatives": (op13_hard_negatives, OP13_SQL)}
