"""Approximate nearest neighbours on shifted space-filling curves.

Vectors of one direction are collapsed first. Each distinct one is projected to
a few dimensions in several ways, shifted, and put on a Hilbert curve; Spark
range-partitions all curves' keys. A query is compared with the windows before
and after it on every curve by the exact measure, so that the best of each
window lose nothing and merge by it. Windows widen with the table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlens.llm import scratch

CURVES, DIMS, BITS, WINDOW = 32, 6, 8, 1024
#: The least number of ranks that a query looks at on all curves, as a share of the distinct vectors.
SHARE = 1.0
#: More than rounding changes a product of unit vectors in doubles; what is nearer than that is compared term by term.
SLACK = 1e-12
SAMPLE = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer cells (n, d) on the Hilbert curve, by the transpose form: undo the
    excess work of each level from the top, Gray-encode, then interleave the bits."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for k in range(d):
            flip = (x[k] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(flip, below, swap)
            x[k] ^= swap
    for k in range(1, d):
        x[k] ^= x[k - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray ^= np.where((x[d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= gray
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(d):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key


def _projections(dim: int, curves: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, min(DIMS, dim))))[0] for _ in range(curves)])


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    top = np.abs(flat).max(1, keepdims=True)
    flat = flat / top
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: no null, no null or non-finite component, and not zero."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return good.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def _keyed(groups: DataFrame, curves: int) -> DataFrame:
    """(curve, key, h1, h2, asks, least, raw) rows: each vector on each curve."""
    sample = groups.orderBy(F.xxhash64("h1"), "h1", "h2").limit(SAMPLE).select("embedding").collect()
    if not sample:
        return groups.sparkSession.createDataFrame([], "curve int, key long, h1 long, h2 long, asks boolean, least long, raw binary")
    some = np.array([r[0] for r in sample], np.float64)
    some /= np.abs(some).max(1, keepdims=True)
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    ways = _projections(some.shape[1], curves)
    spread = np.einsum("nd,cdk->cnk", some, ways)
    low, high = spread.min(1), spread.max(1)
    shift = np.random.default_rng(12).random(low.shape)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(4))
            raw = batch.column(4).flatten().to_numpy(zero_copy_only=False).tobytes()
            offsets = np.linspace(0, len(raw), len(x) + 1).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
            for c in range(curves):
                # The data fill half of the cube's side; the shift moves them in it.
                cell = ((x @ ways[c] - low[c]) / np.maximum(high[c] - low[c], 1e-12) + shift[c]) / 2
                key = hilbert(np.clip(cell * (1 << BITS), 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), batch.column(0), batch.column(1), batch.column(2), batch.column(3), blobs], names=["curve", "key", "h1", "h2", "asks", "least", "raw"])

    return groups.select("h1", "h2", "asks", "least", "embedding").mapInArrow(work, "curve int, key long, h1 long, h2 long, asks boolean, least long, raw binary")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in the order of (curve, key) with their place ``rank`` in it."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "curve", "key", "h1").sortWithinPartitions("curve", "key", "h1", "h2")
    schema = ordered.select("curve", "h1", "h2", "asks", "least", "raw", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at")).schema

    def work(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 2, 3, 4, 5, 6)] + [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(n, n + size))], names=schema.names)
            n += size

    placed = scratch.store(ordered.mapInArrow(work, schema), "curves")
    # One row for each task; from these each task's first rank.
    sizes = sorted(placed.groupBy("part").agg(F.max("at")).collect())
    first, total = [], 0
    for part, last in sizes:
        first.append((part, total))
        total += last + 1
    begin = placed.sparkSession.createDataFrame(first, "part int, begin long")
    return placed.join(F.broadcast(begin), "part").select("curve", "h1", "h2", "asks", "least", "raw", (F.col("begin") + F.col("at")).alias("rank"))


def _dots(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of the vectors (columns of x and y), summed in the order of the components whatever the pairs' number."""
    out = np.zeros(len(rows))
    for a, b in zip(x, y, strict=True):
        out += a[rows] * b[cols]
    return out


def _windows(rows: DataFrame, window: int, k: int, kind: str) -> DataFrame:
    """(q1, q2, h1, h2, least, score): the k best of each window for each asking vector, by cosine and then by ``least``."""
    block = F.floor(F.col("rank") / window)
    give = rows.select(block.alias("block"), F.lit(False).alias("asks"), "curve", "h1", "h2", "least", "raw")
    ask = rows.where("asks").select(F.explode(F.array(block - 1, block, block + 1)).alias("block"), "asks", "curve", "h1", "h2", "least", "raw")
    both = give.unionByName(ask).repartition("block").sortWithinPartitions("block", "asks")

    def best(table: pa.Table):
        asks = table["asks"].to_numpy()
        x = np.frombuffer(b"".join(table["raw"].to_pylist()), kind).reshape(len(asks), -1).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        flat, every = np.ascontiguousarray(x.T), np.arange(len(x))
        norm = np.sqrt(_dots(flat, flat, every, every))
        x /= norm[:, None]
        ids = np.stack([table["h1"].to_numpy(), table["h2"].to_numpy()], 1)
        curve, block, least = table["curve"].to_numpy(), table["block"].to_numpy(), table["least"].to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            split = s + int(np.searchsorted(asks[s:e], True))
            if not s < split < e:
                continue
            some = max(1, (1 << 21) // (split - s))
            for lo in range(split, e, some):
                hi = min(e, lo + some)
                near = x[lo:hi] @ x[s:split].T
                near[curve[lo:hi, None] != curve[None, s:split]] = -2
                n = near.shape[1] - min(k, near.shape[1])
                q, c = np.nonzero((near >= np.partition(near, n, axis=1)[:, n, None] - SLACK) & (near > -2))
                q, c = q + lo, c + s
                score = _dots(flat, flat, q, c) / (norm[q] * norm[c])
                by = np.lexsort((least[c], -score, q))
                q, c, score = q[by], c[by], score[by]
                good = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield np.column_stack([ids[q[good]], ids[c[good]], least[c[good]]]), score[good]

    def emit(table: pa.Table):
        for ids, score in best(table):
            yield pa.RecordBatch.from_arrays([*(pa.array(ids[:, j]) for j in range(5)), pa.array(score)], names=["q1", "q2", "h1", "h2", "least", "score"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if len(held) > 1 and batch.column(0)[batch.num_rows - 1] != held[0].column(0)[0]:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    cut = int(np.searchsorted(whole["block"].to_numpy(), whole["block"][whole.num_rows - 1].as_py()))
                    yield from emit(whole.slice(0, cut).combine_chunks())
                    held = whole.slice(cut).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    found = both.mapInArrow(work, "q1 long, q2 long, h1 long, h2 long, least long, score double")
    return found.groupBy("q1", "q2", "h1", "h2", "least").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each row whose vec_id ``every`` divides.

    Ties go to the smaller vec_id. A row is no neighbour of itself; repeated
    rows count once; rows that usable() leaves out take no part. Vectors of
    different lengths have no cosine: each length that occurs is searched by
    itself. ``window`` is the least width; from ``share`` of the table on it
    grows in proportion to the rows. An empty table gives an empty one.
    """
    rows, kind = usable(vectors), "f4"
    if rows.schema["embedding"].dataType.elementType.typeName() != "float":
        rows, kind = rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "f8"
    lengths = sorted(r[0] for r in rows.groupBy(F.size("embedding")).count().where("count > 1").collect())
    found = [_nearest(rows.where(F.size("embedding") == n), kind, every, k, curves, window, share) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(rows: DataFrame, kind: str, every: int, k: int, curves: int, window: int, share: float) -> DataFrame:
    rows = rows.dropDuplicates(["vec_id", "embedding"])
    # Multiples of a vector have cosine 1 with it and are one group: components by the largest, without negative zeros.
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    way = F.transform("embedding", lambda x: x.cast("double") / F.col("top") + F.lit(0.0))
    rows = rows.withColumn("top", top).withColumn("way", way)
    rows = rows.withColumn("h1", F.xxhash64("way")).withColumn("h2", F.xxhash64(F.lit(1), F.col("way"))).drop("top", "way")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    queries = scratch.store(queries.distinct(), "queries")
    # Of one direction only the k + 1 smallest ids can be among a query's nearest.
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(f"n <= {k + 1}")
    groups = few.groupBy("h1", "h2").agg(F.collect_list("vec_id").alias("ids"), F.min("vec_id").alias("least"), F.min_by("embedding", "vec_id").alias("embedding"))
    asked = queries.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.lit(True).alias("asks")).distinct()
    groups = scratch.store(groups.join(asked, ["h1", "h2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "vectors")
    window = max(window, math.ceil(share * groups.count() / (3 * curves)))
    found = _windows(_numbered(_keyed(groups, curves)), window, k + 1, kind)
    order = Window.partitionBy("q1", "q2")
    # An id among a query's k + 1 best has no more than k directions before its own.
    some = found.withColumn("n", F.row_number().over(order.orderBy(F.desc("score"), "least", "h1", "h2"))).where(f"n <= {k + 1}").drop("n")
    exact = some.join(groups.select("h1", "h2", "ids"), ["h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    exact = exact.withColumn("n", F.row_number().over(order.orderBy(F.desc("score"), "vec_id"))).where(f"n <= {k + 1}").drop("n")
    lists = scratch.store(exact.groupBy("q1", "q2").agg(F.collect_list(F.struct("vec_id", "score")).alias("near")), "nearest")
    answers = queries.join(lists, ["q1", "q2"]).select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    ranked = F.slice(F.array_sort("near", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).otherwise(1)), 1, k)
    return answers.select("query_id", F.posexplode(ranked).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
