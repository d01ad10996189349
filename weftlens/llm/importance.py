"""Importance resampling of documents towards a target distribution.

Words and pairs of neighbouring words are hashed to buckets. A bucket's gain is
the logarithm of how much likelier it is in the target than in the corpus; a
document's weight is the mean of its features' gains, looked up in an array.
Gumbel noise from a hash of the id makes the highest scores a sample without
replacement. The k-th highest composite key of score, id and row is found
exactly by radix selection: one distributed histogram for each digit, over the
rows that share the digits so far. Only the selected rows are range-sorted.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import scratch

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bits of a digit of the selection; a histogram has 2**DIGIT rows at most.
DIGIT = 12
#: Tasks that merge counts; rows of a range of the sorted ones.
MERGERS, RANGE_ROWS = 16, 500_000
#: Words of more bytes are hashed one by one.
LONG = 48


# CRC-32 of many byte spans at once.


@cache
def _byte_table() -> np.ndarray:
    """The state of each byte value after eight steps of the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


@cache
def _shift_tables(longest: int = LONG) -> np.ndarray:
    """[length, place, byte]: what a byte at a place of a CRC becomes when ``length`` zero bytes follow."""
    table, out = _byte_table(), np.empty((longest + 1, 4, 256), np.uint32)
    for place in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        for length in range(longest + 1):
            out[length, place] = state
            state = table[state & np.uint32(255)] ^ (state >> np.uint32(8))
    return out


def crc32s(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of raw[start:end] for each span, step by step for all spans together."""
    table, size = _byte_table(), ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    first = int(np.searchsorted(-size[order], -LONG, "left"))  # those before are longer than LONG
    low = order[first:]
    state, place = out[low], starts[low]
    upto = np.searchsorted(-size[low], -np.arange(LONG + 1), "left")  # how many have more than so many bytes
    for step in range(int(size[low[0]]) if len(low) else 0):
        n = upto[step]
        state[:n] = table[(state[:n] ^ raw[place[:n] + step]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[low] = ~state
    data = memoryview(np.ascontiguousarray(raw))
    for k in order[:first].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b, from those of a and b and the number of bytes of b."""
    size, state = size.copy(), left.copy()
    tables = _shift_tables()
    while True:
        step = np.minimum(size, LONG)
        state = tables[step, 0, state & 255] ^ tables[step, 1, state >> 8 & 255] ^ tables[step, 2, state >> 16 & 255] ^ tables[step, 3, state >> 24]
        size -= step
        if not size.any():
            return state ^ right


# Features.


def buckets(column: pa.Array, count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, features by document): all words and all pairs of neighbouring words of each text.

    Words are runs of digits, letters a-z and bytes beyond ASCII, after A-Z are lowered.
    """
    raw, offs = at.buffers(column)
    raw = raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    inside = (raw >= 128) | ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    words = np.diff(np.searchsorted(starts, offs))
    crc = crc32s(raw, starts, ends)
    pair = np.ones(len(starts), bool)  # whether a word has a next one in its document
    pair[(np.cumsum(words) - 1)[words > 0]] = False
    at_word = np.flatnonzero(pair)
    blank = joined(crc[at_word], np.full(len(at_word), zlib.crc32(b" "), np.uint32), np.ones(len(at_word), np.int64))
    both = joined(blank, crc[at_word + 1], (ends - starts)[at_word + 1])
    # A document's words and pairs alternate, so that its features are one run.
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(pair)[:-1]]) if len(starts) else np.zeros(0, np.int64)
    out = np.empty(len(starts) + len(at_word), np.int64)
    out[place] = crc % np.uint32(count)
    out[place[at_word] + 1] = both % np.uint32(count)
    return out, np.where(words > 0, 2 * words - 1, 0)


def counts(texts: DataFrame, count: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has. Arrays of a fixed size are merged in a few tasks, then in the driver."""

    def emit(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])

    def work(batches):
        total = np.zeros(count, np.int64)
        for batch in at.pieces(batches):
            total += np.bincount(buckets(batch.column(0), count)[0], minlength=count)
        if total.any():
            yield emit(total)

    def merge(batches):
        total = np.zeros(count, np.int64)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, count).sum(0)
        if total.any():
            yield emit(total)

    parts = texts.select("text").mapInArrow(work, "n array<long>").repartition(MERGERS).mapInArrow(merge, "n array<long>").collect()
    return np.sum([np.zeros(count, np.int64), *(np.array(r.n, np.int64) for r in parts)], axis=0)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's smoothed likelihood ratio, floored."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight: the floored mean gain of each document's features, 0 without any."""

    def work(batches):
        for batch in at.pieces(batches):
            found, per = buckets(batch.column(1), len(gain))
            total = np.concatenate([[0], np.cumsum(gain[found])])
            end = np.cumsum(per)
            weight = (total[end] - total[end - per]) // np.maximum(per, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(per), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    schema = StructType([StructField("doc_id", LongType()), *StructType.fromDDL("n_features long, weight long")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


# Selection.


def select(rows: DataFrame, keys: list[str], k: int) -> list[int] | None:
    """The k-th least composite key of ``rows`` (k from 1): the values of the columns ``keys``, compared from the first to the last.

    Columns are longs without nulls, whose composite key is unique. Each column
    is taken digit by digit from its highest: a histogram of a digit over the
    rows that share all digits so far says which digit the k-th row has. Where
    one row is left it is read. None for k = 0.
    """
    if k <= 0:
        return None
    bounds = rows.agg(*(f(key) for key in keys for f in (F.min, F.max))).first()
    found: list[int] = []
    rest = rows
    for at_key, key in enumerate(keys):
        low, high = bounds[2 * at_key], bounds[2 * at_key + 1]
        value, bits = 0, (high - low).bit_length()
        place = F.col(key) - F.lit(low)
        for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
            near = rest.where(F.shiftright(place, shift + DIGIT) == value) if shift + DIGIT < bits else rest
            digit = F.shiftright(place, shift).bitwiseAND((1 << DIGIT) - 1)
            for name, n in sorted(near.groupBy(digit.alias("digit")).count().collect()):
                if k <= n:
                    break
                k -= n
            value = value << DIGIT | name
            if n == 1:
                return list(near.where(digit == name).select(*keys).first())
        found.append(low + value)
        rest = rest.where(F.col(key) == low + value)
    return found


def ranked(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows with their rank from 1 in the order of ``keys``: range-sorted, numbered in each range, plus what stands before it."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS + 1)
    numbered = StructType([*rows.schema, *StructType.fromDDL("part int, nth long")])

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part, np.int32)), pa.array(np.arange(seen + 1, seen + m + 1))], names=numbered.names)
            seen += m

    table = scratch.store(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(number, numbered), "importance-ranks")
    # One number for each range: as many as there are tasks.
    size = dict(table.groupBy("part").count().collect())
    before, total = [], 0
    for part in sorted(size):
        before.append((part, total))
        total += size[part]
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return table.join(starts, "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


# The operator.


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, count: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    ``share`` percent of the documents with at least ``least_words`` words are
    drawn, highest score first, ties to the smaller doc_id. Reads ``doc_id``
    (taken as long) and ``text`` of docs, ``text`` of target. A null text has no
    words and weight 0. A null doc_id counts as an empty string in the noise and
    comes after all others of its score. Repeated rows are drawn each; equal
    ones have neighbouring ranks. An empty target gives gains that prefer rare
    buckets; an empty table of documents gives no rows.
    """
    gain = gains(counts(docs, count), counts(target, count))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    # Stored, so that all passes of the selection see the same row numbers.
    scored = scratch.store(scored, "importance-scores")
    # A document of w > 0 words has 2 * w - 1 features.
    keyed = scored.withColumn("falling", -F.col("score")).withColumn("unnamed", F.col("doc_id").isNull().cast("long")).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    keys = ["falling", "unnamed", "id", "row"]
    eligible = keyed.where(F.col("n_features") >= 2 * least_words - 1) if least_words > 0 else keyed
    k = share * eligible.count() // 100
    last = select(eligible, keys, k)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    # Whether a row's key is at most the k-th, compared column by column.
    drawn = F.lit(True)
    for key, value in reversed(list(zip(keys, last, strict=True))):
        drawn = (F.col(key) < value) | ((F.col(key) == value) & drawn)
    chosen = eligible.where(drawn).select(*out, *keys)
    others = keyed.where(~drawn | (F.col("n_features") < 2 * least_words - 1)).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(chosen, keys, k).select(*out, "rank").unionByName(others)
