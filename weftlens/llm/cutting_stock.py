"""Packing as a cutting-stock problem, solved by column generation on the histogram of lengths.

A document gives pieces of a whole sequence's length and one remainder. How
many remainders there are of each length is all that the linear program sees:
its columns are patterns, multisets of lengths that fill a sequence exactly;
its objective is the number of tokens that no pattern covers; a knapsack by
dynamic programming prices new patterns from the duals. Rounded patterns are
assigned to documents by their rank among those of their length. The few
remainders beyond them are laid end to end and cut where a sequence ends, the
last ones at powers of two, so that no sequence has padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import scratch, tokens

#: Share of the tokens that patterns may leave over, and columns at most (three for each length), at which the program stops. What is left over is packed exactly all the same.
SPARE, COLUMNS = 0.005, 3000
_NONE = -1e18


# The linear program. Its size is bounded by the sequence's length, whatever the corpus.


def price(lengths: np.ndarray, value: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): the greatest value of lengths that sum to exactly c, and the index of one of them, for c from 0 to limit."""
    best, last = np.full(limit + 1, _NONE), np.full(limit + 1, -1)
    best[0] = 0
    upto = np.searchsorted(lengths, np.arange(limit + 1), "right")
    for c in range(1, limit + 1):
        if n := upto[c]:
            got = value[:n] + best[c - lengths[:n]]
            k = n - 1 - int(got[::-1].argmax())  # of equal ones the longest, so that patterns have few pieces
            if got[k] > _NONE / 2:
                best[c], last[c] = got[k], k
    return best, last


def _patterns(lengths: np.ndarray, value: np.ndarray, limit: int, most: int, least: float) -> list[np.ndarray]:
    """Counts of each length in the best pattern that holds it, for the ``most`` best such patterns of more than ``least``."""
    best, last = price(lengths, value, limit)
    gain = value + best[limit - lengths]
    found = {}
    for k in np.argsort(-gain, kind="stable")[: 2 * most].tolist():
        if gain[k] <= least or len(found) == most:
            break
        parts, room = [k], limit - int(lengths[k])
        while room:
            parts.append(int(last[room]))
            room -= int(lengths[parts[-1]])
        found.setdefault(tuple(sorted(parts)), None)
    return [np.bincount(parts, minlength=len(lengths)) for parts in found]


class Program:
    """The linear program: minimise the tokens that no pattern covers. Revised simplex from the basis of slacks.

    Only the inverse's columns of lengths whose slack has left the basis differ
    from the identity; they are all that is kept.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, limit: int):
        self.lengths, self.limit, m = lengths, limit, len(lengths)
        self.cost = lengths.astype(float)  # of the basic columns: a slack leaves its length uncovered, a pattern nothing
        self.basic = np.full(m, -1)  # the pattern at each place of the basis, -1 for a slack
        self.inverse, self.touched, self.place = np.zeros((m, 64)), [], np.full(m, -1)
        self.amount = demand.astype(float)
        self.made: list[np.ndarray] = []

    def open(self) -> float:
        """Tokens that no pattern covers."""
        return float(self.cost @ self.amount)

    def duals(self) -> np.ndarray:
        dual, k = self.cost.copy(), len(self.touched)
        dual[self.touched] = self.cost @ self.inverse[:, :k]
        return dual

    def enter(self, column: np.ndarray, slack: int = -1) -> None:
        """Brings a pattern, or the slack of a length, into the basis."""
        k, inverse, place = len(self.touched), self.inverse, self.place
        step = column.astype(float)
        seen = np.flatnonzero(column)
        used = seen[place[seen] >= 0]
        if len(used):
            step[used] = 0
            step += inverse[:, place[used]] @ column[used]
        rising = np.flatnonzero(step > 1e-7)
        ratio = np.maximum(self.amount[rising], 0) / step[rising]
        near = rising[ratio <= ratio.min() * (1 + 1e-9) + 1e-9]
        out = int(near[step[near].argmax()])  # of equal ratios the safest pivot
        theta = max(self.amount[out], 0.0) / step[out]
        self.amount -= theta * step
        self.amount[out] = theta
        row = inverse[out, :k] / step[out]
        if row.any():
            hit = np.flatnonzero(step)
            inverse[hit, :k] -= np.outer(step[hit], row)
        inverse[out, :k] = row
        if place[out] < 0:
            if k == inverse.shape[1]:
                self.inverse = inverse = np.concatenate([inverse, np.zeros_like(inverse)], 1)
            place[out] = k
            self.touched.append(out)
            inverse[:, k] = -step / step[out]
            inverse[out, k] = 1 / step[out]
        self.cost[out] = float(self.lengths[slack]) if slack >= 0 else 0.0
        self.basic[out] = -1 if slack >= 0 else len(self.made)
        if slack < 0:
            self.made.append(column)

    def start(self, spare: float, columns: int) -> None:
        """Patterns of lengths that are not yet exhausted, all of the same gain: those that the remaining amounts allow most often."""
        while len(self.made) < columns and self.open() > spare:
            free = np.flatnonzero((self.place < 0) & (self.amount > 1e-9))
            grown = len(self.made)
            if len(free):
                for part in _patterns(self.lengths[free], -1 / self.amount[free], self.limit, 128, _NONE / 2):
                    column = np.zeros(len(self.lengths))
                    column[free] = part
                    if len(self.made) < columns and ((self.place < 0) & (self.amount > 1e-9))[column > 0].all():
                        self.enter(column)
            if len(self.made) == grown:
                return

    def improve(self, spare: float, columns: int) -> None:
        """Patterns priced by the duals, until none gains or little enough is open."""
        pool = np.zeros((0, len(self.lengths)))
        while len(self.made) < columns and self.open() > spare:
            dual = self.duals()
            gains = pool @ dual
            if not len(pool) or gains.max() < 1e-6:
                pool = np.array(_patterns(self.lengths, dual, self.limit, 128, 1e-6), float).reshape(-1, len(dual))
                gains = pool @ dual
            back = dual - self.lengths  # of a slack that comes back
            if len(pool) and gains.max() >= max(1e-6, back.max()):
                self.enter(pool[int(gains.argmax())])
            elif back.max() > 1e-6:
                column = np.zeros(len(dual))
                column[int(back.argmax())] = 1
                self.enter(column, int(back.argmax()))
            else:
                return


def generate(lengths: np.ndarray, demand: np.ndarray, limit: int, spare: float = SPARE, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often) of the linear program; patterns that left the basis stand last, with 0."""
    program, least = Program(lengths, demand, limit), spare * float(lengths @ demand)
    columns = min(columns, 3 * len(lengths))
    program.start(least, columns)
    program.improve(least, columns)
    where = np.flatnonzero(program.basic >= 0)
    known = program.basic[where].tolist()
    order = known + sorted(set(range(len(program.made))) - set(known))
    often = np.concatenate([np.maximum(program.amount[where], 0), np.zeros(len(order) - len(known))])
    return np.array([program.made[j] for j in order], np.int64).reshape(len(order), len(lengths)), often


def rounded(patterns: np.ndarray, often: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Whole numbers of each pattern that demand allows: first those of the program rounded, then as many more as fit."""
    left, count = demand.copy(), np.zeros(len(patterns), np.int64)
    for more in (False, True):
        for p in np.argsort(-often, kind="stable").tolist():
            need = patterns[p]
            fits = int((left[need > 0] // need[need > 0]).min())
            n = fits if more else min(fits, int(often[p] + 0.5))
            count[p] += n
            left -= n * need
    return count


@dataclass(frozen=True)
class Plan:
    """Where the r-th remainder of each length goes.

    Slot rows, sorted by (length, rank): from rank ``rank`` on, remainders of
    ``length`` fill pattern by pattern ``each`` places of sequences from
    ``sequence`` on, beginning at ``offset``. From ``beyond[length]`` on they
    lie end to end from place ``base[length]`` of the sequences after ``tail``.
    """

    limit: int
    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    beyond: np.ndarray
    base: np.ndarray
    tail: int
    ends: np.ndarray

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of the pieces into which the given remainders go."""
        limit = self.limit
        over = rank >= self.beyond[length]
        inside = np.flatnonzero(~over)
        key = self.length.astype(np.int64) << 50 | self.rank
        slot = np.searchsorted(key, length[inside].astype(np.int64) << 50 | rank[inside], "right") - 1
        nth = rank[inside] - self.rank[slot]
        sequence, offset = self.sequence[slot] + nth // self.each[slot], self.offset[slot] + nth % self.each[slot] * length[inside]
        rows = np.flatnonzero(over)
        size = length[rows]
        begin = self.base[size] + (rank[rows] - self.beyond[size]) * size
        # Whole sequences end at multiples of the limit; those after them at ``ends``.
        whole = (self.ends[0] // limit) if len(self.ends) else 0
        of = lambda x: np.where(x < whole * limit, x // limit, whole + np.searchsorted(self.ends, x, "right") - 1)
        begins = lambda s: np.where(s <= whole, s * limit, self.ends[np.clip(s - whole, 0, len(self.ends) - 1)])
        if not len(rows):
            return inside, np.zeros(len(inside), np.int64), length[inside], sequence, offset
        first, last = of(begin), of(begin + size - 1)
        n = last - first + 1
        row = np.repeat(np.arange(len(rows)), n)
        seq = at.ranges(first, n)
        low = np.maximum(begin[row], begins(seq))
        high = np.minimum((begin + size)[row], begins(seq + 1))
        parts = [(inside, np.zeros(len(inside), np.int64), length[inside], sequence, offset), (rows[row], low - begin[row], high - low, self.tail + seq, low - begins(seq))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def plan(histogram: dict[int, int], limit: int, spare: float = SPARE, columns: int = COLUMNS) -> Plan:
    """The plan for so many remainders of each length; length ``limit`` fills a sequence by itself."""
    demand = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    lengths = np.flatnonzero(demand[:limit])
    patterns, often = generate(lengths, demand[lengths], limit, spare, columns)
    count = rounded(patterns, often, demand[lengths])
    slots, used, made = [], np.zeros(limit + 1, np.int64), 0
    if demand[limit]:
        slots.append((limit, 0, 1, 0, 0))
        used[limit], made = demand[limit], int(demand[limit])
    for p in np.flatnonzero(count).tolist():
        n, offset = int(count[p]), 0
        for k in np.flatnonzero(patterns[p]).tolist():
            each, length = int(patterns[p, k]), int(lengths[k])
            slots.append((length, int(used[length]), each, made, offset))
            used[length] += n * each
            offset += each * length
        made += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 5).T
    left = (demand - used) * np.arange(limit + 1)
    total = int(left.sum())
    at_end, ends = total - total % limit, []
    for bit in reversed(range(limit.bit_length())):  # a rest of 1000 is 512 + 256 + 128 + 64 + 32 + 8
        if total % limit >> bit & 1:
            ends.append(at_end)
            at_end += 1 << bit
    return Plan(limit, *table, used, np.cumsum(left) - left, made, np.array([*ends, at_end], np.int64))


# The operator.


def remainders(docs: DataFrame, tokenizer: str, limit: int, end: int, dtype: str) -> DataFrame:
    """A row for each piece by length alone: part, nth (rank among the part's pieces of that length), doc_id, start, length, doc_tokens, ids_crc32, ids."""
    schema = StructType([*StructType.fromDDL("part int, nth long"), docs.schema["doc_id"], *StructType.fromDDL("start long, length long, doc_tokens long, ids_crc32 long, ids binary")])
    width = np.dtype(dtype).itemsize

    def work(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in at.pieces(batches):
            ids, offs = tokens.with_end(tokenizer, batch.column(1), end, tokens.words)
            size = np.diff(offs)
            count = -(-size // limit)
            doc = np.repeat(np.arange(len(size)), count)
            start = limit * at.ranges(np.zeros(len(size), np.int64), count)
            length = np.minimum(size[doc] - start, limit)
            order = np.argsort(length, kind="stable")
            per = np.bincount(length, minlength=limit + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = seen[length[order]] + at.ranges(np.zeros(limit + 1, np.int64), per)
            seen += per
            # A document's pieces follow one another, so the batch's ids are its pieces' ids.
            if len(ids) and int(ids.max()) > np.iinfo(np.dtype(dtype)).max:
                raise ValueError(f"an id does not fit {dtype}")
            ends = np.concatenate([[0], np.cumsum(length)])
            crc = tokens.checksums(ids, ends[:-1], length)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((width * ends).astype(np.int64).tobytes()), pa.py_buffer(ids.astype(dtype).tobytes())]).cast(pa.binary())
            arrays = [pa.array(np.full(len(doc), part, np.int32)), pa.array(nth), batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(size[doc].astype(np.int64)), pa.array(crc), blobs]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end: int = 1, spare: float = SPARE, columns: int = COLUMNS, dtype: str = "<u4", ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens, without padding; a row for each piece.

    doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), doc_tokens, sequence_id, offset, and with ``ids`` the ids
    as ``dtype``. Reads ``doc_id`` and ``text``. A null text is empty, which
    leaves the end id alone; repeated rows are packed each; a null doc_id stays
    null; an empty table gives no rows. ``limit`` is a power of two. All
    sequences are full but for less than ``limit`` tokens of the whole table,
    which stand in sequences of a power of two. The driver sees one number for
    each length and solves the program; ranks are numbered in tasks, and what
    precedes a task's is joined to it. Without ``ids`` only pieces that are cut
    carry them to the tasks that place them.
    """
    if limit < 2 or limit & (limit - 1):
        raise ValueError("the limit must be a power of two")
    found = scratch.store(remainders(docs, tokenizer, limit, end, dtype), "stock-pieces")
    counts = scratch.store(found.groupBy("part", "length").agg(F.count("*").alias("n")), "stock-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    chosen, width = plan(histogram, limit, spare, columns), np.dtype(dtype).itemsize
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # From which rank on a length's pieces lie end to end, so that they may be cut: one number for each length.
    beyond = F.element_at(F.lit(chosen.beyond.tolist()), F.col("length").cast("int") + 1)
    held = found if ids else found.drop("ids")
    ranked = held.join(bases, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    if not ids:
        # Stored, so that Spark knows how few they are before it decides whether all ids must be shuffled to find theirs.
        cut = scratch.store(ranked.where(F.col("rank") >= beyond).select("part", "length", "nth"), "stock-cut")
        cut = found.select("part", "length", "nth", "ids").join(cut, ["part", "length", "nth"])
        ranked = ranked.join(cut, ["part", "length", "nth"], "left")
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", "rank", "ids_crc32", "ids")
    fields = [docs.schema["doc_id"], *StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")]
    schema = StructType(fields + ([*StructType.fromDDL("ids binary")] if ids else []))

    def work(batches):
        for batch in (whole.slice(k, 2048) for whole in batches for k in range(0, whole.num_rows, 2048)):
            length, rank = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            row, start, size, sequence, offset = chosen.places(length, rank)
            order = np.lexsort((start, row))
            row, start, size, sequence, offset = (x[order] for x in (row, start, size, sequence, offset))
            take = pa.array(row)
            crc, data = batch.column(5).to_numpy()[row], batch.column(6).take(take)
            parts = np.flatnonzero(size != length[row])
            if len(parts):
                got = {k: data[k].as_py()[width * start[k] : width * (start[k] + size[k])] for k in parts.tolist()}
                crc[parts] = [zlib.crc32(np.frombuffer(got[k], dtype).astype("<u4").tobytes()) for k in parts.tolist()]
                if ids:
                    data = pa.array([got[k] if k in got else data[k].as_py() for k in range(len(row))], pa.binary())
            arrays = [batch.column(0).take(take), pa.array(batch.column(1).to_numpy()[row] + start), pa.array(size.astype(np.int64)), pa.array(crc), batch.column(3).take(take), pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*arrays, *([data] if ids else [])], names=schema.names)

    return ranked.mapInArrow(work, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (in the pieces' form), cu_seqlens, doc_ids. A group is one sequence, so bounded."""
    one = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(one.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("p", lambda x: x["offset"] + x["length"]))
    return rows.select("sequence_id", joined.alias("ids"), ends.alias("cu_seqlens"), F.col("p.doc_id").alias("doc_ids"))
