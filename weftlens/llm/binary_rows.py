"""Packed token-id rows in binary form.

Each task packs the documents that it has read, by best-fit-decreasing: a
segment tree over residual capacities finds the fullest row that still has
room. No shuffle is needed, and a task holds a bounded number of ids at once.
A row carries its id matrix line, its cumulative segment lengths and the
places where positions start again at 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import tokens


class Capacities:
    """A segment tree that counts open rows by residual capacity."""

    def __init__(self, limit: int):
        self.half = 1 << max(1, limit.bit_length())
        self.count = [0] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        k = room + self.half
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``size``, taken out; None if there is none."""
        count, k = self.count, size + self.half
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.half:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.half
        self._change(room, -1)
        return room, self.rows[room].pop()


def place(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each piece, by best-fit-decreasing."""
    row, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == limit
    made = int(full.sum())
    row[full] = np.arange(made)
    tree = Capacities(limit)
    order = np.flatnonzero(~full)
    order = order[np.argsort(-lengths[order], kind="stable")]
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = tree.take(size)
        if found is None:
            found = (limit, made)
            made += 1
        room, r = found
        row[k], offset[k] = r, limit - room
        if room > size:
            tree.add(room - size, r)
    return row, offset


def rows(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, pad: int = 0, dtype: str = "<u2", task_tokens: int = 16 << 20) -> DataFrame:
    """Packed rows of ``limit`` ids each.

    row_id; ids: the matrix line as ``dtype``, padded with ``pad``; n_tokens
    without padding; cu_seqlens: 0 and each segment's end; position_resets:
    each segment's place; doc_ids, pieces, starts: of each segment. Reads
    ``doc_id`` and ``text``; null text is empty; repeated rows are packed each.
    """
    source = docs.select("doc_id", "text")
    schema = StructType([*StructType.fromDDL("row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>"), StructField("doc_ids", ArrayType(docs.schema["doc_id"].dataType)), *StructType.fromDDL("pieces array<int>, starts array<long>")])

    def emit(held: list, first: int) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate([h[0] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        start, length, piece = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
        at_ids = np.concatenate([h[5] + b for h, b in zip(held, base, strict=True)])
        doc = pa.concat_arrays([h[1] for h in held])
        row, offset = place(length, limit)
        order = np.lexsort((offset, row))
        row, offset, length = row[order], offset[order], length[order]
        n = int(row[-1]) + 1
        matrix = np.full(n * limit, pad, np.dtype(dtype))
        matrix[at.ranges(row * limit + offset, length)] = ids[at.ranges(at_ids[order], length)]
        per = np.bincount(row, minlength=n)
        cuts = np.concatenate([[0], np.cumsum(per)])
        lists = lambda values, to=cuts: pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), values)
        ends = np.zeros(len(row) + n, np.int32)
        ends[np.arange(len(row)) + row + 1] = offset + length
        total = np.bincount(row, weights=length, minlength=n).astype(np.int32)
        raw = matrix.tobytes()
        width = limit * matrix.itemsize
        blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, len(raw) + 1, width, np.int32).tobytes()), pa.py_buffer(raw)])
        arrays = [pa.array(np.arange(n, dtype=np.int64) + first), pa.array(total), blobs, lists(pa.array(ends), cuts + np.arange(n + 1)), lists(pa.array(offset.astype(np.int32))), lists(doc.take(pa.array(order))), lists(pa.array(piece[order].astype(np.int32))), lists(pa.array(start[order]))]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names), first + n

    def work(batches):
        first, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in at.pieces(batches):
            ids, offs = tokens.with_end(tokenizer, batch.column(1), end)
            if len(ids) and int(ids.max()) > np.iinfo(np.dtype(dtype)).max:
                raise ValueError(f"an id does not fit {dtype}")
            doc, piece, start, length = tokens.cut(offs, limit)
            held.append((ids.astype(np.dtype(dtype)), batch.column(0).take(pa.array(doc)), start, length, piece, offs[doc] + start))
            size += len(ids)
            if size >= task_tokens:
                out, first = emit(held, first)
                yield from (out.slice(k, 4096) for k in range(0, out.num_rows, 4096))
                held, size = [], 0
        if held:
            out, first = emit(held, first)
            yield from (out.slice(k, 4096) for k in range(0, out.num_rows, 4096))

    return source.mapInArrow(work, schema)


def write(packed: DataFrame, path: str) -> None:
    """Write the rows as binary Parquet columns, from the tasks that made them."""
    packed.write.option("compression", "zstd").parquet(path)


def position_ids(cu_seqlens) -> np.ndarray:
    """A row's positions, starting again at 0 with each segment."""
    ends = np.asarray(cu_seqlens, np.int64)
    return at.ranges(np.zeros(len(ends) - 1, np.int64), np.diff(ends))


def digests(packed: DataFrame) -> DataFrame:
    """The rows with a CRC-32 in place of their ids."""
    return packed.select("row_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts")
