"""Best-fit packing of documents into sequences with several capacities.

A sequence may hold so many tokens, so many documents and so much attention
cost (the sum of squared segment lengths). A task places the pieces that it has
read in decreasing order, each into the open sequence that vector best-fit
selects among those in which it keeps within every capacity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import scratch, tokens


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold. rule: 'norm' takes the sequence whose residual
    vector, after placing, has the least weighted norm; 'dot' the one whose
    residual vector has the greatest weighted dot-product with the piece.

    Residuals are shares of their capacity. Without a limit of its own the
    number of documents may reach ``tokens`` and the cost its square, the most
    that so many tokens can make; both still weigh in the choice.
    """

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], np.float64)


def place(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    limits = capacity.limits()
    size = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], 1)
    if len(size) and (size.max(0) > limits).any():
        raise ValueError("a piece exceeds a capacity by itself")
    weights = np.array(capacity.weights) / limits**2
    bins, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = lengths == capacity.tokens
    made = int(whole.sum())
    bins[whole] = np.arange(made)
    order = np.flatnonzero(~whole)
    order = order[np.argsort(-lengths[order], kind="stable")]
    least = lengths.min(initial=capacity.tokens)
    left = np.empty((3, 1024))
    name = np.empty(1024, np.int64)
    n = 0
    for k in order.tolist():
        item = size[k]
        rest = left[:, :n] - item[:, None]
        fits = rest.min(0) >= 0 if n else np.zeros(0, bool)
        if fits.any():
            if capacity.rule == "norm":
                score = weights @ (rest * rest)
            else:
                score = -((weights * item) @ left[:, :n])
            j = int(np.where(fits, score, np.inf).argmin())
        else:
            if n == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([name, np.empty_like(name)])
            j, n = n, n + 1
            left[:, j], name[j] = limits, made
            made += 1
        bins[k], offset[k] = name[j], capacity.tokens - left[0, j]
        left[:, j] -= item
        if left[0, j] < least or left[1, j] < 1 or left[2, j] < least**2:  # nothing fits any more
            n -= 1
            left[:, j], name[j] = left[:, n], name[n]
    return bins, offset


#: Pieces and tokens that a task packs at once.
PIECES, TASK_TOKENS = 200_000, 16 << 20
#: Pieces that a task packs again.
AGAIN = 50_000


def _packed(batches, capacity: Capacity, pieces: int = PIECES, most: int = TASK_TOKENS):
    """Batches of pieces with sequence_id, offset and room, the tokens that their sequence has left."""
    made = TaskContext.get().partitionId() << 36

    def emit(held):
        nonlocal made
        whole = pa.Table.from_batches(held).combine_chunks()
        length = whole["length"].to_numpy()
        bins, offset = place(length, capacity)
        room = capacity.tokens - np.bincount(bins, weights=length).astype(np.int64)[bins]
        out = whole.append_column("sequence_id", pa.array(bins + made)).append_column("offset", pa.array(offset)).append_column("room", pa.array(room))
        made += int(bins.max()) + 1
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    held, count, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count, size = count + batch.num_rows, size + int(batch.column(3).to_numpy().sum())
            if count >= pieces or size >= most:
                yield from emit(held)
                held, count, size = [], 0, 0
    if held:
        yield from emit(held)


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, end: int = 2) -> DataFrame:
    """Pack all documents; a row for each piece.

    Reads ``doc_id`` and ``text``; null text is empty, which leaves the end id
    alone; repeated rows are packed each; null doc_ids stay null. Each task packs
    what it has read, a bounded number of pieces and tokens at once; the pieces
    of sequences that are left part-full, a few for each, are packed once more
    together, in tasks of a bounded number of pieces. Reads the texts once.
    """
    capacity = capacity or Capacity()

    def cut(batches):
        for batch in at.pieces(batches):
            ids, offs = tokens.with_end(tokenizer, batch.column(1), end)
            doc, piece, start, length = tokens.cut(offs, capacity.tokens)
            crc = tokens.checksums(ids, offs[doc] + start, length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, room long")])
    first = scratch.store(docs.select("doc_id", "text").mapInArrow(lambda batches: _packed(cut(batches), capacity), schema), "packed-pieces")
    loose = first.where("room > 0").drop("sequence_id", "offset", "room")
    again = loose.repartition(loose.count() // AGAIN + 1).mapInArrow(lambda batches: _packed(batches, capacity, 2 * AGAIN), schema)
    # Numbers of the second packing are negative, so that no sequence of the first has them.
    return first.where("room = 0").unionByName(again.withColumn("sequence_id", -1 - F.col("sequence_id"))).drop("room")
