"""Words and word shingles of Arrow string columns, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weftlens.llm import arrowtext as at
from weftlens.llm.bpe import SPACE, char_classes


def split(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, word starts, word ends, word hashes, words by document) of a column."""
    raw, offs = at.buffers(arr)
    cp = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(cp) != len(raw):
        offs = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    inside = char_classes()[cp] != SPACE
    border = np.zeros(len(cp) + 1, bool)
    border[offs] = True
    left = inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]]))
    right = inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    per_doc = np.diff(np.searchsorted(starts, offs))
    return cp, starts, ends, at.span_hashes(cp, starts, ends), per_doc


def shingles(hashes: np.ndarray, per_doc: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, number) of each document's distinct shingles of ``size`` words.

    A text of fewer words has one shingle, of all its words; without words it has none.
    """
    first = np.cumsum(per_doc) - per_doc
    count = np.where(per_doc >= size, per_doc - size + 1, np.minimum(per_doc, 1))
    doc = np.repeat(np.arange(len(per_doc)), count)
    start = at.ranges(first, count)
    end = (first + per_doc)[doc]
    out = np.zeros(len(start), at.U64)
    padded = np.append(hashes, at.U64(0))
    for k in range(size):
        word = np.where(start + k < end, padded[np.minimum(start + k, len(hashes))], at.U64(0))
        out = at.mix(out * at.U64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((out, doc)) if len(out) else np.zeros(0, np.int64)
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    where = np.flatnonzero(new)
    return out[where], doc[where], np.diff(np.append(where, len(out)))
