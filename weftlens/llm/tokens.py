"""Token ids of whole documents, cut into pieces that fit a sequence."""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa

from weftlens.llm import arrowtext as at
from weftlens.llm.bpe import LETTER, OTHER, MatchTable, char_classes

#: Matches that the library encodes at once.
SLICE = 4000
#: Matches that a process keeps: its worker may hold what stages before this one have left, too.
KEPT = 600_000


def _library(path: str):
    """The library's encoder of a list of strings, for a file of its own format."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True

    def encode(words: list[str]) -> list[list[int]]:
        # In slices: what the library returns for a word takes far more room than its ids.
        slices = (words[k : k + SLICE] for k in range(0, len(words), SLICE))
        return [x.ids for part in slices for x in coder.encode_batch_fast(part, add_special_tokens=False)]

    return encode


@cache
def matches(path: str) -> MatchTable:
    """Column encoder by the ``tokenizers`` library, for a byte-level BPE file. One per process.

    The library is asked for new matches of the split pattern only; the ids of
    a text are those of its matches, one after the other. Special tokens'
    strings in a text are ordinary text.
    """
    return MatchTable(_library(path), KEPT)


class WordTable(MatchTable):
    """Encodes string columns word by word, for a vocabulary that lowers and drops white space.

    Words end at ASCII white space, over which neither normalisation nor a
    match of the split pattern reaches, and between a letter and a mark that
    begins a match; all else is left to the library.
    """

    def spans(self, cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (cp != 32) & ((cp < 9) | (cp > 13))
        border = np.zeros(len(cp) + 1, bool)
        border[offs] = True
        # Letters that every edition of Unicode has; marks that combine with nothing before them and start no contraction.
        # U+0130 is lowered to an i and a combining dot, which no letter is and which the marks after it belong to.
        letter = (char_classes()[cp] == LETTER) & (cp != 0x130) & ((cp < 0x250) | ((cp >= 0x4E00) & (cp <= 0x9FA5)) | ((cp >= 0xAC00) & (cp <= 0xD7A3)))
        mark = (cp > 32) & (cp < 127) & (cp != 39) & (char_classes()[cp] == OTHER) | (cp == 0x3001) | (cp == 0x3002)
        border[1:-1] |= letter[:-1] & mark[1:]
        left = inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]]))
        right = inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))
        return np.flatnonzero(left), np.flatnonzero(right) + 1

    def encode_array(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offs = at.buffers(arr)
        # A-Z before ASCII are lowered here, so that fewer words differ; before anything else they may compose first.
        upper = (raw >= 65) & (raw <= 90)
        upper[:-1] &= raw[1:] < 128
        low = (raw + 32 * upper.astype(np.uint8)).tobytes()
        column = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs, np.int64).tobytes()), pa.py_buffer(low))
        return super().encode_array(column)


@cache
def words(path: str) -> WordTable:
    """Like matches(), for a BPE file with word ends that drops white space."""
    return WordTable(_library(path), KEPT)


def with_end(path: str, texts: pa.Array, end: int, table=matches) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each text's ids and then the end id; null counts as empty."""
    ids, offs = table(path).encode_array(texts)
    n = len(texts)
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offs))] = ids
    return out, offs + np.arange(n + 1)


def cut(offs: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """(document, piece, start, length) of pieces of at most ``limit`` ids.

    Only longer documents are cut; all their pieces but the first have ``limit`` ids.
    """
    size = np.diff(offs)
    count = -(-size // limit)
    doc = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    short = np.where(size % limit == 0, limit, size % limit)[doc]
    start = np.where(piece == 0, 0, short + (piece - 1) * limit)
    return doc, piece, start, np.where(piece == 0, short, limit)


def checksums(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    spans = zip((4 * starts).tolist(), (4 * (starts + lengths)).tolist(), strict=True)
    return np.fromiter((zlib.crc32(raw[s:e]) for s, e in spans), np.int64, len(starts))
