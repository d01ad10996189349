"""Byte-level BPE in linear time, without replaying merges.

A text is cut into matches of the vocabulary's split pattern. Each match is
mapped to Latin-1, so that one character is one byte, and an Aho-Corasick
automaton yields the longest vocabulary entry at each byte. The encoder walks
from longest matches and steps back to shorter ones when two neighbours could
not stand side by side in a BPE result. Whether they could is found by undoing
their merges step by step, and is memoised. The token sequence in which all
neighbours are compatible is unique and is the one that merging would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from weftlens.llm import arrowtext as at

#: Contractions that the split pattern takes as one match when a match starts at them.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def char_classes() -> np.ndarray:
    """The class of each code point, as the split pattern distinguishes them."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def match_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """True where a match of the split pattern begins. doc_starts: of non-empty documents."""
    n = len(cp)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    white = kind == SPACE
    start = first[:n].copy()
    inner = ~first[1:n]
    start[1:] |= inner & ~white[1:] & (kind[1:] != kind[:-1]) & (cp[:-1] != 32)
    start[1:] |= inner & white[1:] & ~white[:-1]
    start[:-1] |= inner & white[:-1] & ~white[1:]
    quotes = np.flatnonzero((cp == 39) & start)
    if quotes.size:
        room = np.searchsorted(ends := np.flatnonzero(first), quotes, "right")
        left = ends[room] - quotes
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        for word in CONTRACTIONS:
            fits = left >= len(word)
            for k, c in enumerate(word):
                fits &= padded[quotes + k] == ord(c)
            hit = quotes[fits]
            start[hit + 1] = False
            after = hit + len(word)
            start[after[after < n]] = True
    return start


#: Matches that a task keeps, with ten times as many ids and characters at most: some 250 MB. Far fewer are encoded again and again.
ENTRIES = 1_500_000
#: Places of the direct-mapped table: few matches go to the dictionary, which takes far more room for each.
SLOT_BITS = 22
#: Bytes of text that are cut into matches at once.
BLOCK = 8 << 20


def block_cuts(raw: np.ndarray, limit: int) -> list[int]:
    """Places from 0 to len(raw), about ``limit`` apart, between an ASCII letter and a blank, where a match always ends."""
    letter = (raw | 32) - 97 < 26
    good = np.flatnonzero(letter[:-1] & (raw[1:] == 32)) + 1
    cuts = [0]
    while len(raw) - cuts[-1] > limit:
        k = int(np.searchsorted(good, cuts[-1] + limit, "right")) - 1
        if k < 0 or good[k] <= cuts[-1]:  # no such place within the limit: the next one after it
            k += 1
        if k >= len(good):
            break
        cuts.append(int(good[k]))
    return [*cuts, len(raw)]


class ByteBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.ranks = ranks
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.flat = np.frombuffer(b"".join(self.words), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.trie = ahocorasick.Automaton()
        for word, rank in ranks.items():
            self.trie.add_word(word.decode("latin-1"), (rank, len(word)))
        self.trie.make_automaton()
        self._shorter: list[int] = [-1] * len(self.words)
        self._joined: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = []
        self._fits: dict[tuple[int, int], bool] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """For each entry its longest proper prefix in the vocabulary and the two entries that BPE merges to it."""
        ranks, shorter = self.ranks, self._shorter
        for rank, word in enumerate(self.words):
            for n in range(len(word) - 1, 0, -1):
                if (p := ranks.get(word[:n])) is not None:
                    shorter[rank] = p
                    break
        for rank, word in enumerate(self.words):
            left, halves = shorter[rank], (rank, rank)
            while left >= 0:
                right = ranks.get(word[len(self.words[left]) :], rank)
                if left < rank and right < rank and self._compatible(left, right):
                    self._joined[left, right] = rank
                    halves = (left, right)
                    break
                left = shorter[left]
            self._halves.append(halves)
        self._fits.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b apart: no merge across the border comes before the merges inside them."""
        joined, halves, bound = self._joined, self._halves, 1 << 62
        while True:
            if joined.get((a, b), bound) < bound:
                return False
            # Undo the later of the two last merges; on equal ranks the right one came later.
            for take_left in (True, False) if a > b else (False, True):
                whole = a if take_left else b
                part = halves[whole][1 if take_left else 0]
                bound = whole if take_left else whole + 1
                if part != whole:
                    if take_left:
                        a = part
                    else:
                        b = part
                    break
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [-1] * (n + 1)
        reach = [0] * n
        for end, (rank, size) in self.trie.iter(word.decode("latin-1")):
            if size > reach[s := end - size + 1]:
                longest[s], reach[s] = rank, size
        words, shorter, fits = self.words, self._shorter, self._fits
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            if token < 0:
                if not out:
                    raise ValueError("a byte of the text is not in the vocabulary")
                dead[pos] = 1
                token = out.pop()
                pos -= len(words[token])
                token = shorter[token]
                continue
            to = pos + len(words[token])
            good = not dead[to]
            if good and out:
                pair = (out[-1], token)
                good = fits.get(pair)
                if good is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    good = fits[pair] = self._compatible(*pair)
            if good:
                out.append(token)
                pos = to
                token = longest[pos]
            else:
                token = shorter[token]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        ids = ids.astype(np.int64)
        return self.flat[at.ranges(self.offsets[ids], self.lengths[ids])]


class MatchTable:
    """Encodes string columns match by match.

    Matches repeat a lot, so their ids are kept by hash in a direct-mapped
    table; ``encode_many`` is asked for new ones only. What stands behind an
    entry is kept and compared on every hit, so a hash never decides alone. The
    table is emptied when it has grown to its bound.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], most: int = ENTRIES):
        self.encode_many, self.most = encode_many, most
        self._empty()

    def _empty(self) -> None:
        self._keys = np.zeros(1 << SLOT_BITS, at.U64)
        self._slot = np.zeros(1 << SLOT_BITS, np.int32)
        self._rest: dict[int, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._at, self._count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self._entries = self._used = 0
        # The characters behind each entry, and matches whose hash another one has.
        self._spans, self._held = np.zeros(1 << 18, np.uint32), 0
        self._from, self._size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self._twins: dict[str | bytes, int] = {}

    def _room(self, name: str, n: int) -> None:
        """Makes an array of the table hold n numbers at least. What is not used yet takes no memory, as nothing is written there."""
        held = getattr(self, name)
        if n > len(held):
            room = np.zeros(max(n, 2 * len(held)), held.dtype)
            room[: len(held)] = held
            setattr(self, name, room)

    def _add(self, ids: list[list[int]], spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries of ids, and of the characters behind them, one after the other."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        k, to, held = self._entries + len(ids), self._used + int(counts.sum()), self._held + len(spans)
        for name in ("_at", "_count", "_from", "_size"):
            self._room(name, k)
        self._room("_ids", to)
        self._room("_spans", held)
        self._ids[self._used : to] = np.fromiter(chain.from_iterable(ids), np.uint32, to - self._used)
        self._spans[self._held : held] = spans
        new = slice(self._entries, k)
        self._at[new], self._count[new] = self._used + np.cumsum(counts) - counts, counts
        self._from[new], self._size[new] = self._held + np.cumsum(sizes) - sizes, sizes
        self._entries, self._used, self._held = k, to, held
        return np.arange(new.start, k)

    def _others(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which matches are not what stands behind their entry."""
        size = ends - starts
        wrong = self._size[entry] != size
        size = np.where(wrong, 0, size).astype(np.int64)
        same = values[at.ranges(starts, size)] == self._spans[at.ranges(self._from[entry], size)]
        if not same.all():
            wrong[np.repeat(np.arange(len(size)), size)[~same]] = True
        return np.flatnonzero(wrong)

    def entries(self, text: str | bytes, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The table's entry for each match text[start:end]; values: the code points or bytes of text."""
        if self._entries > self.most or self._used > 10 * self.most or self._held > 10 * self.most:
            self._empty()
        slots = (hashes >> at.U64(64 - SLOT_BITS)).astype(np.int64)
        out = self._slot[slots].astype(np.int64)
        miss = np.flatnonzero(self._keys[slots] != hashes)
        if miss.size:
            found, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            got = np.fromiter((self._rest.get(h, -1) for h in found.tolist()), np.int64, len(found))
            new = np.flatnonzero(got < 0)
            begin, end = starts[where[new]], ends[where[new]]
            ids = self.encode_many([text[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)])
            got[new] = entry = self._add(ids, values[at.ranges(begin, end - begin)], end - begin)
            # The first new match of a free slot gets it; the rest are kept in a dictionary.
            slot = slots[where[new]]
            _, first = np.unique(slot, return_index=True)
            first = first[self._keys[slot[first]] == 0]
            self._keys[slot[first]], self._slot[slot[first]] = found[new][first], entry[first]
            rest = np.ones(len(slot), bool)
            rest[first] = False
            self._rest.update(zip(found[new][rest].tolist(), entry[rest].tolist(), strict=True))
            out[miss] = got[back]
        for k in self._others(values, starts, ends, out).tolist():
            match = text[starts[k] : ends[k]]
            if match not in self._twins:
                self._twins[match] = int(self._add(self.encode_many([match]), values[starts[k] : ends[k]], ends[k : k + 1] - starts[k])[0])
            out[k] = self._twins[match]
        return out

    def encode_array(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string column; null counts as empty. Long texts are taken in blocks."""
        raw, offs = at.buffers(arr)
        if len(raw) <= BLOCK:
            return self._encode(raw, offs)
        cuts = block_cuts(raw, BLOCK)
        places, counts, ids = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            inner = np.unique(np.concatenate([[a], offs[(offs > a) & (offs < b)], [b]]))
            got, upto = self._encode(raw[a:b], inner - a)
            ids.append(got)
            places.append(inner[1:])
            counts.append(upto[1:] + counts[-1][-1])
        place, count = np.concatenate(places), np.concatenate(counts)
        return np.concatenate(ids), count[np.searchsorted(place, offs)]

    def spans(self, cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the matches of the split pattern, which leave no gap."""
        starts = np.flatnonzero(match_starts(cp, offs[:-1][offs[1:] > offs[:-1]]))
        return starts, np.append(starts[1:], len(cp))

    def _encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        text = raw.tobytes().decode()
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(cp) != len(raw):
            offs = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
        starts, ends = self.spans(cp, offs)
        entry = self.entries(text, cp, starts, ends, at.span_hashes(cp, starts, ends))
        counts = self._count[entry]
        ids = self._ids[at.ranges(self._at[entry], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[np.searchsorted(starts, offs)]


@cache
def load(path: str) -> ByteBPE:
    """The coder for a file of ranks: a line holds the entry in base 64 and its rank. One per process."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)})


@cache
def matches(path: str) -> MatchTable:
    """Column encoder by backtracking, for a file of ranks. One per process."""
    coder = load(path)
    return MatchTable(lambda words: [coder.encode(w.encode()) for w in words])


# The operator.


def _per_piece(work: Callable[[pa.RecordBatch], pa.RecordBatch]):
    return lambda batches: map(work, at.pieces(batches))


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids added: array<int>, empty for null or empty text.

    Other columns stay as they are; a column named like ``ids`` is replaced.
    """
    docs = docs.drop(ids)
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType(), False))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, offs = matches(ranks_path).encode_array(batch.column(batch.schema.get_field_index(text)))
        column = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(got.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    return docs.mapInArrow(lambda batches: map(work, at.pieces(batches, column=text)), schema)


def decode(frame: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """frame with the bytes of its ids added as binary; null ids give null bytes."""
    frame = frame.drop(out)
    schema = StructType([*frame.schema.fields, StructField(out, BinaryType())])

    def work(batches):
        coder = load(ranks_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            column = pa.array([None if x is None else coder.decode(np.array(x, np.int64)).tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return frame.mapInArrow(work, schema)


def digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document its token count and the digests of its ids and of the bytes they decode to.

    Reads ``doc_id`` and ``text`` only; repeated rows give repeated rows; a
    null doc_id stays null; null text counts as empty.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = load(ranks_path)
        ids, offs = matches(ranks_path).encode_array(batch.column(1))
        ids = np.ascontiguousarray(ids, "<u4")
        text = memoryview(coder.decode(ids))
        ends = np.concatenate([[0], np.cumsum(coder.lengths[ids])])[offs].tolist()
        raw, cuts = memoryview(ids.view(np.uint8)), (4 * offs).tolist()
        hexes = [[hashlib.sha256(data[s:e]).hexdigest() for s, e in pairwise(to)] for data, to in ((raw, cuts), (text, ends))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(hexes[0], pa.string()), pa.array(hexes[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(_per_piece(work), StructType([docs.schema["doc_id"], *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string")]))
