"""Language-model scores: causal self-attention over subword ids, mixed with corpus counts.

Words are spelled in units: frequent subword ids of a public tokenizer, and
single bytes for the rest. A small causal self-attention model gives each unit's
probability from the units in its window; windows overlap, so each unit is scored
once and with context. The probability of a word is the mixture of its spelling's
and of its share of the training corpus.

Counts, units, weights and the mixture's share are learnt from all training
documents, whole. Weights are trained in rounds: each document is in one of them,
tasks go through their documents from the round's weights, and what they end with
is averaged by the units they have seen.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import bpe, labelled, scratch

WINDOW, STRIDE = 16, 8
DIM, HIDDEN = 16, 24
MEMBERS = 46
UNITS = 1750
#: Words whose counts every task holds; the rest are joined.
FREQUENT = 1 << 18
#: Words whose units a process keeps.
KEPT = 600_000
FOLD = 1
#: Rounds of training; the first two have a 128th of the documents each, every later one twice as many as that before it.
ROUNDS = 8
#: Units that a task trains on in a round, units that are shuffled together, and units that training sees at least, by going over few documents up to PASSES times.
TASK, CHUNK, LEAST, PASSES = 1_800_000, 400_000, 5_500_000, 20
#: The ratio of a word's two probabilities is counted by 256ths of a natural log.
BINS = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words by document)."""
    raw, offs = at.buffers(arr)
    raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offs] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return raw, starts, ends, np.diff(np.searchsorted(starts, offs))


@dataclass
class Spelling:
    """unit_of: each tokenizer id's unit, -1 where it is spelled in bytes; initial: units that begin a word."""

    tokenizer: str
    ranks: str
    unit_of: np.ndarray
    initial: np.ndarray

    def __post_init__(self):
        self.end, self.begin, self.pad = len(self.initial) - 1, len(self.initial), len(self.initial) + 1
        self._coder = self._spelt = None

    def __getstate__(self):
        return self.__dict__ | {"_coder": None, "_spelt": None}

    def ids(self, words: list[bytes]) -> list[list[int]]:
        if self._coder is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._coder = Tokenizer.from_file(self.tokenizer)
            self._coder.encode_special_tokens = True
        # In slices: what the library returns for a word takes far more room than its ids.
        slices = (words[k : k + 4000] for k in range(0, len(words), 4000))
        return [x.ids for part in slices for x in self._coder.encode_batch_fast([" " + w.decode() for w in part], add_special_tokens=False)]

    def units(self, words: list[bytes]) -> list[list[int]]:
        if self._spelt is None:
            unit_of, coder = self.unit_of.tolist(), bpe.load(self.ranks)
            self._spelt = [(u,) if u >= 0 else tuple(unit_of[coder.ranks[bytes([b])]] for b in w) for u, w in zip(unit_of, coder.words, strict=False)]
        spelt = self._spelt
        return [[u for k in ids for u in spelt[k]] for ids in self.ids(words)]


def choose_units(words: dict[bytes, int], tokenizer: str, ranks: str, most: int = UNITS, more: tuple[np.ndarray, np.ndarray] | None = None) -> Spelling:
    """The ids that spell the words most often, all single bytes, and an end of text; more: ids of further words, and their numbers."""
    coder = bpe.load(ranks)
    number = np.zeros(len(coder.words) + 1)
    if more is not None:
        number[more[0]] += more[1]
    blank = Spelling(tokenizer, ranks, np.zeros(0, np.int64), np.zeros(1, bool))
    for ids, n in zip(blank.ids(list(words)), words.values(), strict=True):
        number[ids] += n
    single = sorted(coder.ranks[bytes([b])] for b in range(256))
    chosen = sorted({*single, *(k for k in np.argsort(-number, kind="stable")[:most].tolist() if number[k] > 0 and k < len(coder.words))})
    unit_of = np.full(len(number), -1)
    unit_of[chosen] = np.arange(len(chosen))
    initial = np.array([*(coder.words[k][:1] == b" " for k in chosen), True])
    return Spelling(tokenizer, ranks, unit_of, initial)


class Words(bpe.MatchTable):
    """The units of words, kept by hash; entry 0 is the end of text. Counts of frequent words come along."""

    def __init__(self, spelling: Spelling, hashes: np.ndarray, counts: np.ndarray):
        self.spelling, self.hashes, self.counts = spelling, hashes, counts
        super().__init__(spelling.units, KEPT)

    def _empty(self) -> None:
        super()._empty()
        self._add([[self.spelling.end]], np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self._filled, self._c = 1, np.zeros(1 << 16, np.int64)

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, counts) of words; the count of a word not among the frequent ones is 0."""
        entry = self.entries(raw.tobytes(), raw, starts, ends, hashes)
        while len(self._c) < self._entries:
            self._c = np.resize(self._c, 2 * len(self._c))
        fresh = entry >= self._filled
        if fresh.any() and len(self.hashes):
            h = hashes[fresh]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            self._c[entry[fresh]] = np.where(self.hashes[k] == h, self.counts[k], 0)
        elif fresh.any():
            self._c[entry[fresh]] = 0
        self._filled = self._entries
        return entry, self._c[entry]


def laid_out(units: np.ndarray, sizes: np.ndarray, begin: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(input units, place of each block's first target). A document has STRIDE places of
    padding and then a block for each STRIDE targets, whose inputs are the units before
    them; a window is a block and the STRIDE places before it. Padding blocks have place -1."""
    blocks = -(-sizes // STRIDE)
    base = np.cumsum((blocks + 1) * STRIDE) - (blocks + 1) * STRIDE
    flat = np.full(int(((blocks + 1) * STRIDE).sum()), pad, np.int32)
    flat[(base + STRIDE)[sizes > 0]] = begin
    first = np.cumsum(sizes) - sizes
    inner = np.maximum(sizes - 1, 0)
    flat[at.ranges(base + STRIDE + 1, inner)] = units[at.ranges(first, inner)]
    rows = at.ranges(np.zeros(len(sizes), np.int64), blocks)
    place = np.full(len(flat) // STRIDE, -1)
    place[np.repeat(base // STRIDE, blocks) + 1 + rows] = np.repeat(first, blocks) + rows * STRIDE
    return flat, place


def windows(units: np.ndarray, sizes: np.ndarray, begin: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of input units, place of each window's first target)."""
    flat, place = laid_out(units, sizes, begin, pad)
    blocks = np.flatnonzero(place >= 0)
    return flat[(blocks * STRIDE - (WINDOW - STRIDE))[:, None] + np.arange(WINDOW)], place[blocks]


_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None], 0, -1e9).astype(np.float32)


class Attention:
    """One head over a window, a hidden layer, and a softmax in two steps: the unit's class, then the unit."""

    def __init__(self, spelling: Spelling, order: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = len(spelling.initial)
        self.pad = spelling.pad
        self.klass, self.member, at_class = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        starts = []
        for kind in (True, False):
            group = order[spelling.initial[order] == kind]
            k = np.arange(len(group))
            self.klass[group], self.member[group] = at_class + k // MEMBERS, k % MEMBERS
            made = -(-len(group) // MEMBERS)
            starts += [kind] * made
            at_class += made
        self.initial = np.array(starts)
        c = len(starts)
        draw = lambda *s, by=1.0: rng.normal(0, by / np.sqrt(s[-2] if len(s) > 1 else 1), s).astype(np.float32)
        self.p = {
            "e": rng.normal(0, 0.3, (n + 2, DIM)).astype(np.float32), "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM),
            "r": draw(DIM, HIDDEN), "o": draw(DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "near": np.zeros((STRIDE, WINDOW), np.float32),
            "a": draw(HIDDEN, c), "a0": np.zeros(c, np.float32), "m": draw(c, HIDDEN, MEMBERS, by=0.3), "m0": np.zeros((c, MEMBERS), np.float32),
        }
        self.empty = np.ones((c, MEMBERS), bool)
        self.empty[self.klass, self.member] = False

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring needs, with the projections of every unit made once."""
        p = self.p
        blind = np.zeros(len(p["e"]), np.float32)
        blind[self.pad] = -1e9
        return {"q": p["e"] @ p["q"] / np.float32(np.sqrt(DIM)), "k": p["e"] @ p["k"], "v": p["e"] @ p["v"] @ p["o"], "r": p["e"] @ p["r"] + p["b"], "near": p["near"] + _MASK, "blind": blind, "m0": np.where(self.empty, np.float32(-1e9), p["m0"])}

    def score(self, t: dict[str, np.ndarray], units: np.ndarray, sizes: np.ndarray, begin: int, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs (of each unit's probability, of the probability that a word begins there)."""
        flat, first = laid_out(units, sizes, begin, self.pad)
        last = np.zeros(len(first), np.int64)
        last[first >= 0] = np.repeat(np.cumsum(sizes), -(-sizes // STRIDE))
        out, new = np.zeros(len(units)), np.zeros(len(units))
        a, a0, m, m0 = self.p["a"], self.p["a0"], self.p["m"], t["m0"]
        kinds = np.stack([np.ones(len(a0)), self.initial], 1).astype(np.float32)
        ones = {n: np.ones(n, np.float32) for n in (WINDOW, MEMBERS)}
        for k in range(1, len(first), batch):
            n = min(batch, len(first) - k)
            u = flat[(k - 1) * STRIDE : (k + n) * STRIDE]
            # Neighbouring windows share half of their places, so they are views of one array.
            over = lambda x, n=n: np.lib.stride_tricks.as_strided(x, (n, WINDOW, *x.shape[1:]), (STRIDE * x.strides[0], *x.strides))
            s = np.matmul(t["q"][u[STRIDE:]].reshape(n, STRIDE, DIM), over(t["k"][u]).transpose(0, 2, 1))
            s += t["near"]
            s += over(t["blind"][u])[:, None, :]
            np.exp(np.minimum(s, 60, out=s), out=s)
            h = np.matmul(s, over(t["v"][u]))
            h /= (s.reshape(-1, WINDOW) @ ones[WINDOW]).reshape(n, STRIDE, 1) + np.float32(1e-30)
            h += t["r"][u[STRIDE:]].reshape(n, STRIDE, HIDDEN)
            place = first[k : k + n, None] + np.arange(STRIDE)
            good = (place < last[k : k + n, None]) & (first[k : k + n, None] >= 0)
            place, h = place[good], np.maximum(h[good], 0)
            y = units[place]
            klass = self.klass[y]
            by = np.argsort(klass.astype(np.uint8), kind="stable")
            place, h, y, klass = place[by], h[by], y[by], klass[by]
            every, member, cuts = np.arange(len(y)), self.member[y], np.searchsorted(klass, np.arange(len(a0) + 1)).tolist()
            # Logits of over 60 are cut to it, which is looked for in the sums only.
            for most in (np.inf, 60):
                z = h @ a
                z += a0
                if most < np.inf:
                    np.minimum(z, most, out=z)
                picked = z[every, klass]
                with np.errstate(over="ignore"):
                    sums = np.exp(z, out=z) @ kinds
                    within, inner = np.empty(len(y), np.float32), np.empty(len(y), np.float32)
                    for c, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if lo < hi:
                            w = h[lo:hi] @ m[c]
                            w += m0[c]
                            if most < np.inf:
                                np.minimum(w, most, out=w)
                            within[lo:hi] = w[every[: hi - lo], member[lo:hi]]
                            np.matmul(np.exp(w, out=w), ones[MEMBERS], out=inner[lo:hi])
                if not len(y) or max(sums.max(), inner.max()) < np.exp(np.float32(60)):
                    break
            total = np.log(sums[:, 0])
            new[place] = np.log(sums[:, 1] + np.float32(1e-30)) - total
            lp = picked - total
            lp += within
            lp -= np.log(inner)
            out[place] = lp
        return out, new

    def gradient(self, u: np.ndarray, y: np.ndarray, good: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of windows u, whose targets y stand where good is set."""
        p, n, g = self.p, len(u), {}
        scale, ones = np.float32(1 / np.sqrt(DIM)), np.ones(WINDOW, np.float32)
        e = p["e"][u]
        eq = np.ascontiguousarray(e[:, -STRIDE:])
        q, k, v = eq @ p["q"], e @ p["k"], e @ p["v"]
        w = np.matmul(q, k.transpose(0, 2, 1))
        w *= scale
        w += p["near"] + _MASK
        w += np.where(u == self.pad, np.float32(-1e9), np.float32(0))[:, None, :]
        np.exp(np.minimum(w, 60, out=w), out=w)
        w /= (w.reshape(-1, WINDOW) @ ones).reshape(n, STRIDE, 1) + np.float32(1e-30)
        c = np.matmul(w, v)
        h = np.maximum(eq @ p["r"] + c @ p["o"] + p["b"], 0).reshape(-1, HIDDEN)
        # Targets by class, so that each class is a slice.
        klass = self.klass[y]
        by = np.argsort(klass.astype(np.uint8), kind="stable")
        at_flat, y, klass = np.flatnonzero(good.ravel())[by], y[by], klass[by]
        hg, every, part = h[at_flat], np.arange(len(y)), np.float32(1 / len(y))
        z = hg @ p["a"]
        z += p["a0"]
        np.exp(np.minimum(z, 60, out=z), out=z)
        z *= (part / (z @ np.ones(z.shape[1], np.float32)))[:, None]
        z[every, klass] -= part
        g["a"], g["a0"] = hg.T @ z, z.sum(0)
        dh = z @ p["a"].T
        g["m"], g["m0"] = np.zeros_like(p["m"]), np.zeros_like(p["m0"])
        cuts, member, blank = np.searchsorted(klass, np.arange(len(p["a0"]) + 1)).tolist(), self.member[y], np.where(self.empty, np.float32(-1e9), p["m0"])
        for kind, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo < hi:
                x = hg[lo:hi] @ p["m"][kind]
                x += blank[kind]
                np.exp(np.minimum(x, 60, out=x), out=x)
                x *= (part / (x @ np.ones(MEMBERS, np.float32)))[:, None]
                x[every[: hi - lo], member[lo:hi]] -= part
                g["m"][kind], g["m0"][kind] = hg[lo:hi].T @ x, x.sum(0)
                dh[lo:hi] += x @ p["m"][kind].T
        flat = np.zeros_like(h)
        flat[at_flat] = dh * (hg > 0)
        d = flat.reshape(n, STRIDE, HIDDEN)
        g["r"], g["o"], g["b"] = eq.reshape(-1, DIM).T @ flat, c.reshape(-1, DIM).T @ flat, flat.sum(0)
        dc = d @ p["o"].T
        dw, dv = np.matmul(dc, v.transpose(0, 2, 1)), np.matmul(w.transpose(0, 2, 1), dc)
        dw -= ((dw * w).reshape(-1, WINDOW) @ ones).reshape(n, STRIDE, 1)
        dw *= w
        g["near"] = dw.sum(0)
        dw *= scale
        dq, dk = np.matmul(dw, k), np.matmul(dw.transpose(0, 2, 1), q)
        g["q"], g["k"], g["v"] = (x.reshape(-1, DIM).T @ y_.reshape(-1, DIM) for x, y_ in ((eq, dq), (e, dk), (e, dv)))
        de = dk @ p["k"].T + dv @ p["v"].T
        de[:, -STRIDE:] += dq @ p["q"].T + d @ p["r"].T
        spots, de = u.ravel(), np.ascontiguousarray(de.reshape(-1, DIM).T)
        g["e"] = np.stack([np.bincount(spots, x, len(p["e"])) for x in de], 1)
        return g

    def train(self, parts, begin: int, expected: int, span: tuple[float, float] = (0.0, 1.0), passes: int = 1, batch: int = 768, rate: float = 8e-3, seed: int = 4) -> int:
        """Adam on every window of parts, pairs of units and their numbers by document, ``passes`` times each; the units gone through.

        expected: about as many. The pace falls to 0 with the progress of the whole training, of which this is span.
        """
        rng, step, done, p = np.random.default_rng(seed), 0, 0, self.p
        slow, fast = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for units, sizes in parts:
            rows, first = windows(units, sizes, begin, self.pad)
            last = np.repeat(np.cumsum(sizes), -(-sizes // STRIDE))
            for _ in range(passes):
                order = rng.permutation(len(rows))
                for lo in range(0, len(rows), batch):
                    pick = order[lo : lo + batch]
                    place = first[pick, None] + np.arange(STRIDE)
                    good = place < last[pick, None]
                    place = place[good]
                    g, step, done = self.gradient(rows[pick], units[place], good), step + 1, done + len(place)
                    pace = rate * min(1, step / 50) * (1 - span[0] - (span[1] - span[0]) * min(1, done / max(expected, 1)))
                    # The last windows of a chunk may be few.
                    pace *= np.sqrt(len(pick) / batch)
                    for name, x in p.items():
                        slow[name] += 0.1 * (g[name] - slow[name])
                        fast[name] += 0.01 * (g[name] ** 2 - fast[name])
                        x -= (pace * (slow[name] / (1 - 0.9**step)) / (np.sqrt(fast[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return done

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        """Takes weights() over."""
        cuts = np.cumsum([x.size for x in self.p.values()])[:-1]
        for (name, x), part in zip(list(self.p.items()), np.split(flat, cuts), strict=True):
            self.p[name] = part.reshape(x.shape).astype(np.float32)


def _order(pairs: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Units in the order of the leading direction of what follows what, so that classes hold units alike; pairs: n times the first and the second."""
    table = np.zeros((n, n), np.float32)
    table.ravel()[pairs] = number
    both = np.concatenate([table, table.T], 1) ** 0.5
    both /= np.linalg.norm(both, axis=1, keepdims=True) + 1e-6
    x = np.random.default_rng(1).normal(size=(n, 2)).astype(np.float32)
    for _ in range(30):
        x = np.linalg.qr(both @ (both.T @ x))[0]
    return np.argsort(x[:, 1], kind="stable")


@dataclass
class Model:
    spelling: Spelling
    net: Attention
    spelled: float
    hashes: np.ndarray
    counts: np.ndarray
    end_count: int
    total: int
    distinct: int

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_words"}

    @property
    def wide(self) -> str:
        """Numbers that hold any count."""
        return "<u4" if self.total < 1 << 32 else "<i8"

    def words(self) -> Words:
        """One table a process: its tasks share the model that has been sent to it."""
        if not hasattr(self, "_words"):
            self._words = Words(self.spelling, self.hashes, self.counts)
        return self._words


def word_units(words: Words, arr: pa.Array):
    """(entries with ends, counts, units, units by word, hashes, words by document) of a column; a document's last word is its end."""
    raw, starts, ends, per_doc = split(arr)
    hashes = at.span_hashes(raw, starts, ends)
    entry, count = words.look_up(raw, starts, ends, hashes)
    n = len(per_doc)
    size = per_doc + 1
    place = np.arange(len(entry)) + np.repeat(np.arange(n), per_doc)
    total = len(entry) + n
    full, c, h = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, at.U64)
    full[place], c[place], h[place] = entry, count, hashes
    lengths = words._count[full]
    return full, c, words._ids[at.ranges(words._at[full], lengths)].astype(np.int64), lengths, h, size


def spelled_logs(net: Attention, tables, spelling: Spelling, units, lengths, size) -> np.ndarray:
    """The natural log of each word's probability as spelled, given that a word begins: its
    units' and that the next one begins a word."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    per_doc = np.diff(upto[np.concatenate([[0], np.cumsum(size)])])
    lp, new = net.score(tables, units, per_doc, spelling.begin)
    word = np.add.reduceat(lp, upto[:-1]) if len(lengths) else np.zeros(0)
    begin = new[upto[:-1]]
    after = np.append(begin[1:], 0.0)
    after[np.cumsum(size) - 1] = 0.0
    return word - begin + after


def count_words(docs: DataFrame) -> DataFrame:
    """(h, w, c): each word of the training documents, by hash, its lower-cased bytes and its number."""

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def merged():
            every, first, back = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
            return every, np.bincount(back, np.concatenate([c for _, c, _ in held])).astype(np.int64), pa.concat_arrays([w for _, _, w in held]).take(pa.array(first))

        def emit(h, c, w):
            for k in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view(np.int64)), w[k : k + 100_000], pa.array(c[k : k + 100_000])], names=["h", "w", "c"])

        size = 0
        for batch in at.pieces(batches):
            raw, starts, ends, _ = split(batch.column(0))
            h, first, c = np.unique(at.span_hashes(raw, starts, ends), return_index=True, return_counts=True)
            length = ends[first] - starts[first]
            held.append((h, c, _blobs(raw[at.ranges(starts[first], length)], length)))
            size += len(h) + int(length.sum()) // 32
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0]) + held[0][2].nbytes // 32
                if size > 2_000_000:
                    yield from emit(*held[0])
                    held, size = [], 0
        if held:
            yield from emit(*merged())

    return docs.where(labelled.fold() != FOLD).select("text").mapInArrow(work, "h long, w binary, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of runs of values."""
    offs = np.concatenate([[0], np.cumsum(sizes)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(arr: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many by row) of a binary column."""
    if len(arr) == 0:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    arr = arr.cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].tobytes() if data is not None else b""
    return np.frombuffer(raw, dtype), np.diff(offs) // np.dtype(dtype).itemsize


def _slices(batches, column: str, limit: int = 1 << 20):
    """Slices of the batches with about ``limit`` bytes of a binary column each, one row at least."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(_values(batch.column(column), "u1")[1])])
        k = 0
        while k < batch.num_rows:
            to = max(k + 1, int(np.searchsorted(upto, upto[k] + limit, "right")) - 1)
            yield batch.slice(k, to - k)
            k = to
    at.give_back()


def _rare_ids(words: DataFrame, blank: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """(ids, numbers) that spell words (w, c)."""

    def work(batches):
        number: dict[int, int] = {}
        for batch in batches:
            for ids, c in zip(blank.ids(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                for k in set(ids):
                    number[k] = number.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.int32()), pa.array(list(number.values()), pa.int64())], names=["id", "n"])

    got = words.select("w", "c").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return got["id"].to_numpy(), got["n"].to_numpy()


def _encoded(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's units, its words' counts and how often each is in the row itself, in folders by round; -1: held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << (ROUNDS - 1)))
    turn = F.when(labelled.fold() == FOLD, -1).when(part == 0, 0).otherwise(F.floor(F.log2(part)) + 1).cast("int")
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("o"), "text", turn.alias("round"))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("row long, o long, n_tokens long, known long, base double, n_units long, units binary, counts binary, times binary, rare array<long>, rare_times array<int>, round int")])

    def work(batches):
        m = shared.value
        words, low = m.words(), np.log10(m.total + 0.5 * (m.distinct + 1))
        for batch in at.pieces(batches, limit=1 << 20):
            full, count, units, lengths, h, size = word_units(words, batch.column(3))
            last = np.cumsum(size) - 1
            count[last] = m.end_count
            sure = count > 0
            sure[last] = True
            doc = np.repeat(np.arange(len(size)), size)
            same = h ^ at.mix(doc.astype(at.U64) + at.U64(1))
            _, back, times = np.unique(same, return_inverse=True, return_counts=True)
            times = times[back]
            times[last] = 1
            odd = ~sure
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[odd], minlength=len(size)))]).astype(np.int32))
            add = lambda x, d=doc, s=sure, n=len(size): np.bincount(d[s], x[s], n)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            per_doc = np.diff(upto[np.concatenate([[0], np.cumsum(size)])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size.astype(np.int64)), pa.array(add((count > 0).astype(float)).astype(np.int64)), pa.array(add(np.log10(count + 0.5) - low)), pa.array(per_doc.astype(np.int64)),
                 _blobs(units.astype("<u2"), per_doc), _blobs(count.astype(m.wide), size), _blobs(times.astype("<u4"), size), pa.ListArray.from_arrays(cuts, pa.array(h[odd].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times[odd].astype(np.int32))), batch.column(4)],
                names=schema.names,
            )

    path = scratch.new_path(docs.sparkSession, "units")
    keyed.mapInArrow(work, schema).write.partitionBy("round").parquet(path, compression="zstd")
    out = docs.sparkSession.read.schema(schema).parquet(path)
    out._weft_path = path
    return out


def _pairs(encoded: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n times a unit and the one after it, how often) in the training documents: n * n at most."""

    def work(batches):
        table = np.zeros(n * n, np.int64)
        for batch in _slices(batches, "units"):
            units, sizes = _values(batch.column(0), "<u2")
            if len(units) > 1:
                inner = np.ones(len(units), bool)
                inner[np.cumsum(sizes) - 1] = False
                np.add.at(table, units[:-1][inner[:-1]].astype(np.int64) * n + units[1:][inner[:-1]], 1)
        found = np.flatnonzero(table)
        for k in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 100_000]), pa.array(table[found[k : k + 100_000]])], names=["pair", "n"])

    # Few tasks, as each passes on most of the table.
    few = encoded.where("round >= 0").select("units").coalesce(encoded.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return got["pair"].to_numpy(), got["n"].to_numpy()


def _chunks(batches, most: int):
    """(units, units by document) of some ``most`` units; longer documents are cut, which takes the context from a window at each cut only."""
    held, n = [], 0
    for batch in _slices(batches, "units", 1 << 19):
        units, sizes = _values(batch.column(0), "<u2")
        whole = -(-sizes // most)
        cut = np.full(int(whole.sum()), most, np.int64)
        cut[np.cumsum(whole) - 1] = sizes - (whole - 1) * most
        at_unit = 0
        for k in np.split(cut, np.flatnonzero(np.diff(np.cumsum(cut) // most)) + 1):
            held.append((units[at_unit : at_unit + k.sum()].astype(np.int64), k))
            at_unit += int(k.sum())
            n += int(k.sum())
            if n >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _one_round(rows: DataFrame, net: Attention, begin: int, total: int, span: tuple[float, float], passes: int, most: int, tasks: int) -> None:
    """Goes through the documents of rows (o, units) in tasks and gives the net the mean of what they end with, by their units."""
    def work(batches):
        task = TaskContext.get().partitionId()
        done = net.train(_chunks(batches, most), begin, total * passes // tasks, span, passes, seed=4 + task)
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([done], pa.int64()), _blobs(net.weights(), np.array([len(net.weights())]))], names=["task", "n", "w"])

    def mean(batches):
        n, held = 0, np.zeros(len(net.weights()))
        for batch in batches:
            for k in range(batch.num_rows):
                by = batch.column(1)[k].as_py()
                n, held = n + by, held + by * np.frombuffer(batch.column(2)[k].as_py(), np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64()), _blobs((held / max(n, 1)).astype(np.float32), np.array([len(held)]))], names=["task", "n", "w"])

    # Dealt and sorted by what rows hold, so that a task that runs again ends with the same.
    ends = rows.select("o", "units").repartition(tasks, "o").sortWithinPartitions("o").select("units").mapInArrow(work, "task int, n long, w binary")
    if tasks > 16:
        ends = ends.repartition(16, "task").sortWithinPartitions("task").mapInArrow(mean, "task int, n long, w binary")
    got = ends.collect()
    n = sum(r.n for r in got)
    if n:
        net.put(sum(r.n / n * np.frombuffer(r.w, np.float32).astype(float) for r in got))


def _train(encoded: DataFrame, net: Attention, begin: int) -> None:
    """All rounds; where there are few units, one round and task that goes over all of them several times."""
    totals = {r["round"]: r.n for r in encoded.where("round >= 0").groupBy("round").agg(F.sum("n_units").alias("n")).collect()}
    whole, done = sum(totals.values()), 0
    if whole <= LEAST:
        return _one_round(encoded.where("round >= 0"), net, begin, whole, (0.0, 1.0), min(PASSES, -(-LEAST // whole)), LEAST, 1) if whole else None
    for turn in sorted(totals):
        n = totals[turn]
        _one_round(encoded.where(F.col("round") == turn), net, begin, n, (done / whole, (done + n) / whole), 1, CHUNK, -(-n // TASK))
        done += n


def _scored(encoded: DataFrame, model: Model) -> DataFrame:
    """Per row its words' spelled logs: of frequent words and ends beside their counts, of rarer words beside their hashes."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", "row", "round", "n_tokens", "known", "base", "rare", "rare_times"]
    schema = StructType([*(encoded.schema[c] for c in kept), *StructType.fromDDL("logs binary, counts binary, times binary, spelled array<float>")])

    def work(batches):
        m = shared.value
        tables = m.net.tables()
        for batch in _slices(batches, "units"):
            units, per_doc = _values(batch.column("units"), "<u2")
            count, size = _values(batch.column("counts"), m.wide)
            times, _ = _values(batch.column("times"), "<u4")
            # A word's first unit begins with a blank, an end is one unit.
            first = np.flatnonzero(m.spelling.initial[units])
            log = spelled_logs(m.net, tables, m.spelling, units.astype(np.int64), np.diff(np.append(first, len(units))), size)
            sure = count > 0
            sure[np.cumsum(size) - 1] = True
            doc = np.repeat(np.arange(len(size)), size)
            n, odd = np.bincount(doc[sure], minlength=len(size)), np.bincount(doc[~sure], minlength=len(size))
            cuts = pa.array(np.concatenate([[0], np.cumsum(odd)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _blobs(log[sure].astype("<f4"), n), _blobs(count[sure], n), _blobs(times[sure], n), pa.ListArray.from_arrays(cuts, pa.array(log[~sure].astype(np.float32)))], names=schema.names)

    return encoded.select(*kept, "units", "counts", "times").mapInArrow(work, schema)


def _share(rows: DataFrame, rare: DataFrame, model: Model) -> float:
    """The mixture's share by expectation-maximisation over all words of the training documents, on counts that leave out their own document."""
    total, wide, most = float(max(model.total, 1)), model.wide, 40 * BINS

    def work(batches):
        number = np.zeros(2 * most + 1, np.int64)
        for batch in _slices(batches, "logs"):
            log, (count, _), (times, _) = _values(batch.column(0), "<f4")[0].astype(float), _values(batch.column(1), wide), _values(batch.column(2), "<u4")
            left = count.astype(np.int64) - times.astype(np.int64)
            ratio = np.where(left > 0, log + np.log(total) - np.log(np.maximum(left, 1)), 40.0)
            number += np.bincount(np.clip(np.floor(ratio * BINS), -most, most).astype(np.int64) + most, minlength=2 * most + 1)
        found = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(found - most), pa.array(number[found])], names=["bin", "n"])

    left = F.coalesce("c", F.lit(0)) - F.col("times")
    ratio = F.when(left > 0, F.col("spelled").cast("double") + F.log(F.lit(total)) - F.log(left)).otherwise(F.lit(40.0))
    odd = rare.where("round >= 0").select(F.least(F.greatest(F.floor(ratio * BINS), F.lit(-most)), F.lit(most)).cast("long").alias("bin"), F.lit(1).cast("long").alias("n"))
    bins = rows.where("round >= 0").select("logs", "counts", "times").mapInArrow(work, "bin long, n long").unionByName(odd).groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    ratio, n, share = np.exp((bins["bin"].to_numpy() + 0.5) / BINS), bins["n"].to_numpy(), 0.5
    if not len(n):
        return share
    for _ in range(40):
        share = float(np.average(share * ratio / (share * ratio + 1 - share), weights=n))
    return min(0.98, max(0.02, share))


def learnt(docs: DataFrame, counts: DataFrame, tokenizer: str, ranks: str, most: int | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """(model, scored rows, their rarer words), learnt from all training documents of docs.

    counts: of all training documents. most: characters that are taken of a
    text, from a place drawn by the id's hash; None takes all of it.
    """
    docs, words = docs.select("doc_id", "text"), counts
    if most is not None:
        size, drawn = F.length("text"), F.xxhash64("doc_id", F.lit(6))
        docs = docs.withColumn("text", F.when(size > most, F.substr("text", (F.pmod(drawn, F.greatest(size - most + 1, F.lit(1))) + 1).cast("int"), F.lit(most))).otherwise(F.col("text")))
        words = scratch.store(count_words(docs), "word-counts")
    n_docs = docs.where(labelled.fold() != FOLD).count()
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (total or 0) + n_docs, distinct + (n_docs > 0)
    level = F.floor(F.log2("c") * 8)

    def frequent(words: DataFrame) -> int | None:
        """The least level of words of which there are no more than FREQUENT."""
        least, held = None, 0
        for at_level, n in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
            if held + n > FREQUENT:
                break
            least, held = at_level, held + n
        return least

    # At most FREQUENT words: their number has just been counted.
    least = frequent(words)
    few = words.where(level >= least).select("h", "w", "c").toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "w": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    # Rarer words are spelt where they are.
    more = _rare_ids(words.where(level < least) if least is not None else words, Spelling(tokenizer, ranks, np.zeros(0, np.int64), np.zeros(1, bool)))
    spelling = choose_units(dict(zip(few["w"].to_pylist(), few["c"].to_pylist(), strict=True)), tokenizer, ranks, UNITS, more)
    if most is not None:
        least = frequent(counts)
        few = counts.where(level >= least).select("h", "w", "c").toArrow() if least is not None else few.slice(0, 0)
    hashes = few["h"].to_numpy().view(at.U64)
    by = np.argsort(hashes)
    model = Model(spelling, None, 0.5, hashes[by], few["c"].to_numpy()[by], n_docs, int(total), int(distinct))
    del few
    encoded = _encoded(docs, model)
    end = len(spelling.initial)
    net = Attention(spelling, _order(*_pairs(encoded, end), end))
    _train(encoded, net, spelling.begin)
    model = replace(model, net=net)
    rows = scratch.store(_scored(encoded, model), "scored", "zstd")
    scratch.drop(encoded)
    rare = rows.select("row", "round", F.explode(F.arrays_zip("rare", "spelled", "rare_times")).alias("x")).select("row", "round", F.col("x.rare").alias("h"), "x.spelled", F.col("x.rare_times").alias("times"))
    rare = scratch.store(rare.join(counts.select("h", "c"), "h", "left").drop("h"), "rare-words", "zstd")
    return replace(model, spelled=_share(rows, rare, model)), rows, rare


def fit(docs: DataFrame, counts: DataFrame, tokenizer: str, ranks: str, most: int | None = None) -> Model:
    """The model of learnt()."""
    return learnt(docs, counts, tokenizer, ranks, most)[0]


def scores(docs: DataFrame, tokenizer: str, ranks: str) -> DataFrame:
    """Each document's log10 probability by the model, and by the unigram base.

    Reads ``doc_id`` and ``text``; null text is empty and has an end only; rows
    without a doc_id belong to the training documents; repeated rows count each
    in training and are scored each.
    """
    counts = scratch.store(count_words(docs.select("doc_id", "text")), "word-counts")
    model, rows, rare = learnt(docs, counts, tokenizer, ranks)
    share, total, wide = model.spelled, float(max(model.total, 1)), model.wide
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("row long, n_tokens long, known long, base double, score double")])

    def work(batches):
        for batch in _slices(batches, "logs"):
            (log, size), (count, _) = _values(batch.column(5), "<f4"), _values(batch.column(6), wide)
            mixed = np.log10(np.maximum(share * np.exp(log.astype(float)) + (1 - share) * count / total, 1e-300))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.bincount(np.repeat(np.arange(len(size)), size), mixed, len(size)))], names=schema.names)

    sure = rows.select("doc_id", "row", "n_tokens", "known", "base", "logs", "counts").mapInArrow(work, schema)
    c, low = F.coalesce("c", F.lit(0)), float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    mixed = F.log10(F.greatest(share * F.exp(F.col("spelled").cast("double")) + (1 - share) * c / total, F.lit(1e-300)))
    rare = rare.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(c + 0.5) - low).alias("more_base"), F.sum(mixed).alias("more_score"))
    rest = lambda x: F.coalesce(x, F.lit(0))
    both = sure.join(rare, "row", "left")
    return both.select("doc_id", (labelled.fold() == FOLD).alias("held_out"), "n_tokens", (F.col("known") + rest("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + rest("more_base")).alias("base_score"), (F.col("score") + rest("more_score")).alias("score"))
