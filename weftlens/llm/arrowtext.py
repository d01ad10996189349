"""Numpy views of Arrow string columns, for use inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Of the GNU C library; other systems' return pages by themselves.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A prime modulus beside 2**64: what differs in one of the two hashes differs in the whole.
_PRIME = U64((1 << 31) - 1)
_GENERATOR = 16807
_powers = [np.ones(1, U64) for _ in range(4)]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62; the prime itself may stand for 0."""
    x = (x & _PRIME) + (x >> U64(31))
    return (x & _PRIME) + (x >> U64(31))


def powers(n: int) -> list[np.ndarray]:
    """B**i and B**-i modulo 2**64, G**i and G**-i modulo the prime, for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
        for k, b in enumerate((_GENERATOR, pow(_GENERATOR, -1, int(_PRIME)))):
            p, done = np.ones(size, U64), 1
            while done < size:
                by = U64(pow(b, done, int(_PRIME)))
                p[done : 2 * done] = _reduced(p[:done][: size - done] * by)
                done *= 2
            _powers[2 + k] = p
    return [p[:n] for p in _powers]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    arr = pc.fill_null(arr, "")
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches, limit: int = 1 << 19, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """The worker lives on after the task; what Arrow has pooled and what the C library has kept of freed memory is given back before the next one."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[starts:ends], by prefix sums of two polynomials.

    A polynomial modulo 2**64 alone is the same for some regular texts (the
    Thue-Morse word and its complement), so one modulo a prime is mixed in.
    """
    up, down, prime_up, prime_down = powers(len(values) + 1)
    # One array for each polynomial's terms, changed in place: these are a task's largest arrays.
    wide = values.astype(U64)
    wide += U64(0x51ED27)
    terms, h = wide * U64(0xD6E8FEB86659FD93), np.zeros(len(values) + 1, U64)
    terms *= up[: len(values)]
    np.cumsum(terms, out=h[1:])
    out = (h[ends] - h[starts]) * down[starts]
    out += (ends - starts).astype(U64) * U64(0xA24BAED4963EE407)
    wide *= prime_up[: len(values)]
    for _ in range(2):
        np.right_shift(wide, U64(31), out=terms)
        wide &= _PRIME
        wide += terms
    np.cumsum(wide, out=h[1:])
    rest = _reduced(_reduced(h[ends] - h[starts]) * prime_down[starts])
    rest[rest >= _PRIME] -= _PRIME
    out += mix(rest)
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each pair."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return out + np.repeat(starts.astype(np.int64) - before, lengths)
