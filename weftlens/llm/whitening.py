"""Whitening of embeddings by their principal components.

Components are integers, ``floor(scale * c) + shift``, so that sums are exact.
Tasks go through their vectors once and keep the mean and the matrix of centred
products by Welford's rank-one updates; the updates of a batch, each about the
running mean that precedes and follows its vector, are one matrix product.
States merge by the parallel formula, first in tasks, then a few in the driver.
The covariance is solved by tridiagonalisation and implicit symmetric QR steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at

SCALE, SHIFT = 64, 1_000_000
#: Components are taken as whitened where their variance is more than this times dimensions times the largest.
RANK = 4e-16
#: Vectors whose scaled components reach this are not integers in doubles any more; they are clamped to it.
MOST = 1 << 52
#: Tasks that merge the states of all.
MERGERS = 16


@dataclass
class State:
    """Welford's state of one length of vectors: number, a fixed integer origin, exact sums about it, mean and products about the mean."""

    dim: int
    n: int = 0
    origin: np.ndarray = field(default=None)
    sums: list = field(default=None)
    mean: np.ndarray = field(default=None)
    products: np.ndarray = field(default=None)

    def update(self, x: np.ndarray) -> None:
        """Adds the rows of x, one rank-one update after the other.

        The update of a row is the outer product of its distances from the means
        before and after it; means follow from cumulative sums, and the sum of
        all outer products is one product of the two matrices.
        """
        if not len(x):
            return
        if self.n == 0:
            self.origin = x[0].copy()
            self.sums, self.mean, self.products = [0] * self.dim, np.zeros(self.dim), np.zeros((self.dim, self.dim))
        near = x - self.origin
        y = near.astype(np.float64)
        count = self.n + np.arange(1, len(y) + 1)[:, None]
        after = (self.n * self.mean + np.cumsum(y, 0)) / count
        before = np.concatenate([self.mean[None], after[:-1]])
        self.products += (y - before).T @ (y - after)
        self.mean, self.n = after[-1], self.n + len(y)
        self.sums = [a + b for a, b in zip(self.sums, exact_sums(near), strict=True)]

    def merge(self, other: State) -> State:
        """The state of both, by the parallel formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = (other.origin - self.origin).astype(np.float64) + other.mean - self.mean
        move = [int(o) - int(s) for o, s in zip(other.origin, self.origin, strict=True)]
        sums = [a + b + other.n * m for a, b, m in zip(self.sums, other.sums, move, strict=True)]
        products = self.products + other.products + np.outer(gap, gap) * (self.n * (other.n / n))
        return State(self.dim, n, self.origin, sums, self.mean + gap * (other.n / n), products)

    def totals(self) -> list[int]:
        """Exact sums of each component."""
        return [s + self.n * int(o) for s, o in zip(self.sums, self.origin, strict=True)]

    def pack(self) -> tuple:
        return (self.dim, self.n, self.origin.tobytes(), " ".join(map(str, self.sums)), self.mean.tobytes(), self.products.tobytes())

    @staticmethod
    def unpack(dim, n, origin, sums, mean, products) -> State:
        return State(dim, n, np.frombuffer(origin, np.int64), [int(s) for s in sums.split()], np.frombuffer(mean), np.frombuffer(products).reshape(dim, dim))


#: How states travel between tasks.
STATES = "dim int, n long, origin binary, sums string, mean binary, products binary"


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums without overflow: high and low halves are summed apart."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(h) << 26) + int(l) for h, l in zip(high.sum(0), low.sum(0), strict=True)]


def integers(column: pa.Array, scale: int = SCALE, shift: int = SHIFT):
    """(rows, integer matrix) for each length of the vectors that are not null and hold no null or non-finite entry; empty ones give nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    starts = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (bad[starts + size] == bad[starts]) & (size > 0)
    for dim in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == dim))
        x = flat[starts[rows][:, None] + np.arange(dim)]
        yield rows, np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64) + shift


def _states(held: dict[int, State]) -> pa.RecordBatch:
    columns = list(zip(*(s.pack() for s in held.values()), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=[part.split()[0] for part in STATES.split(", ")])


def _merged(states: DataFrame) -> dict[int, State]:
    """One state for each length of vectors, merged in a few tasks and then in the driver."""

    def merge(batches):
        held: dict[int, State] = {}
        for batch in batches:
            for row in batch.to_pylist():
                state = State.unpack(**row)
                held[state.dim] = held[state.dim].merge(state) if state.dim in held else state
        if held:
            yield _states(held)

    out: dict[int, State] = {}
    for row in states.repartition(MERGERS).mapInArrow(merge, STATES).collect():
        state = State.unpack(*row)
        out[state.dim] = out[state.dim].merge(state) if state.dim in out else state
    return out


def fit(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> dict[int, State]:
    """The states of all usable vectors of ``embedding``, by length."""

    def work(batches):
        held: dict[int, State] = {}
        for batch in batches:
            for _, x in integers(batch.column(0), scale, shift):
                held.setdefault(x.shape[1], State(x.shape[1])).update(x)
        if held:
            yield _states(held)

    return _merged(vectors.select("embedding").mapInArrow(work, STATES))


# The eigen-solve.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of a symmetric matrix, by falling value: implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    n = len(a)
    d, e, q = tridiagonal(a)
    turned, hi = q.T.copy(), n - 1
    while hi > 0:
        tiny = np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= tiny] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0 else (x / r, z / r)
            if k > lo:
                e[k - 1] = r
            a0, b0, g0 = d[k], e[k], d[k + 1]
            d[k] = c * c * a0 + 2 * c * s * b0 + s * s * g0
            d[k + 1] = s * s * a0 - 2 * c * s * b0 + c * c * g0
            e[k] = (c * c - s * s) * b0 + c * s * (g0 - a0)
            x = e[k]
            if k + 1 < hi:
                z = s * e[k + 1]
                e[k + 1] *= c
            turned[[k, k + 1]] = np.stack([c * turned[k] + s * turned[k + 1], c * turned[k + 1] - s * turned[k]])
    order = np.argsort(-d, kind="stable")
    return d[order], turned[order].T


@dataclass
class Whitening:
    """What whitens vectors of one length."""

    n: int
    totals: list
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    @staticmethod
    def of(state: State, most: int) -> Whitening:
        v = state.products / state.n
        v = (v + v.T) / 2
        top = np.abs(v).max()
        values, vectors = eigen(v / top) if top > 0 else (np.zeros(len(v)), np.eye(len(v)))
        keep = min(most, len(v))
        return Whitening(state.n, state.totals(), vectors[:, :keep], values[:keep] * top, float(np.trace(v)))

    def alive(self) -> np.ndarray:
        return self.values > RANK * len(self.totals) * max(self.values.max(initial=0), 0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - totals: exact integers, as objects where 64 bits could be too few."""
        reach = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.totals))
        if reach < 1 << 62:
            return self.n * x - np.array(self.totals, np.int64)
        return self.n * x.astype(object) - np.array(self.totals, object)

    def project(self, far: np.ndarray) -> np.ndarray:
        """Whitened rows, from n * x - totals; NaN on components without variance."""
        root = np.where(self.alive(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (far.astype(np.float64) / self.n) @ self.vectors / root


def deviations(far: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where one is beyond a long."""
    if far.dtype != object and int(np.abs(far).max(initial=0)) < (1 << 62) ** 0.5 / max(far.shape[1], 1) ** 0.5:
        return (far * far).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in far]
    return [v if v < 1 << 63 else None for v in exact]


def _errors(vectors: DataFrame, found: dict[int, Whitening], scale: int, shift: int) -> dict[int, float | None]:
    """The largest absolute entry of whitened's covariance minus the identity, over the components that have variance."""
    ddl = "dim int, n long, products binary"

    def rows(held: dict):
        for dim, (n, products) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([products.tobytes()], pa.binary())], names=["dim", "n", "products"])

    def work(batches):
        held: dict = {}
        for batch in batches:
            for _, x in integers(batch.column(0), scale, shift):
                w = found[x.shape[1]]
                y = w.project(w.centred(x))[:, w.alive()]  # centred already, by the exact totals
                n, products = held.get(x.shape[1], (0, 0.0))
                held[x.shape[1]] = (n + len(y), products + y.T @ y)
        yield from rows(held)

    def merged(parts):
        held: dict = {}
        for r in parts:
            n, products = held.get(r["dim"], (0, 0.0))
            held[r["dim"]] = (n + r["n"], products + np.frombuffer(r["products"]))
        return held

    states = vectors.select("embedding").mapInArrow(work, ddl).repartition(MERGERS).mapInArrow(lambda batches: rows(merged(r for b in batches for r in b.to_pylist())), ddl)
    out: dict[int, float | None] = dict.fromkeys(found)
    for dim, (n, products) in merged(states.collect()).items():
        if k := int(found[dim].alive().sum()):
            out[dim] = float(np.abs(products.reshape(k, k) / n - np.eye(k)).max())
    return out


# The operator.


def whiten(vectors: DataFrame, components: int = 32, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Reads ``vec_id`` and ``embedding``. Vectors that are null, empty, or hold
    null or non-finite entries give no row. Vectors of another length are
    whitened among themselves: n, the components and identity_error are those of
    their length. Repeated rows count and are returned each; a null vec_id stays
    null. A component without variance has null in whitened and does not count
    in identity_error; with no variance at all explained is null. A deviation
    beyond a long is null. Entries beyond 2**52 after scaling are clamped.
    Three passes over the table: sums and covariance, check of the result, rows.
    The driver holds one matrix for each length, and 16 while they are merged.
    """
    found = {dim: Whitening.of(state, components) for dim, state in fit(vectors, scale, shift).items()}
    for dim, error in _errors(vectors, found, scale, shift).items():
        found[dim].error = error
    schema = StructType([vectors.schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])

    def work(batches):
        for whole in batches:
            for batch in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                for rows, x in integers(batch.column(1), scale, shift):
                    w = found[x.shape[1]]
                    far = w.centred(x)
                    m, k = len(rows), len(w.values)
                    explained = w.values / w.trace if w.trace > 0 else np.full(k, np.nan)
                    spread = lambda a: a.take(pa.array(np.repeat(np.arange(m), k)))
                    floats = lambda a: pa.array(a, pa.float64(), from_pandas=True)
                    arrays = [
                        batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), spread(pa.array(deviations(far), pa.int64())),
                        floats(w.project(far).ravel()), floats(np.tile(explained, m)), pa.array([w.error] * (m * k), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return vectors.select("vec_id", "embedding").mapInArrow(work, schema)
