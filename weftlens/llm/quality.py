"""Quality by co-training.

Two classifiers look at a document from different sides: one at its text
(characters, neighbouring character classes, words), one at the page around it
(language, source, size and line layout). Each round both label the documents
of an unlabelled pool, and what one is sure of becomes training data for the
other. At the end each view is calibrated on documents that neither has
learned from, the calibrated log-odds are combined, and all documents are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import labelled

#: Classes of bytes: lower, upper, digit, blank, line end, other ASCII, rest of UTF-8.
KINDS = 7
_BYTE_KIND = np.full(256, 5, np.int64)
_BYTE_KIND[128:] = 6
_BYTE_KIND[97:123], _BYTE_KIND[65:91], _BYTE_KIND[48:58] = 0, 1, 2
_BYTE_KIND[[9, 11, 12, 13, 32]], _BYTE_KIND[10] = 3, 4
N_TEXT = KINDS * KINDS + 6
N_SOURCES, N_LANGS = 32, 16
N_PAGE = 8 + N_SOURCES + N_LANGS


def _spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number by document) of runs of True; runs end with their document."""
    border = np.zeros(len(inside) + 1, bool)
    border[offs] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def _distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct spans, spans equal to the one before) by document."""
    h = at.span_hashes(raw, starts, ends)
    _, where = np.unique(h ^ at.mix(doc.astype(at.U64) + at.U64(1)), return_index=True)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[where], minlength=n), np.bincount(doc[1:][again], minlength=n)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text view, page view) of rows with text, lang, source, n_chars; nulls count as empty or 0."""
    column = {f: batch.column(batch.schema.get_field_index(f)) for f in ("text", "lang", "source", "n_chars")}
    raw, offs = at.buffers(column["text"])
    n, size = batch.num_rows, np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    kind = _BYTE_KIND[raw]
    pairs = np.bincount((doc[1:] * KINDS + kind[:-1])[(same := doc[1:] == doc[:-1])] * KINDS + kind[1:][same], minlength=n * KINDS * KINDS).reshape(n, -1)
    text = np.zeros((n, N_TEXT))
    text[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
    starts, ends, words = _spans((kind != 3) & (kind != 4), offs)
    owner = np.repeat(np.arange(n), words)
    kinds, again = _distinct(raw, starts, ends, owner, n)
    some = np.maximum(words, 1)
    length = np.bincount(owner, ends - starts, n)
    text[:, KINDS * KINDS :] = np.stack([kinds / some, np.sqrt(kinds) / some**0.5, again / some, length / some / 10, np.sqrt(np.bincount(owner, (ends - starts) ** 2, n) / some) / 10, np.log1p(words) / 10], 1)

    page = np.zeros((n, N_PAGE))
    l_starts, l_ends, lines = _spans(kind != 4, offs)
    l_owner = np.repeat(np.arange(n), lines)
    l_kinds, l_again = _distinct(raw, l_starts, l_ends, l_owner, n)
    l_some = np.maximum(lines, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, l_owner, l_ends - l_starts)
    chars = np.nan_to_num(np.array([x.as_py() or 0 for x in column["n_chars"]], np.float64))
    marks = np.bincount(doc, (kind == 5) | (kind == 1), n)
    packed = kinds / some  # how far the page would shrink
    page[:, :8] = np.stack([np.log1p(np.maximum(chars, 0)) / 10, np.log1p(lines) / 10, l_kinds / l_some, l_again / l_some, np.log1p(longest) / 10, words / l_some / 20, marks / np.maximum(size, 1), packed], 1)
    for at_, width, values in ((8, N_SOURCES, column["source"]), (8 + N_SOURCES, N_LANGS, column["lang"])):
        slot = np.array([zlib.crc32(str(x.as_py()).encode()) % width if x.is_valid else 0 for x in values], np.int64)
        page[np.arange(n), at_ + slot] = 0.3
    return text, page


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Ridge logistic regression by Newton steps. One class only gives a constant."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class Model:
    """views: the text's and the page's classifier; combine: (slope, slope, bias) of their logits."""

    views: tuple[Logistic, Logistic]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combine: np.ndarray

    def __call__(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [v.logit(x) * a + b for v, x, (a, b) in zip(self.views, (text, page), self.calibration, strict=True)]
        both = logits[0] * self.combine[0] + logits[1] * self.combine[1] + self.combine[2]
        return tuple(1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (*logits, both))


def cotrain(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = 5, each: int = 200, sure: float = 0.95) -> Model:
    """y: 0 or 1 for labelled rows. Every fourth labelled row is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if min(np.bincount(y[held], minlength=2)) < 10:  # too few to keep any back: learn from and calibrate on all
        train = held = np.ones(len(y), bool)
    else:
        train = ~held
    views, extra = (text, page), [([], []), ([], [])]
    taken = np.zeros((2, len(pool[0])), bool)
    models: list[Logistic] = []
    for turn in range(rounds + 1):
        models = []
        for x, unlabelled, (rows, guesses) in zip(views, pool, extra, strict=True):
            xs, ys = np.concatenate([x[train], unlabelled[np.array(rows, np.int64)]]), np.concatenate([y[train], guesses])
            models.append(logistic(xs, ys))
        if turn == rounds or not len(pool[0]):
            break
        for giver in (0, 1):
            logit = models[giver].logit(pool[giver])
            bound = np.log(sure / (1 - sure))
            free = ~taken[1 - giver]
            share = y[train].mean()
            for guess, order, part in ((1, np.argsort(-logit), share), (0, np.argsort(logit), 1 - share)):
                good = order[(free & ((logit > bound) if guess else (logit < -bound)))[order]][: max(1, int(each * part))]
                taken[1 - giver, good] = True
                extra[1 - giver][0].extend(good.tolist())
                extra[1 - giver][1].extend([guess] * len(good))
    calibration, calibrated = [], []
    for model, x in zip(models, views, strict=True):
        z = model.logit(x[held])
        fit = logistic(z[:, None], y[held], ridge=0.05)
        a = float(fit.weights[0] / fit.scale[0])
        b = float(fit.bias - a * fit.mean[0])
        calibration.append((a, b))
        calibrated.append(z * a + b)
    both = logistic(np.stack(calibrated, 1), y[held], ridge=0.05)
    slopes = both.weights / both.scale
    return Model(tuple(models), tuple(calibration), np.array([*slopes, both.bias - slopes @ both.mean]))


COLUMNS = ["text", "lang", "source", "n_chars"]


def _vectors(rows: DataFrame) -> DataFrame:
    """Both views' features of rows, made by the tasks that hold the texts."""

    def work(batches):
        for batch in at.pieces(batches):
            text, page = features(batch)
            yield pa.RecordBatch.from_arrays([pa.array(list(text)), pa.array(list(page)), batch.column(batch.schema.get_field_index("_label"))], names=["text_view", "page_view", "label"])

    return rows.select(*COLUMNS, F.col("_label").cast("int")).mapInArrow(work, "text_view array<double>, page_view array<double>, label int")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, pool: int = 4000, most_bytes: int = 1 << 20) -> Model | None:
    """A model from at most ``per_class`` labelled documents of each class outside the
    held-out fold and ``pool`` unlabelled ones; None without labels of both classes, as in an empty table."""
    known = labelled.sample(docs, labels, "quality", per_class, COLUMNS[1:], most_bytes)
    ids = labels.where(F.col("quality").isNotNull()).select("doc_id").distinct()
    free = docs.where(F.col("doc_id").isNotNull()).select("doc_id").join(ids, "doc_id", "left_anti").distinct()
    chosen = free.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(pool)
    # At most ``pool`` ids, whatever the tables' sizes.
    unlabelled = docs.select("doc_id", *COLUMNS).join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    rows = _vectors(known).unionByName(_vectors(unlabelled.dropDuplicates(["doc_id"]).withColumn("_label", F.lit(None).cast("int")))).toArrow()
    y = rows["label"].fill_null(-1).to_numpy().astype(np.int64)
    views = [rows[name].combine_chunks().flatten().to_numpy().reshape(len(y), n) for name, n in (("text_view", N_TEXT), ("page_view", N_PAGE))]
    order = np.lexsort((views[0][:, 0] if len(y) else y, y))  # the same order on any cluster
    y, views = y[order], [v[order] for v in views]
    has = y >= 0
    if len(set(y[has].tolist())) < 2:
        return None
    mixed = np.random.default_rng(5).permutation(int(has.sum()))
    return cotrain(views[0][has][mixed], views[1][has][mixed], y[has][mixed], (views[0][~has], views[1][~has]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns with text_score, page_score, score and good (1 if score >= 0.5) added.

    Without a model every document is good, with scores of 0.5. Null text,
    lang, source and n_chars count as empty or 0; added columns replace
    columns of the same names; repeated rows get equal scores.
    """
    names = ["text_score", "page_score", "score", "good"]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema, *StructType.fromDDL("text_score double, page_score double, score double, good int")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in at.pieces(batches):
            if shared.value is None:
                scores = [np.full(batch.num_rows, 0.5)] * 3
            else:
                scores = shared.value(*features(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores), pa.array((scores[2] >= 0.5).astype(np.int32))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(work, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The views' scores and the combined one for each document; held_out: its label was not learned from."""
    scored = score(docs.select("doc_id", *COLUMNS), fit(docs, labels))
    return scored.select("doc_id", (labelled.fold() == 0).alias("held_out"), "text_score", "page_score", "score", "good")
