"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself; a document's is the mean over its bag of words. Embeddings and softmax
are trained jointly, on a bounded sample, so a misspelling that was never seen
still shares most of its n-grams with words that were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import labelled, scratch
from weftlens.llm.words import split

DIM = 8
GRAMS = (3, 4, 5)
SCALE = 20.0
#: A document's mean is taken as if it had so many more words, with vectors of 0.
EXTRA_WORDS = 20


def bags(hashes: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a word, its document, its weight in the document's mean) for each distinct word of each document.

    A word counts with the square root of its number, so that one word
    repeated over and over does not drown all others.
    """
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    _, where, count = np.unique(hashes ^ at.mix(doc.astype(at.U64) + at.U64(1)), return_index=True, return_counts=True)
    doc, weight = doc[where], np.sqrt(count)
    return where, doc, weight / (np.bincount(doc, weight, len(per_doc)) + EXTRA_WORDS)[doc]


def subwords(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count by word) of each word's n-grams, with marks at its ends, and the word itself."""
    size = ends - starts + 2
    cuts = np.cumsum(size)
    flat = np.zeros(int(size.sum()), np.uint32)
    first = cuts - size
    flat[first], flat[cuts - 1] = 60, 62
    flat[at.ranges(first + 1, size - 2)] = cp[at.ranges(starts, size - 2)]
    lists = [(first, cuts, np.ones(len(size), np.int64))]
    for n in GRAMS:
        count = np.maximum(0, size - n + 1)
        s = at.ranges(first, count)
        lists.append((s, s + n, count))
    total = sum(x[2] for x in lists)
    out = np.empty(int(total.sum()), np.uint32)
    where = np.cumsum(total) - total
    for s, e, count in lists:
        out[at.ranges(where, count)] = at.span_hashes(flat, s, e) >> at.U64(32)
        where = where + count
    return out, total


def _means(values: np.ndarray, kept: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group the sum of its next ``kept`` rows, divided by ``counts``; 0 for an empty group."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = kept > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(kept) - kept)[some], axis=0) / counts[some][:, None].astype(values.dtype)
    return out


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, values.shape[1]), values.dtype)
    for d in range(values.shape[1]):
        out[:, d] = np.bincount(group, values[:, d], n)
    return out


@dataclass
class Model:
    """logits: what the vector of each n-gram adds to the difference of the two softmax logits.

    grams: the n-grams' hashes, ascending. An n-gram not among them adds 0.
    """

    grams: np.ndarray
    logits: np.ndarray
    bias: float
    prior: float

    def word_logits(self, cp, starts, ends) -> np.ndarray:
        hashes, counts = subwords(cp, starts, ends)
        return _means(np.append(self.logits, 0)[find(self.grams, hashes)][:, None], counts, counts)[:, 0]


def find(grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash among grams; len(grams) where it is not there."""
    if not len(grams):
        return np.zeros(len(hashes), np.int64)
    k = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    return np.where(grams[k] == hashes, k, len(grams))


def _count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams of texts, number of texts that have each)."""
    cp, starts, ends, hashes, per_doc = split(texts)
    place, doc, _ = bags(hashes, per_doc)
    _, where, word = np.unique(hashes[place], return_index=True, return_inverse=True)
    where = place[where]
    found, counts = subwords(cp, starts[where], ends[where])
    owner = np.repeat(doc, counts[word])
    found = found[at.ranges((np.cumsum(counts) - counts)[word], counts[word])]
    _, one = np.unique(at.mix(found.astype(at.U64) + (owner.astype(at.U64) << at.U64(32))), return_index=True)
    return np.unique(found[one], return_counts=True)


#: What a step of training needs of its documents: the places of its words' known n-grams, how many each word has
#: of these and of all, and for each word of each document the word, the document, its weight; the labels.
FIELDS = {"found": np.int32, "kept": np.int32, "counts": np.int32, "word": np.int32, "doc": np.int32, "weight": np.float32, "y": np.int64}


def prepared(texts: pa.Array, y: np.ndarray, grams: np.ndarray) -> dict[str, np.ndarray]:
    """FIELDS of some documents. Words without a known n-gram add nothing and are left out."""
    cp, starts, ends, hashes, per_doc = split(texts)
    place, doc, weight = bags(hashes, per_doc)
    _, where, word = np.unique(hashes[place], return_index=True, return_inverse=True)
    where = place[where]
    found, counts = subwords(cp, starts[where], ends[where])
    found = find(grams, found)
    known = found < len(grams)
    kept = np.bincount(np.repeat(np.arange(len(counts)), counts)[known], minlength=len(counts))
    some = kept > 0
    new, mine = np.cumsum(some) - 1, some[word]
    got = {"found": found[known], "kept": kept[some], "counts": counts[some], "word": new[word[mine]], "doc": doc[mine], "weight": weight[mine], "y": y}
    return {name: got[name].astype(kind) for name, kind in FIELDS.items()}


def learn(batches: list[dict[str, np.ndarray]], grams: np.ndarray, prior: float, steps: int = 190, rate: float = 0.1, floor: float = 0.01, decay: float = 0.2, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adam. Without both classes the model is the prior."""
    toxic = np.concatenate([b["y"] for b in batches]) if batches else np.zeros(0, np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, prior)
    rng = np.random.default_rng(seed)
    epochs = -(-steps // len(batches))
    class_weight = np.minimum(4, len(toxic) / (2 * np.bincount(toxic, minlength=2)))
    size = len(grams)
    params = [rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((size, DIM), (DIM, 2), 1)]
    params[2] = np.zeros(2, np.float32)
    slow, fast, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            found, kept, counts, word, doc, weight, y = (batches[k][name] for name in FIELDS)
            e, w, bias = params
            words = _means(e[found], kept, counts)
            docs = np.float32(SCALE) * _sums(words[word] * weight[:, None], doc, len(y))
            logits = docs @ w + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (class_weight[y] / len(y)).astype(np.float32)[:, None]
            back = (np.float32(SCALE) * p @ w.T)[doc] * weight[:, None]
            per_word = _sums(back, word, len(counts)) / counts[:, None].astype(np.float32)
            grads = [_sums(np.repeat(per_word, kept, axis=0), found, size), docs.T @ p, p.sum(0)]
            step += 1
            pace = np.float32(rate * (1 - (step - 1) / (epochs * len(batches))))
            for j, (x, g, m, v) in enumerate(zip(params, grads, slow, fast, strict=True)):
                m += np.float32(0.1) * (g - m)
                g *= g
                v += np.float32(0.01) * (g - v)
                root = np.sqrt(v / np.float32(1 - 0.99**step))
                # N-grams met once or twice must not move as far as telling ones, so the floor is a share of the largest.
                if j == 0:
                    x *= np.float32(1 - decay * pace)
                root += np.float32(floor) * root.max(initial=np.float32(1e-12))
                x -= (pace / np.float32(1 - 0.9**step)) * m / root
    e, w, bias = params
    return Model(grams, SCALE * (e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(bias[1] - bias[0]), prior)


class Scorer:
    """Scores columns; the logits of words met before are kept by hash, in a table of fixed size."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(1 << 19, at.U64), np.zeros(1 << 19, np.float32)

    def __call__(self, arr: pa.Array) -> np.ndarray:
        if not len(self.model.grams):
            return np.full(len(arr), self.model.prior)
        cp, starts, ends, hashes, per_doc = split(arr)
        place, doc, weight = bags(hashes, per_doc)
        starts, ends, hashes = starts[place], ends[place], hashes[place]
        slots = (hashes >> at.U64(45)).astype(np.int64)
        logits = self.values[slots].astype(np.float64)
        miss = np.flatnonzero(self.keys[slots] != hashes)
        if miss.size:
            _, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            new = self.model.word_logits(cp, starts[where], ends[where])
            logits[miss] = new[back]
            self.keys[slots[where]], self.values[slots[where]] = hashes[where], new
            # Two new words may share a slot: the last key and the last value are of the same word.
        mean = np.bincount(doc, logits * weight, len(per_doc)) + self.model.bias
        score = 1 / (1 + np.exp(-np.clip(mean, -50, 50)))
        return np.where(per_doc > 0, score, self.model.prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_bytes: int = 200_000, batch: int = 128) -> Model:
    """A model from at most ``per_class`` documents of each class outside the held-out fold, of at most ``most_bytes`` bytes.

    Tasks count the sample's n-grams and turn its texts into FIELDS with the
    n-grams that enough documents have; the driver sees these arrays, one for
    each step's batch, and never a text. An empty table, or labels of one class
    only, give the prior.
    """
    share = labels.where(F.col("doc_id").isNotNull() & (labelled.fold() != 0) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    few = scratch.store(labelled.sample(docs, labels, "toxic", per_class, [], most_bytes), "toxic-sample")
    n = few.count()
    batch = min(batch, max(16, n // 12))

    def count(batches):
        for piece in at.pieces(batches, limit=1 << 20):
            grams, number = _count(piece.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(number.astype(np.int64))], names=["gram", "n"])

    # A kept n-gram is in that many of the sample's documents, so their number is bounded as the sample is.
    known = few.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, n // 200)).select("gram")
    grams = np.sort(known.toArrow()["gram"].to_numpy()).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def prepare(batches):
        def emit(table: pa.Table):
            got = prepared(table["text"].combine_chunks(), table["_label"].to_numpy().astype(np.int64), shared.value)
            return pa.RecordBatch.from_arrays([pa.array([table["b"][0].as_py()], pa.int64()), *(pa.array([got[name].tobytes()], pa.binary()) for name in FIELDS)], names=["b", *FIELDS])

        held: list[pa.RecordBatch] = []
        for piece in batches:
            b = piece.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != b[s]:
                    yield emit(pa.Table.from_batches(held))
                    held = []
                held.append(piece.slice(s, e - s))
        if held:
            yield emit(pa.Table.from_batches(held))

    dealt = few.select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(1, n // batch))).alias("b"), "doc_id", "text", "_label")
    dealt = dealt.repartition("b").sortWithinPartitions("b", F.xxhash64("doc_id")).select("b", "text", "_label")
    rows = dealt.mapInArrow(prepare, "b long, " + ", ".join(f"{name} binary" for name in FIELDS)).toArrow().sort_by("b")
    steps = [{name: np.frombuffer(rows[name][k].as_buffer(), kind) for name, kind in FIELDS.items()} for k in range(rows.num_rows)]
    scratch.drop(few)
    return learn(steps, grams, float(share or 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with ``score`` and ``predicted`` added (replaced if there).

    Null and blank texts have no words and get the prior, the share of toxic
    labels, as all texts do where training had no labels of both classes;
    repeated rows get equal scores.
    """
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema, *StructType.fromDDL("score double, predicted int")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in at.pieces(batches):
            p = scorer(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(work, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A score for each document, and whether its label was held out from training."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (labelled.fold() == 0).alias("held_out"), "score", "predicted")
