"""Near-duplicates by BagMinHash over multisets of word shingles.

A signature component is the first arrival of a Poisson process on the
weights of a document's shingles: shingle weights are cut into intervals
[0, 1), [1, 2), [2, 4), [4, 8) ..., each with a process of its own whose points
carry a place in the interval, and a document sees the points below its own
weight. Two documents agree in a component with the probability of their
weighted Jaccard similarity. Arrivals are drawn lazily, in order, until no
later one can matter.

Signatures are banded; a bucket's members are compared with its least member
first, each document with its likest one before any other, and only where a
bucket still holds several components are members of different components
compared with each other, block by block. Every candidate that could join two
components is verified by the exact overlap of its two multisets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import graphs, scratch
from weftlens.llm.words import shingles, split

BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
#: A pair of the least similarity agrees in 77 of 96 components, give or take 4; in fewer than this once in tens of millions.
AGREE = 56
BLOCK = 256
#: Members that share a drawn least one.
DRAWN = 4
#: Ids of eight bytes that may be broadcast.
BROADCAST_IDS = 4 << 20


def signatures(hashes: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signatures (n, SIZE) of 16 bits a component; rows without shingles are all 65535."""
    levels = np.zeros(len(weight), np.int64)
    levels[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    element = np.repeat(np.arange(len(weight)), levels + 1)
    level = at.ranges(np.zeros(len(weight), np.int64), levels + 1)
    seed = at.mix(hashes[element] + level.astype(at.U64) * at.U64(0xA24BAED4963EE407))
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    limit, owner = weight[element].astype(np.float64), doc[element]
    time = np.zeros(len(seed))
    first = np.full(n * SIZE, np.inf)
    turn = 0
    while len(seed):
        turn += 1
        x = at.mix(seed + at.U64((turn * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        time = time - np.log1p(-(x >> at.U64(11)).astype(np.float64) * 2.0**-53) / width
        y = at.mix(x ^ at.U64(0x5851F42D4C957F2D))
        slot = ((y >> at.U64(40)) * at.U64(SIZE) >> at.U64(24)).astype(np.int64)
        place = low + (y & at.U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width
        seen = place < limit
        np.minimum.at(first, owner[seen] * SIZE + slot[seen], time[seen])
        last = first.reshape(n, SIZE).max(1)
        on = np.flatnonzero(time < last[owner])
        seed, time, low, width, limit, owner = seed[on], time[on], low[on], width[on], limit[on], owner[on]
    out = (at.mix(first.view(at.U64)) >> at.U64(48)).astype("<u2").reshape(n, SIZE)
    out[np.isinf(first.reshape(n, SIZE))] = 65535
    return out


def _binary(matrix: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(0, len(matrix) * width + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SIZE)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, same: digest of the text, n: shingles, sig) of each document."""

    def work(batches):
        for batch in at.pieces(batches):
            texts = batch.column(1)
            raw, offs = at.buffers(texts)
            data, cuts = memoryview(raw.tobytes()), offs.tolist()
            same = [hashlib.md5(data[s:e], usedforsecurity=False).digest() for s, e in zip(cuts, cuts[1:], strict=False)]
            _, _, _, hashes, per_doc = split(texts)
            h, doc, count = shingles(hashes, per_doc, size)
            n = np.bincount(doc, count, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(n), _binary(signatures(h, doc, count, batch.num_rows))], names=["doc_id", "same", "n", "sig"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("same binary, n long, sig binary")])
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(work, schema)


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree often enough to be worth a look at the texts, and in how many components."""
    sides = [nodes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b")

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                agree = pa.array((_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1), pa.int32())
                good = pa.array(agree.to_numpy() >= AGREE)
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in (*batch.columns[:2], agree)], names=["a", "b", "agree"])

    return both.mapInArrow(work, "a long, b long, agree int")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents with the ids (one column, distinct).

    Up to BROADCAST_IDS ids, counted first, go to every task, so that no text
    is shuffled to be left out; more are joined.
    """
    name = ids.columns[0]
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").alias(name), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids) if few else ids, name, "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose multisets of shingles have a weighted Jaccard similarity of ``threshold`` or more."""
    sides = [_texts_of(docs, pairs.select(x).distinct()).withColumnRenamed("text", f"text_{x}") for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")

    def bag(column: pa.Array):
        _, _, _, hashes, per_doc = split(column)
        h, doc, count = shingles(hashes, per_doc, size)
        return h ^ at.mix(doc.astype(at.U64) + at.U64(1)), doc, count

    def work(batches):
        for batch in at.pieces(batches, limit=1 << 20, column="text_a"):
            n = batch.num_rows
            (ha, da, ca), (hb, db, cb) = bag(batch.column(2)), bag(batch.column(3))
            _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
            common = np.bincount(da[ia], np.minimum(ca[ia], cb[ib]), n)
            total = np.bincount(da, ca, n) + np.bincount(db, cb, n) - common
            good = (total > 0) & (common >= threshold * total - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(work, pairs.select("a", "b").schema)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) between different components."""
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b), as many as members at most for each star: every member of a bucket with its
    least member, and in larger buckets with the least of a few members drawn by hash, twice."""
    hub = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    large = members.where(F.col("n") > DRAWN)
    part = lambda turn: F.pmod(F.xxhash64("rep", "band", F.lit(turn)), F.ceil(F.col("n") / DRAWN)).alias("part")
    large = large.select("rep", "band", "key", F.lit(0).alias("turn"), part(0)).unionByName(large.select("rep", "band", "key", F.lit(1).alias("turn"), part(1)))
    group = ["band", "key", "turn", "part"]
    drawn = large.join(large.groupBy(*group).agg(F.min("rep").alias("b")), group).where("rep <> b").select(F.col("rep").alias("a"), "b")
    return hub.unionByName(drawn).distinct()


def _features(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row, features by row): a shingle's n-th copy in a text is a feature, so common features count a multiset's overlap."""
    _, _, _, hashes, per_doc = split(texts)
    h, doc, count = shingles(hashes, per_doc, size)
    copy = at.ranges(np.zeros(len(count), np.int64), count)
    return at.mix(np.repeat(h, count) + copy.astype(at.U64) * at.U64(0xA24BAED4963EE407)), np.repeat(doc, count), np.bincount(doc, count, len(texts))


def _links_within(texts: pa.Array, left: np.ndarray, right: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """Which of left x right have the similarity: exact overlaps, as products of blocks of the table rows x features."""
    feature, row, total = _features(texts, size)
    _, code, times = np.unique(feature, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(code.max(initial=-1)) + 1, 8192):
        mine = (code >= k) & (code < k + 8192)
        table = np.zeros((len(texts), 8192), np.float32)
        table[row[mine], code[mine] - k] = 1
        common += table[left] @ table[right].T
    every = total[left][:, None] + total[right][None, :] - common
    return (every > 0) & (common >= threshold * every - 1e-6)


def _block_links(members: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components within a bucket, enough of them to join the components.

    In each bucket with several components, the largest one's members are
    dealt to blocks of their own, and all pairs of blocks but those within the
    largest component are compared, so neither a bucket's rows nor its pairs
    meet in one task.
    """
    key = ["band", "key"]
    known = members.where("n > 2").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    known = scratch.store(known.select(*key, "rep", F.coalesce("root", "rep").alias("root")), "members")
    sizes = known.groupBy(*key, "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy(*key).agg(F.count("*").alias("roots"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top")).where("roots > 1")
    mixed = mixed.select(*key, F.col("top.root").alias("largest"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).alias("few"), F.ceil(F.col("top.c") / BLOCK).alias("many"))
    rows = known.join(scratch.store(mixed, "mixed"), key)
    top = F.col("root") == F.col("largest")
    block = F.when(top, F.col("few") + F.pmod(F.xxhash64("rep"), F.col("many"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("few")))
    others = F.sequence(F.lit(0).cast("long"), F.when(top, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    rows = rows.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "root")
    group = [*key, "i", "j"]

    def groups(batches):
        """Tables of whole groups, in order."""
        held: list[pa.RecordBatch] = []
        mark = lambda batch, k: [batch.column(c)[k].as_py() for c in range(4)]
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            now = mark(batch, batch.num_rows - 1)
            if mark(held[0], 0) == now:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            cut = whole.num_rows - 1
            while mark(whole, cut - 1) == now:
                cut -= 1
            yield whole.slice(0, cut).combine_chunks()
            held = whole.slice(cut).to_batches()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def pairs_of(table: pa.Table):
        """(rows, left, right) of each group; left and right count within it."""
        block, i = table["block"].to_numpy(), table["i"].to_numpy()
        j, code, band = table["j"].to_numpy(), np.array(table["key"].to_pylist(), dtype=object), table["band"].to_numpy()
        new = (np.diff(band) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (code[1:] != code[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            mine = block[s:e] == i[s]
            left = np.flatnonzero(mine)
            yield s, e, left, left if i[s] == j[s] else np.flatnonzero(~mine)

    def alike(batches):
        """The rows of groups in which some pair of different components has like signatures, each pair in the first band that it shares."""
        for table in groups(batches):
            sig, root, band = _matrix(table["sig"].combine_chunks()), table["root"].to_numpy(), table["band"].to_numpy()
            keep = np.zeros(table.num_rows, bool)
            for s, e, left, right in pairs_of(table):
                for x in left.tolist():
                    equal = sig[s + right] == sig[s + x]
                    good = (root[s + right] != root[s + x]) & (equal.sum(1) >= AGREE)
                    if good.any():
                        good &= equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[s]
                    if good.any():
                        keep[s + x] = True
                        keep[s + right[good]] = True
            yield from table.drop_columns(["sig"]).filter(pa.array(keep)).combine_chunks().to_batches()

    def linked(batches):
        for table in groups(batches):
            rep, root, texts = table["rep"].to_numpy(), table["root"].to_numpy(), table["text"].combine_chunks()
            out: list[tuple[int, int]] = []
            for s, e, left, right in pairs_of(table):
                if not len(left) or not len(right):
                    continue
                good = _links_within(texts.slice(s, e - s), left, right, size, threshold)
                good &= root[s:e][left][:, None] != root[s:e][right][None, :]
                parent = {r: r for r in root[s:e].tolist()}

                def find(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for x, y in np.argwhere(good).tolist():
                    a, b = s + int(left[x]), s + int(right[y])
                    ra, rb = find(root[a]), find(root[b])
                    if ra != rb:
                        parent[ra] = rb
                        out.append((max(rep[a], rep[b]), min(rep[a], rep[b])))
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    signed = rows.join(nodes.select("rep", "sig"), "rep").select(*group, "block", "rep", "root", "sig")
    signed = signed.repartition(*group).sortWithinPartitions(*group)
    close = scratch.store(signed.mapInArrow(alike, signed.drop("sig").schema), "close")
    texts = _texts_of(docs, close.select("rep").distinct())
    whole = close.join(texts, "rep").select(*group, "block", "rep", "root", "text").repartition(*group).sortWithinPartitions(*group)
    return whole.mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, class_id): documents of a class are joined by links, each a pair
    of texts whose shingle multisets have a similarity of ``threshold`` or more.

    class_id is the least doc_id of the class. Equal texts, empty ones too, are
    in one class; null text counts as empty. Rows without a doc_id take no part
    and get a null class; repeated rows are returned each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.store(_signed(docs, size), "signed")
    same = scratch.store(signed.groupBy("same").agg(F.min("doc_id").alias("rep")), "same")
    nodes = signed.where("n > 0").join(same, (F.col("doc_id") == F.col("rep")) & (signed["same"] == same["same"])).select("rep", "sig").dropDuplicates(["rep"])
    nodes = scratch.store(nodes, "nodes")
    bands = nodes.select("rep", F.posexplode(F.array(*[F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS) for k in range(BANDS)])).alias("band", "key"))
    buckets = scratch.store(bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1"), "buckets")
    members = scratch.store(bands.join(buckets, ["band", "key"]), "bucketed")
    alike = scratch.store(_alike(_stars(members), nodes), "alike")
    likest = alike.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    links = scratch.store(_verified(scratch.store(likest, "likest"), docs, size, threshold), "links")
    roots = graphs.components(links)
    rest = scratch.store(_apart(alike, roots), "rest")
    others = scratch.store(_verified(rest, docs, size, threshold), "other-links")
    roots = scratch.store(graphs.merged(roots, others), "first-roots")
    more = scratch.store(_block_links(members, nodes, roots, docs, size, threshold), "more-links")
    roots = scratch.store(graphs.merged(roots, more), "roots")
    classes = scratch.store(same.join(roots, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("root", "rep").alias("class_id")), "classes")
    scratch.drop(members, buckets, nodes)
    found = signed.select("doc_id", "same").join(classes, "same").select("doc_id", "class_id")
    unnamed = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(unnamed)


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """docs with one document of each class: that with the least doc_id, one row of it by hash.

    Rows without a doc_id stay; columns may have any names; an empty table stays one.
    """
    kept = near_duplicates(docs, threshold, size).where("doc_id = class_id").select("doc_id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    named = rows.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("row"))
    named = named.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
