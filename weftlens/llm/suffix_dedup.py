"""Removal of repeated byte strings by suffix arrays.

Which strings of ``length`` bytes start at more than one place of the corpus?
Equal strings contain equal grams of GRAM bytes, and among these the same
least one by hash, so each start is filed under its string's least gram:
neighbouring starts with the same least gram form a run, and a run under a
gram with one place in the corpus holds no repeated string. What is left are regions
of text (a run's starts and the bytes that their strings reach), of which equal
ones are collapsed to one with its number. A shard gets all regions of its
grams, sorts their suffixes by Larsson-Sadakane refinement to the depth of
``length``, finds common prefixes as Kasai does, and counts.

A gram with very many different regions is dealt over several shards. Their
distinct strings are then merged across shards: range by range of fingerprints,
each shard's sorted run is searched for the strings of the others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at
from weftlens.llm import scratch

GRAM = 64
#: Regions of one gram in a shard.
SHARD_REGIONS = 1000
#: Bytes sorted at once; a single gram's shard may be larger where its regions are long.
SORT_BYTES = 1 << 20
#: Starts of one text that are looked at at once.
BLOCK = 8 << 20


def least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbouring values."""
    out, width = values, 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (size - width)], out[size - width :]) if size > width else out


def runs(raw: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start in the document, number of starts, gram, its number of places) of each run.

    A long text is taken in blocks of BLOCK starts, at whose borders a run ends.
    """
    if len(raw) > BLOCK + length:
        parts = []
        for d, (s, e) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
            for k in range(s, max(e - length + 1, s), BLOCK):
                block = raw[k : min(k + BLOCK + length - 1, e)]
                doc, begin, *rest = runs(block, np.array([0, len(block)]), length)
                parts.append((doc + d, begin + (k - s), *rest))
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else runs(raw[:0], offs[:1], length)
    gram = min(GRAM, length)
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, at.U64, np.int64))
    grams = np.arange(n - gram + 1)
    hashes = at.span_hashes(raw, grams, grams + gram)
    # The low bits hold the place, so the least one is also found by place, the first of equal ones.
    low = at.U64((1 << n.bit_length()) - 1)
    least = (least_in_windows((hashes & ~low) | grams.astype(at.U64), length - gram + 1) & low).astype(np.int64)
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), np.maximum(0, size - length + 1))
    starts = at.ranges(offs[:-1], np.maximum(0, size - length + 1))
    places = least[starts]
    value = hashes[places]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    moved = np.ones(len(starts), np.int64)
    moved[1:] = places[1:] != places[:-1]
    moved[first] = 1
    times = np.add.reduceat(moved, first) if len(first) else moved
    return doc[first], begin - offs[doc[first]], count, value[first], times


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): positions ordered by their next ``depth`` bytes, equal ones by place
    and with equal rank. Larsson-Sadakane: ranks for h bytes give those for 2 h, and
    only groups that are not yet single are sorted again. The text's end sorts first."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(at.U64)
    # Keys and places that fit one number are sorted as such, which is far quicker than sorting places by keys.
    bits = max(1, (n + 1).bit_length())
    packs = 3 * bits <= 64
    h = min(5 if packs else 8, depth)
    key = np.zeros(n, at.U64)
    for k in range(h):
        key = (key << at.U64(8)) | padded[k : k + n]
    low = at.U64((1 << bits) - 1)
    if packs:
        key = np.sort((key << at.U64(bits)) | np.arange(n, dtype=at.U64))
        order, ordered = (key & low).astype(np.int64), key >> at.U64(bits)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    while h < depth:
        step = min(h, depth - h)
        open_ = size > 1
        slots = at.ranges(first[open_], size[open_])
        if not len(slots):
            break
        place = order[slots]
        after = rank[place + step] + 1
        if packs:
            key = np.sort((rank[place].astype(at.U64) << at.U64(2 * bits)) | (after.astype(at.U64) << at.U64(bits)) | place.astype(at.U64))
            place, key = (key & low).astype(np.int64), key >> at.U64(bits)
        else:
            key = rank[place] * (n + 2) + after
            by = np.argsort(key, kind="stable")
            place, key = place[by], key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        order[slots] = place
        heads = np.flatnonzero(new)
        first, size = slots[heads], np.diff(np.append(heads, len(key)))
        rank[place] = np.repeat(first, size)
        h += step
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the order its common prefix with the place before, counted up to ``depth``.

    As Kasai found, moving both places on by one takes one off their common
    prefix; so only the heads of chains of such moves are compared byte by byte.
    Neighbours of different rank differ within ``depth`` and get 0.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    tied = np.flatnonzero(rank[order[1:]] == rank[order[:-1]]) + 1
    if not len(tied):
        return out
    before = np.full(n + 1, -2, np.int64)
    before[order[tied]] = order[tied - 1]
    here = np.flatnonzero(before[:n] >= 0)
    chained = np.zeros(len(here), bool)
    chained[1:] = (here[1:] == here[:-1] + 1) & (before[here[1:]] == before[here[:-1]] + 1)
    heads = np.flatnonzero(~chained)
    links = np.diff(np.append(heads, len(here)))
    a, b = here[heads], before[here[heads]]
    want = depth + links - 1
    same = np.zeros(len(heads), np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    going = np.arange(len(heads))
    while len(going):
        x, y = a[going] + same[going], b[going] + same[going]
        equal = (words[x] == words[y]).cumprod(1).sum(1)  # of the next eight bytes
        equal = np.minimum(equal, n - np.maximum(x, y))
        same[going] += equal
        going = going[(equal == 8) & (same[going] < want[going])]
    chain = np.repeat(np.arange(len(heads)), links)
    value = same[chain] - (np.arange(len(here)) - heads[chain])
    by_place = np.zeros(n, np.int64)
    by_place[here] = np.clip(value, 0, depth)
    out[tied] = by_place[order[tied]]
    return out


def repeated_starts(regions: list[bytes], starts: np.ndarray, times: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Which of the first ``starts`` places of each region begin a string that begins elsewhere too.

    Also (region, place, number) for one place of each distinct string. A
    region counts ``times`` over. Regions are set apart by byte 255, which UTF-8
    does not have.
    """
    text = np.frombuffer(b"\xff".join(regions) + b"\xff", np.uint8)
    base = np.cumsum([0] + [len(r) + 1 for r in regions[:-1]])
    order, rank = suffix_order(text, length)
    prefix = common_prefixes(text, order, rank, length)
    weight = np.zeros(len(text), np.int64)
    owner = np.repeat(np.arange(len(regions)), starts)
    place = at.ranges(base, starts)
    weight[place] = times[owner]
    group = np.cumsum(prefix < length) - 1
    total = np.bincount(group, weight[order]).astype(np.int64)
    of = np.empty(len(text), np.int64)
    of[order] = group
    number = total[of[place]]
    _, one = np.unique(of[place], return_index=True)
    cuts = np.cumsum(starts)[:-1]
    return np.split(number > 1, cuts), owner[one], (place - base[owner])[one], number[one]


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"s": int(s), "n": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _run_rows(docs: DataFrame, length: int) -> DataFrame:
    """The runs of each text; a region is known by a 128-bit digest of its bytes."""

    def work(batches):
        for batch in at.pieces(batches):
            raw, offs = at.buffers(batch.column(1))
            doc, a, n, gram, places = runs(raw, offs, length)
            begin, data = offs[doc] + a, memoryview(raw)
            region = [_digest(data[s:e]) for s, e in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(a), pa.array(n), pa.array(gram.view(np.int64)), pa.array(places), pa.array(region, pa.binary())], names=["row", "a", "n", "gram", "places", "region"])

    return docs.select("row", "text").mapInArrow(work, "row binary, a long, n long, gram long, places long, region binary")


def _region_texts(docs: DataFrame, regions: DataFrame, length: int) -> DataFrame:
    """The bytes of each region, cut from the document that has it first."""
    wanted = regions.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("gram", "region", "n", "times", "shard", "shards", F.col("first.a").alias("a"))).alias("wanted"))
    texts = docs.select("row", "text").join(wanted, "row")

    def work(batches):
        for batch in at.pieces(batches, column="text"):
            raw, offs = at.buffers(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            fields = {f: flat.field(f) for f in ("gram", "region", "n", "times", "shard", "shards", "a")}
            begin = offs[owner] + fields["a"].to_numpy()
            data = memoryview(raw)
            body = [bytes(data[s:e]) for s, e in zip(begin.tolist(), (begin + fields["n"].to_numpy() + length - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(fields[f] for f in ("gram", "shard", "shards", "region", "n", "times")), pa.array(body, pa.binary())], names=["gram", "shard", "shards", "region", "n", "times", "body"])

    return texts.mapInArrow(work, "gram long, shard long, shards long, region binary, n long, times long, body binary")


def _sorted_shards(texts: DataFrame, length: int) -> DataFrame:
    """Each region's repeated starts; for grams in several shards also their distinct strings' fingerprints."""

    def solve(rows: list[dict]):
        bodies = [r["body"] for r in rows]
        flags, owner, place, number = repeated_starts(bodies, np.array([r["n"] for r in rows]), np.array([r["times"] for r in rows]), length)
        heads: list[list[dict]] = [[] for _ in rows]
        for o, p, c in zip(owner.tolist(), place.tolist(), number.tolist(), strict=True):
            if rows[o]["shards"] > 1:
                heads[o].append({"f": _digest(bodies[o][p : p + length]), "p": p, "c": c})
        return {
            "gram": [r["gram"] for r in rows], "region": [r["region"] for r in rows], "n": [r["n"] for r in rows], "shard": [r["shard"] for r in rows],
            "spans": [_spans(x) for x in flags], "heads": heads,
        }

    schema = StructType.fromDDL("gram long, region binary, n long, shard long, spans array<struct<s: long, n: long>>, heads array<struct<f: binary, p: long, c: long>>")
    span, head = pa.struct([("s", pa.int64()), ("n", pa.int64())]), pa.struct([("f", pa.binary()), ("p", pa.int64()), ("c", pa.int64())])
    arrow = pa.schema([("gram", pa.int64()), ("region", pa.binary()), ("n", pa.int64()), ("shard", pa.int64()), ("spans", pa.list_(span)), ("heads", pa.list_(head))])

    def work(batches):
        held, size, last, seen = [], 0, None, set()
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["gram"], row["shard"])
                if key != last:
                    if size >= SORT_BYTES:
                        yield pa.RecordBatch.from_pydict(solve(held), schema=arrow)
                        held, size = [], 0
                    seen = set()
                last = key
                if (row["region"], row["n"]) not in seen:  # repeated rows of the table bring a region again
                    seen.add((row["region"], row["n"]))
                    held.append(row)
                    size += len(row["body"])
        if held:
            yield pa.RecordBatch.from_pydict(solve(held), schema=arrow)

    return texts.repartition("gram", "shard").sortWithinPartitions("gram", "shard").mapInArrow(work, schema)


def _merged(sorted_: DataFrame) -> DataFrame:
    """Starts whose string is single in its shard but stands in another shard of the gram too."""
    heads = sorted_.where(F.size("heads") > 0).select("gram", "region", "n", "shard", F.explode("heads").alias("h")).select("gram", "region", "n", "shard", "h.f", "h.p", "h.c")

    def work(batches):
        # The partition's rows come in the order of (gram, f, shard): a run of one string is searched for a second shard.
        def found(table: pa.Table):
            f = table["f"].to_numpy(zero_copy_only=False)
            gram, shard, c = (table[name].to_numpy() for name in ("gram", "shard", "c"))
            new = np.ones(len(f), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (f[1:] != f[:-1])
            first = np.flatnonzero(new)
            several = np.maximum.reduceat(shard, first) != np.minimum.reduceat(shard, first)
            good = several[np.cumsum(new) - 1] & (c == 1)
            return table.select(["gram", "region", "n", "p"]).filter(pa.array(good)).combine_chunks().to_batches(max_chunksize=50_000)

        held: list[pa.RecordBatch] = []
        mark = lambda batch, k: (batch.column(0)[k].as_py(), batch.column(4)[k].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            now = mark(batch, batch.num_rows - 1)
            if mark(held[0], 0) != now:
                whole = pa.Table.from_batches(held).combine_chunks()
                cut = whole.num_rows - 1
                while mark(whole, cut - 1) == now:
                    cut -= 1
                yield from found(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    ordered = heads.repartition("gram", "f").sortWithinPartitions("gram", "f", "shard")
    hot = ordered.mapInArrow(work, "gram long, region binary, n long, p long")
    return hot.groupBy("gram", "region", "n").agg(F.collect_list(F.struct(F.col("p").alias("s"), F.lit(1).cast("long").alias("n"))).alias("more"))


def repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """(row, starts): for each row key of docs (row, text) the spans (a, s, n) of starts of repeated strings."""
    runs_table = scratch.store(_run_rows(docs, length), "runs")
    grams = scratch.store(runs_table.groupBy("gram").agg(F.sum("places").alias("c")).where("c > 1").select("gram"), "grams")
    found = scratch.store(runs_table.join(grams, "gram"), "shared-runs")
    scratch.drop(runs_table, grams)
    regions_table = scratch.store(found.groupBy("gram", "region", "n").agg(F.count("*").alias("times"), F.min(F.struct("row", "a")).alias("first")), "regions")
    shards = scratch.store(regions_table.groupBy("gram").agg(F.ceil(F.count("*") / SHARD_REGIONS).alias("shards")), "shards")
    regions = regions_table.join(shards, "gram").withColumn("shard", F.pmod(F.xxhash64("region"), "shards"))
    solved = scratch.store(_sorted_shards(_region_texts(docs, regions, length), length), "sorted")
    more = _merged(solved)
    spans = solved.join(more, ["gram", "region", "n"], "left").select("gram", "region", "n", F.concat("spans", F.coalesce("more", F.array().cast("array<struct<s: long, n: long>>"))).alias("spans")).where(F.size("spans") > 0)
    spans = scratch.store(spans, "spans")
    scratch.drop(solved)
    starts = found.join(spans, ["gram", "region", "n"]).groupBy("row").agg(F.collect_set(F.struct("a", "spans")).alias("starts"))
    starts = scratch.store(starts, "starts")
    scratch.drop(found, regions_table, shards, spans)
    return starts


def _key(text: str) -> Column:
    """128 bits for each different row: rows that are equal in id and text share it, with equal results."""
    named = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, F.coalesce(text, F.lit("")))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key("text").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _covered(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal spans (begin, end) of a text's bytes that lie in a repeated string."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((run["a"] + x["s"], run["a"] + x["s"] + x["n"] + length - 1) for run in starts or () for x in run["spans"]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _rest(data, gone: list[tuple[int, int]]) -> bytes:
    """data without the spans."""
    edges = [0, *(x for span in gone for x in span), len(data)]
    return b"".join(bytes(data[s:e]) for s, e in zip(edges[::2], edges[1::2], strict=True))


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document the bytes that stand in a repeated string of ``length`` bytes, and what is left.

    Reads ``doc_id`` and ``text``; null text is empty; rows equal in id and
    text count as documents of their own, so their strings repeat; an empty
    table gives an empty one.
    """
    keyed = _keyed(docs)
    both = keyed.join(repeated(keyed, length), "row", "left").select("doc_id", "text", "starts")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def work(batches):
        for batch in at.pieces(batches):
            raw, offs = at.buffers(batch.column(1))
            out: list[list] = [[] for _ in names]
            for s, e, starts in zip(offs.tolist(), offs[1:].tolist(), batch.column(2).to_pylist(), strict=False):
                data, gone = memoryview(raw[s:e]), _covered(starts, length)
                for column, x in zip(out, (e - s, sum(b - a for a, b in gone), len(gone), hashlib.sha256(_rest(data, gone)).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out[:3], [pa.int64()] * 3), pa.array(out[3], pa.string())], names=["doc_id", *names])

    return both.mapInArrow(work, StructType([docs.schema["doc_id"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string")]))


def _whole_words(data: bytes, s: int, e: int) -> int:
    """The words of data[s:e], without those that its ends go through."""
    inner = data[s:e]
    cut = (s > 0 and not data[s - 1 : s].isspace() and not inner[:1].isspace()) + (e < len(data) and not data[e : e + 1].isspace() and not inner[-1:].isspace())
    return len(inner.split()) - cut


def _passages(data: bytes, starts: list[dict] | None, length: int, words: int | None, long: int = 400) -> list[tuple[int, int]]:
    """The covered spans of a text that have ``words`` whole words or ``long`` bytes; all of them without ``words``."""
    return [(s, e) for s, e in _covered(starts, length) if words is None or e - s >= long or _whole_words(data, s, e) >= words]


def without_repeats(docs: DataFrame, length: int = 400, text: str = "text", words: int | None = None, long: int = 400) -> DataFrame:
    """docs with repeated strings cut out of the text; a character cut into goes whole.

    With ``words``, what repeated strings cover without a gap is cut only where it has that many
    whole words, or ``long`` bytes. Null texts stay null; other columns stay as they are, whatever
    their names; an empty table stays one.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), _key(text).alias("row"))
    spans = repeated(keyed.select("row", F.coalesce(F.col("doc").getField(text), F.lit("")).alias("text")), length)
    both = keyed.join(spans, "row", "left").select("doc.*", F.col("starts").alias(_free(docs, "starts")))

    def work(batches):
        for batch in at.pieces(batches, column=text):
            k = batch.schema.get_field_index(text)
            raw, offs = at.buffers(batch.column(k))
            kept = []
            for s, e, starts, there in zip(offs.tolist(), offs[1:].tolist(), batch.column(batch.num_columns - 1).to_pylist(), batch.column(k).is_valid().to_pylist(), strict=False):
                data = raw[s:e].tobytes()
                kept.append(_rest(data, _passages(data, starts, length, words, long)).decode(errors="ignore") if there else None)
            columns = [pa.array(kept, pa.string()) if c == k else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return both.mapInArrow(work, docs.schema)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name
