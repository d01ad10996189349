"""The llm operators on small inputs: brute force, round trips and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftlens.llm import arrowtext, attention_lm, avi, best_fit, binary_rows, bpe, curves, near_dup, quality, queries, suffix_dedup, tokens, toxicity
from weftlens.llm.queries import vocabulary

RANKS, BPE = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, sequence_id int"
LABELS = "doc_id long, quality int, toxic int"


def passage(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = passage(1)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return ["", None, " \n\t", "a", base, base, near, passage(2), passage(3, 30) + " " + passage(4) + " end", "front " + passage(4), "ab" * 3000, "same " * 900, "é日本😀 'll 's 12", "x" * 40_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", None if k % 3 == 0 else len(t or ""), "clash", "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, "no id", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None)], LABELS)


def test_matches_and_merges_equal_the_library():
    import tiktoken
    from public_tokenizers import PATTERN

    coder = bpe.load(RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(0)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "1", "23", "é", "日本", "!", "%%", "　", "the", "ing", "'T", "😀", "ſ", "\x00"]
    made = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)] + ["a" * 3000, " " * 3000, "", None]
    for table in (bpe.matches(RANKS), tokens.matches(BPE)):
        ids, offs = table.encode_array(pa.array(made))
        for k, t in enumerate(made):
            assert ids[offs[k] : offs[k + 1]].tolist() == library.encode_ordinary(t or "")
            assert coder.decode(ids[offs[k] : offs[k + 1]]).tobytes() == (t or "").encode()


def thue_morse(n=1024):
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_of_regular_texts_differ():
    for pair in (thue_morse(), thue_morse(4096)):
        values = np.frombuffer("".join(pair).encode(), np.uint8)
        n = len(pair[0])
        a, b = arrowtext.span_hashes(values, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        assert arrowtext.span_hashes(values[n:], np.array([0]), np.array([n]))[0] == b


def test_matches_of_equal_hash_are_told_apart(monkeypatch):
    weak = lambda values, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(44)
    made = pa.array([*thue_morse(), "one two six", "ten", "", None, "é日 本a"])
    plain = bpe.MatchTable(lambda words: [bpe.load(RANKS).encode(w.encode()) for w in words])
    expected = [x.tolist() for x in plain.encode_array(made)]
    monkeypatch.setattr(arrowtext, "span_hashes", weak)
    other = bpe.MatchTable(lambda words: [bpe.load(RANKS).encode(w.encode()) for w in words])
    for _ in range(2):
        assert [x.tolist() for x in other.encode_array(made)] == expected


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    made = pa.array(["", "it's 'll a  b " * 300, None, "x" * 500, "日本 the end", thue_morse()[0], "they're  in\n the're " * 90])
    table = bpe.MatchTable(lambda words: [bpe.load(RANKS).encode(w.encode()) for w in words])
    whole = [x.tolist() for x in table.encode_array(made)]
    for block in (1, 7, 100, 3000):
        monkeypatch.setattr(bpe, "BLOCK", block)
        assert [x.tolist() for x in table.encode_array(made)] == whole


def test_queries_encode_whole_tables(spark, tmp_path):
    """The registered queries on a table of odd rows, against the libraries."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    made = [*thue_morse(), None, "", "a b" * 900, "\U0001f600 it's"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(made)] + [(2, None), (None, "no id")], "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(RANKS).ranks, special_tokens={})
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    expected = Counter()
    for r in table.collect():
        ids = library.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), digest(ids), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    found = queries.op1_byte_bpe(spark, str(tmp_path))
    assert Counter(map(tuple, found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected
    coder = Tokenizer.from_file(BPE)
    for r in queries.op2_best_fit(spark, str(tmp_path)).collect():
        if r.doc_id is not None:
            ids = [*coder.encode(made[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_encode_keeps_columns_and_decodes(docs, texts):
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert len(back) == len(texts) + 2
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.source in (None, "s") for r in back)
    for r in bpe.digest(docs, RANKS).collect():
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_best_fit_respects_every_capacity(docs, texts):
    rows = best_fit.pack(docs, BPE).collect()
    coder = tokens.matches(BPE)
    seen = Counter()
    for r in rows:
        if r.doc_id is not None:
            ids, _ = tokens.with_end(BPE, pa.array([texts[r.doc_id]], pa.string()), 2)
            assert zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32
            assert r.length == 1024 or r.piece == 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seen[r.sequence_id]
        seen[r.sequence_id] += r.length
    assert max(seen.values()) <= 1024 and coder is not None
    lengths = np.random.default_rng(1).integers(1, 200, 3000)
    for rule in ("norm", "dot"):
        limits = best_fit.Capacity(tokens=512, documents=6, cost=60_000, rule=rule, weights=(1, 0.5, 0.5))
        bins, offset = best_fit.place(lengths, limits)
        assert np.bincount(bins, lengths).max() <= 512 and np.bincount(bins).max() <= 6 and np.bincount(bins, lengths**2).max() <= 60_000
        assert len(offset) == 3000
    bins, _ = best_fit.place(lengths, best_fit.Capacity())
    assert min(best_fit.Capacity().weights) > 0 and len(set(bins.tolist())) <= -(-lengths.sum() // 1024) + 1
    with pytest.raises(ValueError):
        best_fit.place(np.array([600]), best_fit.Capacity(tokens=512))


def test_many_tiny_texts_are_packed_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "AGAIN", 3000)
    none = spark.range(0, 20_000, 1, 2).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    packed = best_fit.pack(none, BPE)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() == 20_000 and packed.select("sequence_id").distinct().count() <= 20_000 // 1024 + 2
    one = spark.createDataFrame([(1, "word " * 700)], "doc_id long, text string")
    both = best_fit.pack(none.limit(300).unionByName(one).repartition(7), BPE)
    assert both.select("sequence_id").distinct().count() == 1


def test_binary_rows_hold_all_ids(docs, texts):
    rows = binary_rows.rows(docs, BPE).collect()
    held = Counter()
    for r in rows:
        line = np.frombuffer(r.ids, "<u2")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert not line[r.n_tokens :].any()
        assert np.flatnonzero(binary_rows.position_ids(r.cu_seqlens) == 0).tolist() == r.position_resets
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            if d is not None:
                ids, _ = tokens.with_end(BPE, pa.array([texts[d]], pa.string()), 2)
                assert line[a:b].tolist() == ids[s : s + b - a].tolist()
                held[d] += b - a
    assert len(held) == len(texts)
    tree = binary_rows.Capacities(10)
    for room in (3, 7, 7, 10):
        tree.add(room, room)
    assert [tree.take(5)[0], tree.take(5)[0], tree.take(8)[0], tree.take(4)] == [7, 7, 10, None]


def bag(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in (text or "").split()]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def classes(texts, threshold=0.8):
    root = list(range(len(texts)))
    bags = [bag(t) for t in texts]
    for b in range(len(texts)):
        for a in range(b):
            every = (bags[a] | bags[b]).total()
            if (texts[a] or "") == (texts[b] or "") or every and (bags[a] & bags[b]).total() >= threshold * every:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert found.pop(None) is None
    assert [found[k] for k in range(len(texts))] == classes(texts)
    kept = near_dup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(classes(texts)))
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_a_chain_of_edits_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    words = passage(9, 100).split()
    made = []
    for k in range(90):
        edited = list(words)
        for place in rng.choice(100, 2 if k % 2 else 1, replace=False):
            edited[place] = f"w{k}x{place}"
        made.append(" ".join(edited))
    made += [passage(9, 100) + " " + passage(100 + k, 60 + k) for k in range(30)]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()}
    assert [found[k] for k in range(len(made))] == classes(made)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    agree = []
    for k in range(40):
        h = arrowtext.mix(hashes + np.uint64(k))
        both = near_dup.signatures(np.concatenate([h[a > 0], h[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        agree.append((both[0] == both[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def repeats_by_force(rows, length):
    """(covered flags) of each text."""
    count = Counter(b[i : i + length] for _, t in rows for b in [t.encode()] for i in range(len(b) - length + 1))
    for _, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield gone


def test_suffix_arrays_equal_brute_force(docs, texts, monkeypatch):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    expected = Counter()
    for (d, t), gone in zip(rows, repeats_by_force(rows, 400), strict=True):
        b = t.encode()
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        expected[d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = suffix_dedup.digests(docs)
    assert Counter(map(tuple, found.select(*columns).collect())) == expected
    cut = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert cut[1] is None and cut[4] == "" and cut[3] == "a"
    assert suffix_dedup.digests(docs.limit(0)).count() == suffix_dedup.without_repeats(docs.limit(0)).count() == 0
    # Blocks of a long text, and keys that do not fit one number with their places.
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    a = suffix_dedup.runs(*arrowtext.buffers(pa.array(texts)), 400)
    starts = Counter((d, i) for d, first, n in zip(*(x.tolist() for x in a[:3]), strict=True) for i in range(first, first + n))
    assert set(starts.values()) == {1} and set(starts) == {(d, i) for d, t in enumerate(texts) for i in range(len((t or "").encode()) - 399)}


def test_equal_rows_share_one_list(spark):
    """Rows equal in id and text are one key, whose list does not grow with their number."""
    text = passage(50, 200)
    sizes = []
    for copies in (2, 40):
        rows = spark.createDataFrame([(1, text)] * copies + [(2, "x " + text + " y")], "doc_id long, text string")
        keyed = suffix_dedup._keyed(rows)
        sizes.append(suffix_dedup.repeated(keyed.select("row", "text")).selectExpr("max(size(starts)) AS n").first().n)
        assert suffix_dedup.digests(rows).where("doc_id = 1").count() == copies
        assert {r.n_removed for r in suffix_dedup.digests(rows).where("doc_id = 1").collect()} == {len(text)}
    assert sizes[0] == sizes[1]


def test_shards_of_a_hot_gram_merge(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_REGIONS", 2)
    shared = passage(7, 90)
    made = [passage(200 + k, 20) + shared + passage(300 + k // 2, 20) for k in range(14)]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    length = 100
    count = Counter(b[i : i + length] for t in made for b in [t.encode()] for i in range(len(b) - length + 1))
    for r in suffix_dedup.digests(table, length).collect():
        b = made[r.doc_id].encode()
        gone = {j for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1 for j in range(i, i + length)}
        assert r.n_removed == len(gone)


def test_sorted_suffixes_and_prefixes():
    rng = np.random.default_rng(3)
    for depth, n in ((3, 300), (8, 300), (13, 300), (40, 300), (40, 9)):
        text = rng.integers(97, 99, n).astype(np.uint8)
        order, rank = suffix_dedup.suffix_order(text, depth)
        raw = text.tobytes()
        heads = [raw[k : k + depth] for k in order]
        assert heads == sorted(heads)
        prefix = suffix_dedup.common_prefixes(text, order, rank, depth)
        for k in range(1, len(order)):
            if heads[k] == heads[k - 1]:
                assert prefix[k] == len(heads[k])


def test_toxic_words_are_learned_and_misspelled_ones_found(spark):
    rng = np.random.default_rng(4)
    bad = ["wretched", "horrid", "vile"]
    made, y = [], []
    for k in range(600):
        words = passage(1000 + k, 40).split()
        if k % 3 == 0:
            for place in rng.choice(40, 3, replace=False):
                words[place] = bad[rng.integers(3)]
        made.append(" ".join(words))
        y.append(int(k % 3 == 0))
    table = spark.createDataFrame(list(enumerate(made[:450])), "doc_id long, text string")
    known = spark.createDataFrame([(k, None, y[k]) for k in range(450)], LABELS)
    model = toxicity.fit(table, known)
    assert toxicity.fit(table, known).logits.tolist() == model.logits.tolist()
    scores = toxicity.Scorer(model)(pa.array([*made[450:], "you wretchedd horrrid wretchd thing", "", None]))
    assert (((scores[:150] >= 0.5) == np.array(y[450:])).mean()) > 0.95
    assert scores[150] > 0.5 and scores[151] == scores[152] == model.prior and 0.2 < model.prior < 0.5
    assert len(toxicity.fit(table, known, most_bytes=5).grams) == 0 and len(toxicity.fit(table.limit(0), known).grams) == 0


def test_scores_have_a_row_for_each_document(docs, labels, texts):
    for rows in (toxicity.toxic_scores(docs, labels).collect(), quality.quality_scores(docs, labels).collect()):
        assert len(rows) == len(texts) + 2
        assert all(0 <= r.score <= 1 for r in rows)
        assert {r.doc_id for r in rows if r.held_out} == {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 0}
    none = labels.where("false")
    assert {r.predicted for r in toxicity.toxic_scores(docs, none).collect()} == {0}
    assert {r.good for r in quality.quality_scores(docs, none).collect()} == {1}


def test_cotraining_beats_one_view():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 1200)
    views = [rng.normal(0, 1, (1200, 6)) + by * (2 * y - 1)[:, None] for by in (0.5, 0.35)]
    model = quality.cotrain(views[0][:60], views[1][:60], y[:60], (views[0][60:700], views[1][60:700]))
    text, page, both = model(views[0][700:], views[1][700:])
    assert ((both >= 0.5) == y[700:]).mean() >= 0.85


def neighbours_by_force(vectors, every, k):
    out = {}
    for q, x in vectors.items():
        if q % every == 0:
            scores = [(-float(np.dot(x, v) / (np.linalg.norm(x) * np.linalg.norm(v))), i) for i, v in vectors.items() if i != q]
            out[q] = sorted(scores)[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = {k: rng.normal(size=8) for k in range(300)}
    for k in range(100, 140):
        rows[k] = rows[0]
    table = [(k, [float(np.float32(c)) for c in x]) for k, x in rows.items()]
    odd = [(900, None), (950, [0.0] * 8), (1000, [float("nan")] * 8), (1050, [None] * 8), (1100, [1.0]), (None, [1.0] * 8), table[5]]
    df = spark.createDataFrame([*table, *odd], "vec_id long, embedding array<float>")
    expected = neighbours_by_force({k: np.array(x) for k, x in table}, 50, 5)
    found: dict = {}
    for r in sorted(curves.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(expected)
    for q, got in found.items():
        np.testing.assert_allclose([s for _, s in got], [-s for s, _ in expected[q]], atol=1e-12)
    assert [i for i, _ in found[0]] == [100, 101, 102, 103, 104] and [i for i, _ in found[100]] == [0, 101, 102, 103, 104]
    assert curves.nearest(df.limit(0)).count() == 0
    assert curves.nearest(df.limit(3)).count() == 2
    # Each length is searched by itself; one long vector does not remove the others.
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0]), (100, [1.0] * 9), (150, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in curves.nearest(mixed).collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0), (150, 1, 2)]


def test_neighbours_in_a_group_of_multiples_and_near_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-99, 99, 8).astype(float)
    # Multiples of one vector, then copies that one byte a component does not tell apart.
    rows = {k: base * (1 + k % 97) for k in range(200)} | {k: base + [1e-3 * (1 + k % 89), *[0] * 7] for k in range(200, 400)} | {k: rng.normal(size=8) for k in range(400, 600)}
    table = [(k, [float(np.float32(c)) for c in x]) for k, x in rows.items()]
    expected = neighbours_by_force({k: np.array(x) for k, x in table}, 50, 5)
    found: dict = {}
    for r in sorted(curves.nearest(spark.createDataFrame(table, "vec_id long, embedding array<float>")).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(expected)
    for q, got in found.items():
        np.testing.assert_allclose([s for _, s in got], [-s for s, _ in expected[q]], rtol=0, atol=1e-14)
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for i, _ in found[100]] == [0, 1, 2, 3, 4]
    # 200 and the same sum 89 on: their vectors are equal, and nearest to each other.
    assert [i for i, _ in found[200]][:2] == [289, 378]


def test_windows_widen_with_the_table(spark):
    x = np.random.default_rng(10).normal(size=(12_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::100] @ unit.T
    near[np.arange(len(near)), np.arange(0, len(x), 100)] = -2
    best = {(100 * q, int(i)) for q, row in enumerate(np.argpartition(-near, 5, axis=1)[:, :5]) for i in row}
    # 32 curves and three blocks of 8 are 768 ranks of 12,000.
    recall = {s: len(best & {(r.query_id, r.vec_id) for r in curves.nearest(df, every=100, window=8, share=s).collect()}) / len(best) for s in (0, curves.SHARE)}
    assert recall[0] < 0.6 and recall[curves.SHARE] >= 0.9


def test_hilbert_keys_are_a_walk():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curves.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_language_model_base_is_exact(docs):
    rows = docs.select("doc_id", "text").collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) + [None] for r in rows]
    counts = Counter(w for r, ws in zip(rows, words, strict=True) if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in ws)
    total, kinds = counts.total(), len(counts)
    expected = Counter()
    for r, ws in zip(rows, words, strict=True):
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        expected[r.doc_id, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 5)] += 1
    found = attention_lm.scores(docs, BPE, RANKS).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    assert all(r.score < 0 for r in found)


def test_mixture_does_not_depend_on_the_words_that_tasks_hold(spark, monkeypatch):
    # Each word is in every document; an untrained net spells badly, so that the share hangs on the counts.
    rows = spark.createDataFrame([(k, passage(3, 60)) for k in range(40)], "doc_id long, text string")
    counts = attention_lm.count_words(rows).cache()
    monkeypatch.setattr(attention_lm.Attention, "train", lambda *_: None)
    models = []
    for most in (1 << 18, 20):
        monkeypatch.setattr(attention_lm, "FREQUENT", most)
        models.append(attention_lm.fit(rows, counts, BPE, RANKS))
    assert len(models[1].hashes) < len(models[0].hashes)
    assert abs(models[0].spelled - models[1].spelled) < 1e-9


def test_long_texts_train_too(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(attention_lm.Attention, "train", lambda *_: None)
    keep = attention_lm.choose_units
    monkeypatch.setattr(attention_lm, "choose_units", lambda words, *a: seen.append(words) or keep(words, *a))
    rows = spark.createDataFrame([(k, f"word{k} " * 400) for k in range(12)] + [(None, None), (20, "")], "doc_id long, text string")
    attention_lm.fit(rows, attention_lm.count_words(rows), BPE, RANKS, most=50)
    whole = {f"word{k}".encode() for k in range(12) if zlib.crc32(str(k).encode()) % 5 != 1}
    assert whole <= set(seen[0]) and all(n <= 10 for n in seen[0].values())


def test_attention_scores_are_probabilities():
    words = {w.encode(): 5 for w in ["the", "then", "there", "other", "a"]}
    spelling = attention_lm.choose_units(words, BPE, RANKS, most=5)
    net = attention_lm.Attention(spelling, np.arange(len(spelling.initial)))
    tables = net.tables()
    n = len(spelling.initial)
    context = spelling.units([b"the", b"then"])
    prefix = np.array([u for w in context for u in w])
    seqs = np.concatenate([np.append(prefix, u) for u in range(n)])
    lp, _ = net.score(tables, seqs, np.full(n, len(prefix) + 1), spelling.begin)
    assert abs(np.exp(lp.reshape(n, -1)[:, -1]).sum() - 1) < 1e-3
    assert np.allclose(lp.reshape(n, -1)[:, 0], lp[0], atol=1e-4)


@pytest.mark.parametrize("body", [b"", b"abc", bytes(range(256)) * 5, b"\xff" * 1000, b"text " * 700])
def test_films_hold_their_payload(body):
    media = avi.store(avi.payload(body))
    back, histograms, pace = avi.read(media)
    assert back[: len(body)] == body and len(back) % 192 == 0 and len(back) > 0 and not back[len(body) :].strip(b" ")
    assert histograms.sum() == 256 * len(histograms) and pace == 0.04
    with pytest.raises(ValueError):
        avi.parse(media[:100])


def test_film_rows(docs, texts):
    rows = avi.digests(docs).collect()
    assert len(rows) == len(texts) + 2
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4][1:] == by_id[5][1:] and by_id[0].payload_bytes == 192 == by_id[1].payload_bytes
    for r in rows:
        if r.doc_id is not None:
            assert r.payload_sha256 == hashlib.sha256(avi.payload((texts[r.doc_id] or "").encode())).hexdigest()
            media = avi.store(avi.payload((texts[r.doc_id] or "").encode()))
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(avi.payload((texts[r.doc_id] or "").encode())[-16:]), len(media), hashlib.sha256(media).hexdigest())
            assert r.feature.split("cuts=")[1] == ",".join(str(c.first_frame) for c in r.clips[1:])
            assert r.clips[0].first_frame == 0 and sum(c.n_frames for c in r.clips) == -(-r.payload_bytes // 768)
    clips = avi.clips(docs).collect()
    assert Counter((r.doc_id, c.first_frame, c.end_s) for r in rows for c in r.clips) == Counter((r.doc_id, r.first_frame, r.end_s) for r in clips)
    assert avi.digests(docs.limit(0)).count() == avi.clips(docs.limit(0)).count() == 0
    assert {r.doc_id for r in clips} == {r.doc_id for r in rows} and all(r.end_s > r.start_s for r in clips)
    steps = np.zeros((20, 16))
    steps[:10, 0] = steps[10:, 9] = 5
    assert avi.shots(steps).tolist() == [0, 10] and avi.shots(steps[9:]).tolist() == [0, 1]


def test_empty_tables_give_empty_results(docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    for got in (
        bpe.digest(none, RANKS), best_fit.pack(none, BPE), near_dup.near_duplicates(none), suffix_dedup.digests(none), toxicity.toxic_scores(none, no_labels), binary_rows.rows(none, BPE),
        attention_lm.scores(none, BPE, RANKS), quality.quality_scores(none, no_labels), avi.digests(none), near_dup.keep_one(none), suffix_dedup.without_repeats(none, 220, words=51),
    ):
        assert got.count() == 0


def test_a_very_long_text(spark):
    """Two megabytes in a row, with words, without blanks, and one byte over and over, beside short rows."""
    words = passage(40, 20_000)
    made = [(0, words * 14), (1, "x" * 2_000_000), (2, "".join(passage(41, 30_000).split()) * 16), (3, "short"), (4, None)]
    table = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    sizes = {k: len((t or "").encode()) for k, t in made}
    got = {r.doc_id: r for r in bpe.digest(table, RANKS).collect()}
    assert all(got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for k, t in made)
    assert {r.doc_id: r.n_bytes for r in suffix_dedup.digests(table).collect()} == sizes
    assert sum(r.length for r in best_fit.pack(table, BPE).collect() if r.doc_id == 0) == len(tokens.matches(BPE).encode_array(pa.array([made[0][1]]))[0]) + 1
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()} == {k: k for k in sizes}


def test_stars_make_no_rows_by_explode(spark):
    from weftlens.llm import near_dup

    members = spark.range(40).selectExpr("id AS rep", "0 AS band", "'k' AS key", "40L AS n", "0L AS hub")
    pairs = near_dup._stars(members)
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.a, r.b) for r in pairs.collect()}
    assert {(k, 0) for k in range(1, 40)} <= rows and len(rows) <= 3 * 39


def test_token_tables_keep_fewer_matches_than_others():
    from weftlens.llm import bpe, tokens

    path = queries.vocabulary("byte_bpe_50k.json")
    assert tokens.matches(path).most == tokens.KEPT < bpe.ENTRIES
    small, texts = bpe.MatchTable(tokens._library(path), 3), pa.array(["one two three four", None, "five six one two"])
    for _ in range(3):
        assert [x.tolist() for x in small.encode_array(texts)] == [x.tolist() for x in tokens.matches(path).encode_array(texts)]
    assert small._entries < 12
