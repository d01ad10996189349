"""Importance resampling, whitening and cutting-stock packing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlens.llm import cutting_stock, importance, queries, tokens, whitening
from weftlens.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
DOCS = "doc_id long, text string, weight string, rank int, row string"


def made_texts():
    rng = np.random.default_rng(5)
    some = [f"{w}" for w in ["alpha", "Beta", "ÉCOLE", "日本", "x1", "don't", "K", "ſ", "z" * 70]]
    texts = [" ".join(rng.choice(some, int(n))) for n in rng.integers(0, 90, 60)]
    return [*texts, None, "", " \t.", "one", "wide " * 6000, texts[3], texts[3], "ab" * 4000, "a,b;c\x00d ~{}e", "ΟΔΥΣΣΕΥΣ J̌ it's"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", 1, "clash") for k, t in enumerate(made_texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3], (rows[4][0], "another text " * 20, None, None, None), (None, made_texts()[5], None, None, None)], DOCS).repartition(5)


# Importance resampling.


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], len(words)


def expected_sample(rows, target, share=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[0]))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out, able = [], []
    for doc, text in rows:
        found, words = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None])
        if words >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k in range(share * len(able) // 100):
        able[k][4] = k + 1
    return out


def test_crcs_of_spans_and_of_joined_spans():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 400)
    ends = starts + np.concatenate([rng.integers(0, 60, 390), rng.integers(100, 1000, 10)])
    found = importance.crc32s(raw, starts, ends)
    data = raw.tobytes()
    assert found.tolist() == [zlib.crc32(data[s:e]) for s, e in zip(starts, ends, strict=True)]
    other = found[::-1].copy()
    both = importance.joined(other, found, ends - starts)
    assert both.tolist() == [zlib.crc32(data[a:b] + data[s:e]) for a, b, s, e in zip(starts[::-1], ends[::-1], starts, ends, strict=True)]


def test_resampling_equals_brute_force(spark, docs, tmp_path):
    target = ["alpha x1 alpha", None, "日本 école ÉCOLE", "wide wide"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    # Rows of one id and score are interchangeable; so are their ranks.
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, expected_sample(rows, target)), key=key)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, t) for t in target], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(map(tuple, queries.op11_importance(spark, str(tmp_path)).collect()), key=key) == sorted(map(tuple, found.collect()), key=key)


def test_resampling_of_empty_tables(spark):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.resample(none, nothing).collect() == []
    few = importance.resample(spark.createDataFrame([(1, "a b", "", 1, "")], DOCS), nothing).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in few] == [(1, 3, None)]


def test_selection_by_digits(spark, monkeypatch):
    monkeypatch.setattr(importance, "DIGIT", 3)
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.integers(-50, 900, 400), rng.integers(-3, 3, 400), strict=True))]
    rows += [(7, 0, 1000 + k) for k in range(150)]  # a hot score
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 2, 40, 90, 200, 549, 550):
        assert tuple(importance.select(frame, ["a", "b", "c"], k)) == sorted(rows)[k - 1]
    assert importance.select(frame, ["a", "b", "c"], 0) is None
    order = [r.c for r in importance.ranked(frame, ["a", "b", "c"], len(rows)).orderBy("rank").collect()]
    assert order == [r[2] for r in sorted(rows)]


# Whitening.


def test_symmetric_qr_equals_the_library():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 60):
        for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.zeros((n, n)), np.diag(np.arange(float(n)))):
            a = a + a.T
            values, vectors = whitening.eigen(a)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, n))
            assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13 * max(10, n))
            assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * max(10, n))


def test_states_merge_to_the_covariance():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (999, 7)) + 1_000_000
    whole = np.cov(x.T.astype(float), bias=True)
    state = whitening.State(7)
    for part in np.array_split(x, 5):
        other = whitening.State(7)
        for batch in np.array_split(part, 9):
            other.update(batch)
        state = whitening.State.unpack(*state.merge(whitening.State.unpack(*other.pack())).pack())
    assert state.n == 999 and state.totals() == x.sum(0).tolist()
    assert np.allclose(state.products / 999, whole, rtol=1e-12, atol=1e-9)
    one = whitening.State(7)
    for row in x[:50]:
        one.update(row[None])  # rank-one updates by themselves
    block = whitening.State(7)
    block.update(x[:50])
    assert np.allclose(one.products, block.products, rtol=1e-12, atol=1e-8)


VECTORS = "vec_id long, embedding array<float>, component string, n string"


def test_whitening_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(400, 6)) * [1, 2, 3, 0.5, 1, 0] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(7, base[7].tolist())] * 150
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (None, base[1].tolist()), (905, [1.0, 2.0]), (906, [3.0, 2.5])]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows + odd], VECTORS).repartition(7)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_whitening(spark, str(tmp_path)).collect()
    kept = [*rows, odd[5]]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in kept])
    n, total = len(x), x.sum(0)
    v = np.cov(x.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == n * 6 + 2 * 2
    mine = defaultdict(dict)
    for r in found:
        if r.n == n:
            mine[r.vec_id][r.component] = r
            assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9 and r.identity_error < 1e-9
    side = {}
    for k, (vec, _) in enumerate(kept):
        assert mine[vec][1].deviation == sum(int(n * a - s) ** 2 for a, s in zip(x[k].tolist(), total.tolist(), strict=True))
        for c in range(1, 7):
            expected = (x[k] - total / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            sign = side.setdefault(c, np.sign(expected * mine[vec][c].whitened))
            assert abs(mine[vec][c].whitened - sign * expected) < 1e-7
    pair = [r for r in found if r.n == 2]
    assert {(r.vec_id, r.component, r.whitened is None) for r in pair} == {(905, 1, False), (905, 2, True), (906, 1, False), (906, 2, True)}
    assert {round(abs(r.whitened), 9) for r in pair if r.component == 1} == {1.0}


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0], "", "") for k in range(3)], VECTORS)).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], "", ""), (2, [-1e30, 1.0], "", "")], VECTORS)).collect()
    assert {r.deviation for r in huge} == {None} and {round(abs(r.whitened), 6) for r in huge if r.component == 1} == {1.0}
    wide = whitening.whiten(spark.createDataFrame([(k, [float(k * j % 7) for j in range(40)], "", "") for k in range(60)], VECTORS))
    assert wide.agg(F.max("component")).first()[0] == 32


# Cutting stock.


def check_places(rows, limit):
    seen, used = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id] and r.length > 0
        used[r.sequence_id] += r.length
        seen[r.doc_id] += 1
    assert all(v & (v - 1) == 0 and v <= limit for v in used.values())
    assert sum(v for v in used.values() if v < limit) < limit
    return used


@pytest.mark.parametrize("limit", [16, 256, 2048])
def test_pieces_hold_every_id_once(spark, docs, limit, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(WORDS)
    coder.encode_special_tokens = True
    rows = cutting_stock.pack(docs, WORDS, limit=limit).collect()
    used = check_places(rows, limit)
    ids = {r.text: [*coder.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert sum(used.values()) == sum(len(ids[r.text]) for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (3, 4, None)}
    pieces = defaultdict(list)
    for r in rows:
        if r.doc_id in texts:
            pieces[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
            assert r.doc_tokens == len(ids[texts[r.doc_id]]) and len(r.ids) == 4 * r.length
    for doc, text in texts.items():
        joined = []
        for start, part in sorted(pieces[doc]):
            assert start == len(joined)
            joined += part
        assert joined == ids[text]
    if limit == 2048:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        for r in queries.op13_cutting_stock(spark, str(tmp_path)).collect():
            if r.doc_id in texts:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[texts[r.doc_id]][r.start : r.start + r.length], "<u4").tobytes())
    packed = cutting_stock.sequences(cutting_stock.pack(docs, WORDS, limit=limit)).collect()
    assert sorted(len(r.ids) // 4 for r in packed) == sorted(used.values()) and all(r.cu_seqlens[-1] * 4 == len(r.ids) for r in packed)


def test_patterns_cover_nearly_all():
    rng = np.random.default_rng(8)
    lengths = np.arange(1, 128)
    demand = rng.integers(1, 3000, 127)
    demand[0] = 200_000  # a hot length
    patterns, often = cutting_stock.generate(lengths, demand, 128)
    assert (patterns @ lengths == 128).all()
    count = cutting_stock.rounded(patterns, often, demand)
    left = demand - count @ patterns
    assert left.min() >= 0 and left @ lengths < 0.02 * (demand @ lengths)


def test_program_reaches_the_optimum():
    """Against all patterns: 7s and 5s fill 24 in no way but 7 + 7 + 5 + 5; 3 of 7 and 8 of 5 leave 1.5 patterns' worth."""
    patterns, often = cutting_stock.generate(np.array([5, 7]), np.array([8, 3]), 24, spare=0.0)
    assert patterns[0].tolist() == [2, 2] and often[0] == 1.5
    none, _ = cutting_stock.generate(np.array([5, 10]), np.array([8, 3]), 24)
    assert len(none) == 0
    # 3 of 10 + 6, 1 of 8 + 4 + 4, 0.5 of 6 + 6 + 4 and 0.875 of 4 + 4 + 4 + 4 leave nothing.
    lengths, demand = np.array([4, 6, 8, 10]), np.array([6, 4, 1, 3])
    patterns, often = cutting_stock.generate(lengths, demand, 16, spare=0.0)
    assert abs(often @ (patterns @ lengths) - 86) < 1e-9


def test_packing_of_odd_tables(spark):
    assert cutting_stock.pack(spark.createDataFrame([], DOCS), WORDS).collect() == []
    many = spark.range(5000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    rows = cutting_stock.pack(many, WORDS).collect()
    check_places(rows, 2048)
    assert len(rows) == 5000 and len({r.sequence_id for r in rows}) == 2 + bin(5000 % 2048).count("1")
    with pytest.raises(ValueError):
        cutting_stock.pack(many, WORDS, limit=100)


def test_words_are_cut_where_the_library_agrees():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(WORDS)
    coder.encode_special_tokens = True
    rng = np.random.default_rng(6)
    parts = ["a", "B", "É", "é", "J̌", "J", "̌", "Σ", "ΑΣ", "İ", " ", "\t", " ", "'s", "'S", "'", ",", ".", "<", "̸", "!?", "12", "日本", "한", "、", "\x1c", "<|endoftext|>", "\x00"]
    made = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    ids, offs = tokens.words(WORDS).encode_array(pa.array([*made, None]))
    for k, t in enumerate(made):
        assert ids[offs[k] : offs[k + 1]].tolist() == coder.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_letter_that_lowers_to_a_mark_is_not_cut_off():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(WORDS)
    coder.encode_special_tokens = True
    for text in ("İ<|", "Sİ<|endoftext|> <", "aİ,", "İ.İ!", "İ、"):
        ids, _ = tokens.WordTable(tokens._library(WORDS)).encode_array(pa.array([text]))
        assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids, text
