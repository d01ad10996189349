"""Names in one pass and word differences, against brute force."""

import random
import re

from pyspark.sql import functions as F

from weftlens.functions import names
from weftlens.functions.diff import MOST, differences
from weftlens.plans import registry


def alternation(found, text, border=None):
    """What an alternation of the names, the longest first, finds: by slices of each length."""
    known, sizes, out, at = set(found), sorted({len(n) for n in found}, reverse=True), [], 0
    bars = re.compile(border) if border else None
    while at < len(text):
        for size in sizes:
            end = at + size
            if text[at:end] in known and end <= len(text) and not (bars and (at and bars.match(text[at - 1]) or end < len(text) and bars.match(text[end]))):
                out.append((at, end, text[at:end]))
                at = end
                break
        else:
            at += 1
    return out


def test_names_equal_the_alternation():
    draw = random.Random(1)
    for border in (None, "[a-c]"):
        for _ in range(300):
            found = ["".join(draw.choice("abcd ") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 12))]
            text = "".join(draw.choice("abcd ") for _ in range(60))
            register = names.Names.of(found, border)
            assert list(register.matches(text)) == alternation(found, text, border)
            if not border:
                assert [m for _, _, m in register.matches(text)] == re.findall("|".join(map(re.escape, register.names)), text)
    assert list(names.Names.of([]).matches("x")) == list(names.Names.of(["x"]).matches(None)) == []


def test_20000_names_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = [w for t in texts.values() for w in (t or "").split()]
    found = {" ".join(words[k : k + 1 + k % 3]) for k in range(0, len(words), 2)}
    found = sorted(found)[:20_000]
    assert len(found) == 20_000
    register = names.Names.of(found)
    got = {r.doc_id: [tuple(m) for m in r.m] for r in docs.select("doc_id", names.found("text", register).alias("m")).collect()}
    for doc in sorted(texts)[:60]:
        assert got[doc] == alternation(found, texts[doc] or "")
    rare = names.Names.of(found[-300:])
    flags = {r.doc_id: r.f for r in docs.select("doc_id", names.any_found("text", rare).alias("f")).collect()}
    assert flags == {k: any(n in (t or "") for n in rare.names) for k, t in texts.items()}
    assert 0 < sum(flags.values()) < len(flags)


def test_few_names_are_an_alternation(spark):
    rows = spark.createDataFrame([(1, r"a\\E.b"), (2, "axb"), (3, None), (4, "가나법"), (5, "가나 법")], "k int, t string")
    for found, expected in (([r"a\\E.b"], [1]), ([r"x", "법"], [2, 4, 5]), ([], [])):
        few = names.any_found("t", names.Names.of(found))
        assert [r.k for r in rows.where(few).orderBy("k").collect()] == expected
    assert [r.k for r in rows.where(names.any_found(F.col("t"), names.Names.of(["법"], "[가-힣]"))).collect()] == [5]


def table(a, b):
    """The same differences by the whole table of lengths."""
    x, y = ([t for t in re.split(r"(\s+)", s or "") if t] for s in (a, b))
    if len(x) * len(y) > MOST:
        return None
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    ops, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            ops.append(("=", x[i]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            ops.append(("-", x[i]))
            i += 1
        else:
            ops.append(("+", y[j]))
            j += 1
    out = []
    for op, token in ops:
        if out and out[-1]["op"] == op:
            out[-1]["text"] += token
        else:
            out.append({"op": op, "text": token})
    return out


def test_differences_equal_the_table():
    draw = random.Random(2)
    make = lambda n: "".join(draw.choice(["a", "b", "c", "dd", " ", "  ", "\n"]) for _ in range(draw.randint(0, n)))
    for _ in range(1500):
        a, b = make(30), make(30)
        assert differences(a, b) == table(a, b), (a, b)
    assert differences(None, None) == [] and differences(None, "x y") == [{"op": "+", "text": "x y"}]
    many = "a " * 613, "b " * 613  # one more blank than cells allow
    assert differences(*many) is None and differences("a " * 500, "a " * 500) == [{"op": "=", "text": "a " * 500}]


def test_documents_equal_the_table(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in registry.queries()["document_differences"](spark, data).collect()}
    assert set(got) == {k for k in texts if k - 1 in texts}
    tried = 0
    for k in sorted(got):
        sizes = [len(re.findall(r"\s+|\S+", texts[x] or "")) for x in (k - 1, k)]
        assert (got[k].runs is None) == (sizes[0] * sizes[1] > MOST)
        if got[k].runs is not None:
            assert got[k].kept + got[k].removed == len(texts[k - 1] or "") and got[k].kept + got[k].added == len(texts[k] or "")
        if sizes[0] * sizes[1] < 60_000:
            tried += 1
            expected = table(texts[k - 1], texts[k])
            total = lambda op: sum(len(x["text"]) for x in expected if x["op"] == op)  # noqa: E731, B023
            assert (got[k].runs, got[k].kept, got[k].removed, got[k].added) == (len(expected), total("="), total("-"), total("+"))
    assert tried > 20


def test_a_word_against_a_long_text_takes_little_room():
    import tracemalloc

    long = " ".join(f"w{k}" for k in range(15_000))
    tracemalloc.start()
    assert differences("w7", long)[-1]["op"] == "+" and differences(None, long) == [{"op": "+", "text": long}]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000


def test_sizes_are_made_slice_by_slice(spark, monkeypatch):
    import pyarrow as pa

    from weftlens.functions import diff

    monkeypatch.setattr(diff, "SLICE", 10)
    batch = pa.record_batch({"k": list(range(7)), "a": ["a b"] * 6 + [None], "b": ["a c"] * 6 + ["x"]})
    assert [len(s) for s in diff._slices(batch)] == [2, 2, 2, 1]
    rows = spark.createDataFrame([(1, "a b", "a c"), (2, None, None), (3, "a " * 613, "b " * 613), (None, None, "x")], "doc_id int, a string, b string")
    got = [tuple(r) for r in diff.difference_sizes(rows, "doc_id", "a", "b").collect()]
    assert got == [(1, 3, 2, 1, 1), (2, 0, 0, 0, 0), (3, None, None, None, None), (None, 1, 0, 0, 1)]


def test_texts_of_any_length_are_compared(spark, monkeypatch):
    from weftlens.functions import diff

    a, b = " ".join(f"w{k % 977}" for k in range(1500)), " ".join(f"w{k % 983}" for k in range(1500))
    assert differences(a, b) is None
    found = differences(a, b, None)
    take = lambda ops: "".join(r["text"] for r in found if r["op"] in ops)
    assert take("=-") == a and take("=+") == b and len(take("=")) > len(a) // 2
    # Rows that are made again give the same.
    monkeypatch.setattr(diff, "HELD", 4000)
    monkeypatch.setattr(diff, "PARTS", 3)
    assert differences(a, b, None) == found
    draw = random.Random(4)
    make = lambda n: "".join(draw.choice(["a", "b", "c", "dd", " ", "\n"]) for _ in range(draw.randint(0, n)))
    monkeypatch.setattr(diff, "HELD", 40)
    for _ in range(300):
        a, b = make(40), make(40)
        assert differences(a, b) == table(a, b), (a, b)


def test_documents_of_any_length_have_whole_sizes(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.queries()["document_differences"](spark, data).collect()
    assert any(r.runs is None for r in rows)
    for r in rows:
        assert r.whole_kept + r.whole_removed == len(texts[r.doc_id - 1]) and r.whole_kept + r.whole_added == len(texts[r.doc_id])
        assert r.runs is None or (r.runs, r.kept, r.removed, r.added) == (r.whole_runs, r.whole_kept, r.whole_removed, r.whole_added)
