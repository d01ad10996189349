"""Each stage works on all that its predecessor kept."""

import corpus_pipeline
from weftlens.llm import scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.store(stage(spark, docs, DATA), "stage")
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids
        if name == "packing":
            assert now == ids
        else:
            assert docs.columns == names
        ids = now
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert not [d for d in ids if d in labels and labels[d].quality == 0]


def test_repeated_passages_of_over_50_words_go(spark):
    import random

    draw = random.Random(7)
    # Five letters and a blank a word: 51 words are 305 bytes, less than 400.
    prose = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passages = {n: prose(n) for n in (45, 51, 55, 60)}
    rows, k = [], 0
    for p in passages.values():
        for _ in range(2):
            rows.append((k, f"{prose(30)} {p} {prose(30)}"))
            k += 1
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, DATA).collect()}
    assert len(found) == len(rows)
    for k, t in rows:
        n = [45, 51, 55, 60][k // 2]
        assert found[k].n_chars == len(found[k].text)
        if n == 45:
            assert found[k].text == t
        else:
            assert passages[n] not in found[k].text and len(found[k].text.split()) <= 62
            assert found[k].text[:178] == t[:178] and found[k].text[-178:] == t[-178:]


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, extra columns with the operators' own names: rows come out whole."""
    extra = ["row", "doc", "starts", "score", "predicted", "good", "place", "rank", "class_id", "label", "_label", "_row", "_kept", "kept", "sig"]
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (3, None, "en", "s", None), (4, "", None, "s", 0), (None, "no id at all", "en", None, 3), (None, None, None, None, None), (5, "x" * 300_000, "en", "s", 300_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in extra)) for k, r in enumerate(rows)], schema)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        for r in got.collect():
            k = int(r.row[3:])
            assert all(r[c] == f"{c}{k}" for c in extra) and (r.doc_id, r.lang, r.source) == (rows[k][0], *rows[k][2:4])
            assert r.text == rows[k][1] or name == "suffix-array"
        kept = [int(r.row[3:]) for r in got.collect()]
        assert sorted(kept) == list(range(8)) or name == "near-duplicates"
        if name == "near-duplicates":
            # One row of 1 and 2, one of the two without text; rows without an id stay.
            assert sorted(rows[k][0] or 0 for k in kept) == [0, 0, 1, 3, 5]
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 2, 3, 4, 5, None} and corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0
