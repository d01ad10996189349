"""The trigram index against a scan of the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlens.operators import gram_index, search

TEXTS = ["alpha beta gamma", "ALPHA Beta", "", None, "al", "제2조의 뜻", "x" * 5000 + "needle" + "y" * 50, "beta beta beta", "aa\u0001bb", "a\U0001f600b tail", "%_\\escape", "common one", "common two", "common 3"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = ["common", "alpha", "beta", "delta", "ep silon", "İstanbul", "ÉTÉ", "日本語"]
    rows = TEXTS + [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 40, 300)]
    return spark.createDataFrame([(k, t, t[:7] if t else None, "odd") for k, t in enumerate(rows)], "id long, body string, title string, base string").repartition(6)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    # Small blocks and folders, so that lists have many parts.
    return gram_index.GramIndex.build(docs, ["title", "body"], str(tmp_path_factory.mktemp("index") / "grams"), buckets=8, parts=3, hot=0.3, block=700)


@pytest.mark.parametrize("term", ["needle", "alpha", "ALPHA B", "common", "nowhere", "al", "%_\\", "뜻", "조의 ", "😀b ", "a\u0001b", "été", "日本語", "x" * 40, "silon alpha", "", "i̇s", "common t"])
def test_terms_equal_a_scan(spark, docs, index, term):
    test = search.has(F.col("body"), term) | search.has(F.col("title"), term)
    found = index.candidates(spark, [term] if term else []).where(test)
    assert found.columns == docs.columns
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in docs.where(test).collect())


def test_search_is_the_same(spark, docs, index):
    for query in ("needle delta", "alpha nowhere", "al beta", "nowhere"):
        whole = search.search(docs, query, "title", "body", "title", "id", limit=400)
        got = search.indexed_search(spark, index, query, "title", "body", "title", "id", limit=400)
        assert got["items"].collect() == whole["items"].collect()
        assert sorted(map(str, got["facets"].collect())) == sorted(map(str, whole["facets"].collect()))


def test_only_the_folders_of_the_grams_are_read(spark, index):
    grams = gram_index.grams_of("needle")
    plan = index.lists(spark, grams)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [In(gram" in plan
    rows = index.candidates(spark, ["needle"])
    plan = rows._jdf.queryExecution().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows.count() == 1  # the rarest grams of this term are together in one row only


def test_hot_grams_have_no_lists(spark, docs, index):
    hot = index.lists(spark, gram_index.grams_of("common"))
    assert hot.where("ids IS NULL AND df > 90").count() > 0 and hot.where("ids IS NULL").groupBy("gram").count().where("count > 1").count() == 0
    assert index.numbers(spark, "common") is None or index.rows > 0


def test_an_index_of_nothing(spark, docs, tmp_path):
    empty = gram_index.GramIndex.build(docs.limit(0), ["body"], str(tmp_path / "grams"))
    assert empty.rows == 0 and empty.candidates(spark, ["alpha"]).count() == 0


def test_lists_are_coded_in_few_bytes():
    gram = np.array([5, 5, 5, 9, 9, 5])
    row = np.array([10, 11, 400, 10, 70_000, 10])
    got = {r["gram"]: r for r in gram_index._lists(gram, row).to_pylist()}
    assert (got[5]["n"], got[5]["width"], len(got[5]["ids"])) == (3, 2, 6) and (got[9]["width"], got[9]["n"]) == (4, 2)
