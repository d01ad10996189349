"""Figures kept by signed deltas against a rebuild of all of them."""

import datetime as dt
import random

import pytest

from weftlens.operators import cards
from weftlens.sources.maintained import ArticleStats

LINKS, DOCS = "key string, doc_id string", "id string, kind string, published_on date"
SIGNED, CHANGED = f"{LINKS}, sign int", f"{DOCS}, gone boolean"
KINDS = ["법령해석", "비조치의견", "행정지도", "입법예고", "규정변경예고", "현장건의", None]


def rows(frame):
    return sorted(map(str, map(tuple, frame.collect())))


def rebuilt(spark, links, docs):
    found = spark.createDataFrame(links, LINKS)
    return rows(cards.article_stats(found, spark.createDataFrame([(k, *v) for k, v in docs.items()], DOCS)))


def test_changes_equal_a_rebuild(spark, tmp_path):
    draw = random.Random(4)
    day = lambda: draw.choice([None, dt.date(2024, 1, 1) + dt.timedelta(draw.randint(0, 300))])
    docs = {f"d{k}": (draw.choice(KINDS), day()) for k in range(60)}
    pick = lambda: (f"a:{draw.randint(0, 30)}", f"d{draw.randint(0, 69)}")
    links = [pick() for _ in range(200)] + [("hot:1", f"d{k}") for k in range(60)]
    stats = ArticleStats(str(tmp_path / "stats"), buckets=16)
    stats.build(spark.createDataFrame(links, LINKS), spark.createDataFrame([(k, *v) for k, v in docs.items()], DOCS))
    assert rows(stats.stats(spark)) == rebuilt(spark, links, docs)
    for batch in range(4):
        came, went = [pick() for _ in range(12)], draw.sample(links, 12)
        if batch == 1:  # all but three of the hot article's links, and one document's only link twice
            went, came = [x for x in links if x[0] == "hot:1"][:-3], [("new:1", "d1"), ("new:1", "d1")]
        changed = [(f"d{draw.randint(0, 75)}", draw.choice(KINDS), day(), draw.random() < 0.3) for _ in range(6)] if batch != 3 else []
        changed = list({c[0]: c for c in changed}.values())
        for x in went:
            links.remove(x)
        links += came
        for doc, kind, on, gone in changed:
            docs.pop(doc, None)
            if not gone:
                docs[doc] = (kind, on)
        signed = [(*x, 1) for x in came] + [(*x, -1) for x in went] + [(None, "d1", 1), ("a:1", None, -1)]
        now = spark.createDataFrame([(k, *v) for k, v in docs.items()], DOCS)
        args = spark.createDataFrame(signed, SIGNED), spark.createDataFrame([*changed, (None, None, None, None)], CHANGED), now, f"batch-{batch}"
        assert stats.apply(*args)
        expected = rebuilt(spark, links, docs)
        assert rows(stats.stats(spark)) == expected
        assert not stats.apply(*args) and rows(stats.stats(spark)) == expected  # the same batch again changes nothing


def test_untouched_folders_stay(spark, tmp_path, monkeypatch):
    links = [(f"a:{k}", f"d{k % 40}") for k in range(400)]
    docs = spark.createDataFrame([(f"d{k}", "법령해석", dt.date(2024, 1, 1 + k % 28)) for k in range(40)], DOCS)
    stats = ArticleStats(str(tmp_path / "stats"), buckets=32)
    stats.build(spark.createDataFrame(links, LINKS), docs)
    before, none = stats.folders(spark), spark.createDataFrame([], CHANGED)
    change = spark.createDataFrame([("a:7", "d7", -1), ("a:7", "d9", 1)], SIGNED)
    figures = rows(stats.stats(spark))
    # A run that stops before the manifest moves leaves all as it was, and can be run again.
    from weftlens.sources import store

    swap = store.swap

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(store, "swap", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        stats.apply(change, none, docs, "one")
    monkeypatch.setattr(store, "swap", swap)
    assert stats.folders(spark) == before and rows(stats.stats(spark)) == figures
    assert stats.apply(change, none, docs, "one")
    after = stats.folders(spark)
    moved = {k for k in after if after[k] != before[k]}
    assert sorted(name for name, _ in moved) in (["docs", "docs", "pairs", "stats"], ["docs", "pairs", "stats"])
    assert [r.latest_on.day for r in stats.stats(spark).where("key = 'a:7'").collect()] == [10]
    # Nothing but the touched folders is read.
    assert len(stats._read(spark, "pairs", [next(b for n, b in moved if n == "pairs")]).inputFiles()) == 1
    assert stats.apply(spark.createDataFrame([], SIGNED), none, docs, "two") and stats.folders(spark) == after
    assert stats.apply(spark.createDataFrame([("a:7", "d9", -1)], SIGNED), none, docs, "three") and stats.stats(spark).where("key = 'a:7'").count() == 0
