"""Landing, scrubbing, snapshots and the log of runs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.operators import articles, reports
from weftlens.sources import landing, snapshot, store

DAY = dt.date(2026, 1, 1)


def test_scrubbed_rows_have_no_personal_data(spark):
    key = sorted(landing.PERSONAL_KEYS)[0]
    rows = [
        ("fsc.lawreq", "1", "h1", dt.datetime(2024, 1, 2), 200, json.dumps({"list": {key: "지은이", "deep": [{key: {"x": 1}}, {"keep": "가"}]}, "html": "전화 02-1234-5678"}, ensure_ascii=False), dt.datetime(2024, 1, 3)),
        ("lawgo.law", "2", "h2", dt.datetime(2024, 1, 2), 200, '{"mail": "someone@example.com"}', dt.datetime(2024, 1, 3)),
        ("fsc.lawreq", "3", "h3", dt.datetime(2024, 1, 2), 200, '{"clean": 1}', dt.datetime(2024, 1, 3)), ("fsc.lawreq", "4", "h4", dt.datetime(2024, 1, 2), 200, None, None),
    ]
    got = {r.source_key: r for r in landing.scrub(spark.createDataFrame(rows, landing.RAW)).collect()}
    assert json.loads(got["1"].payload) == {"list": {"deep": [{}, {"keep": "가"}]}, "html": f"전화 {T.PHONE_MASK}"}
    # A changed reply is parsed again, a changed statute is not; hashes follow the payload.
    assert got["1"].parsed_at is None and got["2"].parsed_at == dt.datetime(2024, 1, 3) and T.EMAIL_MASK in got["2"].payload
    assert got["1"].content_hash != "h1" and got["2"].content_hash != "h2" and (got["3"].content_hash, got["3"].payload, got["3"].parsed_at) == ("h3", '{"clean": 1}', dt.datetime(2024, 1, 3))
    assert got["4"].payload is None and got["4"].content_hash == "h4"
    again = landing.scrub(landing.scrub(spark.createDataFrame(rows, landing.RAW)))
    assert {(r.source_key, r.payload, r.content_hash) for r in again.collect()} == {(k, r.payload, r.content_hash) for k, r in got.items()}


def test_only_tables_with_relevant_headings(spark):
    import re

    heading = re.sub(r"[()|?:]", " ", landing.TABLE_HEADINGS).split()[0]
    page = f"<p>x</p><TABLE a=1><tr><th>{heading}</th><td>1</td></tr></TABLE><table><tr><td>menu</td></tr></table>"
    cut = lambda x: spark.range(1).select(landing.content_tables(F.lit(x)).alias("x")).first().x
    assert cut(page) == f"<TABLE a=1><tr><th>{heading}</th><td>1</td></tr></TABLE>"
    assert cut("<table><tr><td>menu</td></tr></table>") == "<table><tr><td>menu</td></tr></table>" and cut("plain") == "plain" and cut(None) is None


def test_guidance_rows(spark):
    payload = json.dumps({"title": "지도", "rootDpNm": "위", "dpNm": "아래과", "_stage": "시행", "regDate": "20250102", "eventStartDate": "2025-01-03", "eventEndDate": ""}, ensure_ascii=False)
    rows = spark.createDataFrame([("fsc.guidance", "7", "h", dt.datetime(2025, 1, 1), 200, payload, None), ("fsc.guidance", "8", "h", None, 200, "{}", None), ("fsc.guidance", "9", "h", None, 200, None, None)], landing.RAW)
    got = {r.id: r for r in landing.parse_guidance(rows).collect()}
    one = got["fsc.guidance:7"]
    assert (one.title, one.org, one.stage, one.published_on, one.valid_from, one.valid_to) == ("지도", "위", "시행", dt.date(2025, 1, 2), dt.date(2025, 1, 3), None)
    assert got["fsc.guidance:8"].title is None and got["fsc.guidance:9"].published_on is None


def test_kinds_of_lines(spark):
    lines = {"① 첫": "paragraph", "㉟ 끝": "paragraph", "1. 호": "item", "12의2. 호": "item", "가. 목": "sub_item", "[본조신설 2020. 1. 1.]": "history", "<개정 2020. 1. 1.>": "history", "그냥 글": "text", "": "text"}
    rows = spark.createDataFrame([(k,) for k in lines], "t string").select("t", T.line_kind(F.col("t")).alias("k"))
    assert {r.t: r.k for r in rows.collect()} == lines


def test_runs_are_logged(spark, tmp_path):
    path = str(tmp_path / "runs")
    with landing.logged_run(spark, path, "fetch", "a") as stats:
        stats["rows"] = 3
    with landing.logged_run(spark, path, "fetch", "b") as stats:
        stats["errors"] = 2
    with pytest.raises(KeyError), landing.logged_run(spark, path, "link", "c"):
        raise KeyError("gone")
    got = {r.source: r for r in spark.read.parquet(path).collect()}
    assert [(got[s].status, got[s].stats) for s in "abc"] == [("ok", '{"rows": 3}'), ("partial", '{"errors": 2}'), ("failed", "{}")]
    assert got["c"].error == "KeyError: 'gone'" and all(r.finished_at >= r.started_at for r in got.values())
    runs = spark.read.parquet(path).withColumn("id", F.monotonically_increasing_id())
    assert [r.source for r in reports.recent_runs(runs, 2).collect()] == ["c", "b"]


def test_every_entity_is_read_back_by_its_bytes(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    odd = ["가나", "a b", "tab\there", "line\nbreak", 'quote"s', "\u2028", "", "é😀"]
    rows = [(f"k{k:04d}", k, "본문" * (k % 7)) for k in range(500)] + [(k, -1, None) for k in odd] + [(None, 0, "no key"), ("k0007", 7000, "second")]
    frame = spark.createDataFrame(rows, "name string, n int, body string").repartition(9)
    snapshot.write(frame, path, "name", files=5)
    listed = snapshot.index(spark, path)
    assert listed.count() == 509 and listed.select("file").distinct().count() <= 5
    for key in ["k0000", "k0123", "k0499", *odd]:
        assert snapshot.entity(spark, path, key) == [{"name": r[0], "n": r[1], "body": r[2]} for r in rows if r[0] == key]
    assert {x["n"] for x in snapshot.entity(spark, path, "k0007")} == {7, 7000} and snapshot.entity(spark, path, "nobody") == []


def test_a_snapshot_that_fails_leaves_the_one_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snapshot")
    make = lambda n: spark.range(n).selectExpr("id AS k", "'v' AS v")
    snapshot.write(make(40), path, "k", files=3)
    swap = store.swap

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(store, "swap", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        snapshot.write(make(99), path, "k", files=3)
    monkeypatch.setattr(store, "swap", swap)
    assert snapshot.index(spark, path).count() == 40 and snapshot.entity(spark, path, "39") == [{"k": 39, "v": "v"}] and snapshot.entity(spark, path, "98") == []
    for n in (4000, 5):
        snapshot.write(make(n), path, "k", files=3)
        assert snapshot.index(spark, path).count() == n and snapshot.index(spark, path).select("file").distinct().count() <= 3
    # The torn one and all but the last two are gone.
    assert len([p for p in (tmp_path / "snapshot").iterdir() if p.name.startswith("data-")]) == 2


def test_both_ends_of_a_delegation_exist(spark):
    laws = spark.createDataFrame([("a", "법률", None), ("ad", "시행령", "a"), ("b", "법률", None)], "slug string, kind string, parent string")
    known = spark.createDataFrame([("a:1",), ("a:2",), ("ad:3",)], "key string")
    pairs = spark.createDataFrame([("a", "1", "시행령", "3"), ("a", "2", "시행령", "4"), ("a", "9", "시행령", "3"), ("a", "1", "시행규칙", "3"), ("b", "1", "시행령", "3"), (None, None, None, None)], "from_slug string, from_no string, kind string, to_no string")
    assert [tuple(r) for r in articles.delegation_keys(pairs, laws, known).collect()] == [("a:1", "ad:3")]
