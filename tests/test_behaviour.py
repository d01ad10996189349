"""Invariants of the store, text functions and incremental runs that SQL does not show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.functions import trigram
from weftlens.functions.diff import differences
from weftlens.operators import articles, citations, joins
from weftlens.sources import landing, store
from weftlens.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("제 2 조 의 4", "제2조의4"), ("14조2에", "14조의2에"), ("同法 제 7 조", "동법 제7조"), ("｢가나법｣", "「가나법」"), ("제4 - 20 조", "제4-20조"), ("「 가나법 」( 이하 )", "「가나법」(이하)"),
    ],
)
def test_citation_copy(spark, raw, clean):
    assert one(spark, T.for_citation(F.lit(raw))) == clean


def test_numbers(spark):
    assert [one(spark, T.article_no(F.lit(x))) for x in ("제25조의2", "제4-20조", "23조", "없음")] == ["25의2", "4-20", "23", None]
    assert one(spark, T.article_label(F.lit("25의2"))) == "제25조의2"
    order = [one(spark, T.natural_order(F.lit(x))) for x in ("4-20", "4-21", "5", "25", "25의2", "26")]
    assert order == sorted(order) and len(set(order)) == 6


def test_personal_data_goes(spark):
    text = "보험과(02-1234-5678) 김가나 사무관에게, 담당 사무관은 x.y@example.org 로. 일반사무관리회사 2020-1234"
    out = one(spark, T.redact(F.lit(text)))
    assert "5678" not in out and "example" not in out and "김가나" not in out
    assert "담당 사무관은" in out and "일반사무관리회사" in out and "○○○ 사무관" in out
    bare = one(spark, landing.without_personal(F.lit('{"regId":"a","x":{"담당자":"b","y":1},"regNm":"c"}')))
    assert bare.replace(" ", "") == '{"x":{"y":1}}'
    deep = '{"담당자":{"이름":"b","전화":["1"]},"list":[{"regNm":["c",{"d":1}],"제목":"가"},["담당자"]]}'
    assert one(spark, landing.without_personal(F.lit(deep))) == '{"list": [{"제목": "가"}, ["담당자"]]}'
    for same in ('{"title": "x",  "n":1}', "no JSON 담당자", "", None):
        assert one(spark, landing.without_personal(F.lit(same).cast("string"))) == same


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("(02-1234-5678)", "(연락처 생략)"), ("+1 (091) 555-3384", "+1 (연락처 생략"), ("1588-1234", "연락처 생략"), ("1.588-1234", "1.588-1234"), ("21588-1234", "21588-1234"), ("(2156-9834)", "(연락처 생략)"), ("(2020-1234)", "(2020-1234)"),
        ("a.b@c.example", "이메일 생략"), ("다람쥐 사무관과", "○○○ 사무관과"), ("소관 사무관", "소관 사무관"), ("주무관청", "주무관청"), ("", ""), (None, None),
    ],
)
def test_masks(spark, raw, clean):
    assert one(spark, T.redact(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("<p>a&hellip;&#44032;&#xAC01;&eacute;&copy b</p>c", "a…가각é© b\nc"), ("x<script>1 < 2</script >y", "x1 y"), ("<STYLE a='b'>q</STYLE>&amp;lt;", "&lt;"), ("a&nbsp; &#8203;b<br/>\n\n<h2>t</h2>u", "a b\nt\nu"), ("&unknown; & 1", "&unknown; & 1"), (None, ""),
    ],
)
def test_pages_to_text(spark, raw, clean):
    assert one(spark, T.html_to_text(F.lit(raw).cast("string"))) == clean


def test_rows_upserted_by_hash(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    first = store.upsert_by_hash(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([], "k int, v string, digest string, first_seen_at timestamp, changed_at timestamp"), "k", F.lit(day(1)))
    assert {r.state for r in first.collect()} == {"new"}
    again = store.upsert_by_hash(spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string"), first.drop("state"), "k", F.lit(day(2)))
    assert {(r.k, r.v, r.first_seen_at.day, r.changed_at.day, r.state) for r in again.collect()} == {(1, "a", 1, 1, "same"), (2, "c", 1, 2, "changed"), (3, None, 1, 1, "kept"), (4, "d", 2, 2, "new")}


def test_replaced_links_keep_reviewed_ones(spark):
    shape = "d string, t string, reviewed boolean, evidence string"
    old = spark.createDataFrame([("1", "a", True, "x"), ("1", "b", False, "x"), ("2", "b", False, "x")], shape)
    new = spark.createDataFrame([("1", "a", False, "y"), ("1", "c", False, "z" * 400), ("1", "q", False, "lost")], shape)
    kept, lost = store.replace_per_key(old, new, "d", "reviewed", "t", spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), evidence="evidence")
    assert {(r.d, r.t, r.reviewed, len(r.evidence)) for r in kept.collect()} == {("1", "a", True, 1), ("2", "b", False, 1), ("1", "c", False, 300)}
    assert [(r.t, r.evidence, r.reason) for r in lost.collect()] == [("q", "lost", "article_not_loaded")]


def test_small_functions(spark):
    assert abs(one(spark, trigram.similarity(F.lit("word"), F.lit("two words"))) - 4 / 11) < 1e-9
    assert one(spark, trigram.similarity(F.lit(None).cast("string"), F.lit(""))) == 0
    assert one(spark, T.department(F.lit("금융과, 은행팀 / 시장국"))) == "금융과"
    assert one(spark, T.ymd(F.lit("2024. 01.02"))) == dt.date(2024, 1, 2) and one(spark, T.ymd(F.lit(""))) is None
    assert one(spark, articles.circled(F.lit("<16> 본문"))) == "⑯ 본문" and one(spark, articles.circled(F.lit("<36> 본문"))) == "<36> 본문"
    assert one(spark, T.substance(F.lit("가 나 <개정 2020>[신설]“다”"))) == '가나"다"'
    assert differences("a b", "a b") == [{"op": "=", "text": "a b"}] and differences("a " * 2000, "b " * 2000) is None


def test_store_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (3, None)], "k int, v string")
    assert store.new_rows(new, old, ["k"]).count() == 1
    state = store.upsert(new.distinct(), old, "k", ["v"])
    assert sorted(map(tuple, state.collect())) == [(1, "a"), (2, "c"), (3, None)]
    assert store.new_rows(new, state, ["k"]).count() == 0
    assert sorted(map(tuple, store.upsert(new.distinct(), state, "k", ["v"]).collect())) == [(1, "a"), (2, "c"), (3, None)]


def test_state_is_swapped(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (3, 5):
        store.swap(spark.range(n).toDF("k"), path)
        assert store.current(spark, path).count() == n
    before = store.current(spark, path)
    store.swap(before.where("k < 2"), path)
    assert store.current(spark, path).count() == 2 and before.count() == 5
    # A run that stops before the pointer moves leaves the state as it was.
    spark.range(9).toDF("k").write.parquet(f"{path}/version-torn")
    assert store.current(spark, path).count() == 2


def test_expansion_keeps_directions_apart(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("z", "a"), ("z", "y"), ("d", "a")], "src string, dst string")
    found = joins.expand(edges, spark.createDataFrame([("b",)], "node string"), 2)
    assert {tuple(r) for r in found.collect()} == {("b", "d"), ("d", "a"), ("a", "b"), ("z", "a")}


def test_a_row_that_is_missing_has_a_name(spark):
    assert joins.only(spark.range(1), "article").id == 0
    with pytest.raises(LookupError, match="article"):
        joins.only(spark.range(0), "article")


def test_duplicate_laws_and_articles_do_not_stop_resolution(spark):
    laws = spark.createDataFrame([("a", "가나금융업법", "법률", None, []), ("a", "가나금융업법", "법률", None, []), ("x", "가나 시행령", "시행령", "a", []), ("y", "가나 시행령 둘", "시행령", "a", [])], "slug string, name string, kind string, parent string, aliases array<string>")
    known = spark.createDataFrame([("a", "1", "가"), ("a", "1", None), ("y", "2", None)], "slug string, no string, title string")
    docs = spark.createDataFrame([(1, ["「가나금융업법」 제1조와 같은 법 시행령 제2조"], None, None), (2, None, None, None), (3, [], None, None), (4, [None, "조"], None, None)], "doc_id long, segments array<string>, hint_law string, fallback_law string")
    got = citations.resolve(docs, laws, known)
    assert sorted((r.doc_id, r.slug, r.no, r.method) for r in got["links"].collect()) == [(1, "a", "1", "explicit"), (1, "y", "2", "same_law")]
    assert {r.doc_id for r in got["primary"].collect()} == {1, 2, 3, 4}


def resolved(spark, *texts):
    laws = [("a", "가나금융업법", "법률", None, ["가나법"]), ("ad", "가나금융업법 시행령", "시행령", "a", []), ("s", "나라지역발전특별법", "법률", None, [])]
    laws = spark.createDataFrame(laws, "slug string, name string, kind string, parent string, aliases array<string>")
    known = spark.createDataFrame([(slug, str(no), None) for slug in ("a", "ad", "s") for no in range(1, 10)], "slug string, no string, title string")
    docs = spark.createDataFrame([(k, [t], None, "a") for k, t in enumerate(texts)], "doc_id int, segments array<string>, hint_law string, fallback_law string")
    got = citations.resolve(docs, laws, known)
    links, lost = ([[] for _ in texts] for _ in range(2))
    for r in got["links"].orderBy("slug", "no").collect():
        links[r.doc_id].append((r.slug, r.no, r.method))
    for r in got["unresolved"].orderBy("raw").collect():
        lost[r.doc_id].append(r.reason)
    return list(zip(links, lost, strict=True))


def test_laws_with_common_endings_are_laws(spark):
    """Words such as 특별법 are no law by themselves, but laws may end in them."""
    found = resolved(
        spark, "모르는지역균형특별법 제5조", "모르는지역진흥법 제5조", "나라지역발전특별법은 있다 그 제5조를 본다", "새로운현행법 제3조에 따른다", "여러 방법 제3조", "특별법을 본다. 제4조는 다르다",
        "처리방법은 제2조에 있다", "본법 제2조", "어느 법률 제2조", "새관계법은 있다. 그리고 제3조",
    )
    assert found[0] == ([], ["unknown_law"]) and found[1] == ([], ["unknown_law"])
    assert found[2] == ([("s", "5", "inferred")], [])
    assert found[3] == ([], ["unknown_law"])
    assert found[5] == ([("a", "4", "inferred")], []) and found[6] == ([("a", "2", "inferred")], [])
    assert found[7] == ([("a", "2", "this_law")], [])
    assert found[8] == ([], ["unknown_law"])
    assert found[9] == ([], ["unknown_law"])


def test_places_of_matches_do_not_depend_on_a_sentinel(spark):
    from weftlens.functions import text as T

    texts = ["a\u0001b 12 c", "12", "", None, "x1\u0001\u000122", "\U0001f600 7 é 8"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.spans(F.col("t"), r"(?:\d)+").alias("x")).orderBy("k").collect()
    got = [None if r.x is None else [(x.s, x.e, x.m) for x in r.x] for r in found]
    assert got == [[(4, 6, "12")], [(0, 2, "12")], [], None, [(1, 2, "1"), (4, 6, "22")], [(2, 3, "7"), (6, 7, "8")]]


def test_lines_of_articles_read_back_the_same(spark):
    lines = ["제1장 총칙", "제1조(가) 하나", "1. 호", "제2장 둘", "제2조(나) 둘", "[시행일: 2026. 12. 17.] 제2조"]
    found = articles.split_articles(spark.createDataFrame([(1, lines)], "doc_id long, lines array<string>"))
    back = articles.snapshot_lines(found)
    assert back.first().lines == lines
    again = articles.split_articles(back)
    assert {tuple(r) for r in again.drop("place").collect()} == {tuple(r) for r in found.drop("place").collect()}


def test_a_query_that_cites_jumps_to_the_article(spark):
    from weftlens.operators import search

    t = {
        "laws": spark.createDataFrame([("a", "가나금융업법", "법률", None, ["가나법"])], "slug string, name string, kind string, parent string, aliases array<string>"),
        "articles": spark.createDataFrame([("a:2", "a", "2", "제2조", "정의"), ("a:3", "a", "3", "제3조", "허가")], "key string, slug string, no string, label string, title string"),
    }
    assert [r.key for r in search.jump(t, "가나법 제3조").collect()] == ["a:3"]
    assert search.jump(t, "가나법 정의").count() == search.jump(t, "모르는법 제3조").count() == 0


@pytest.mark.parametrize(("docs", "items"), [(7, 8), (7, 2), (3, 8), (1, 1), (500, 8)])
def test_cooccurrence_takes_every_line(spark, monkeypatch, docs, items):
    import random
    from collections import Counter, defaultdict

    from weftlens.plans import registry

    queries = registry.queries()
    assert "cooccurrence_all" in queries
    draw = random.Random(3)
    # Item 0 is in most docs, several times in some; the bounds are so low that many items are heavy.
    lines = [(d, i, str(i)) for d in range(60) for i in [0] * draw.randint(0, 3) + [draw.randint(1, 9) for _ in range(4)]]
    lines += [(None, 0, "0"), (61, None, None)]
    monkeypatch.setattr(joins, "HEAVY_DOCS", docs)
    monkeypatch.setattr(joins, "HEAVY_ITEMS", items)
    found = defaultdict(list)
    for r in sorted(joins.cooccurrence(spark.createDataFrame(lines, "d long, i long, l string"), "d", "i", 6, "l").collect(), key=lambda r: (r.d, -r.shared, r.other)):
        found[r.d].append((r.other, r.shared, r.labels))
    shared, labels = Counter(), defaultdict(set)
    for d, i, l in lines:
        for e, j, _ in lines:
            if d is not None and e is not None and i is not None and i == j and d != e:
                shared[d, e] += 1
                labels[d, e].add(l)
    expected = {d: [(e, n, ",".join(sorted(labels[d, e]))) for (_, e), n in sorted(((k, n) for k, n in shared.items() if k[0] == d), key=lambda x: (-x[1], x[0][1]))[:6]] for d in {k[0] for k in shared}}
    assert dict(found) == expected


def test_cooccurrence_of_items_that_very_many_share(spark):
    """Two items of 100,000 and 50,000 docs, which would make 6 billion pairs: the best are those with both, then the smallest."""
    rows = spark.range(100_000).selectExpr("id AS d", "explode(if(id % 2 = 0, array('all', 'even'), array('all'))) AS i").withColumn("l", F.col("i"))
    found = {}
    for r in joins.cooccurrence(rows, "d", "i", 3, "l").where("d < 5 OR d > 99996").collect():
        found.setdefault(r.d, set()).add((r.other, r.shared, r.labels))
    odd, even = {(0, 1, "all"), (1, 1, "all"), (2, 1, "all")}, {(0, 2, "all,even"), (2, 2, "all,even"), (4, 2, "all,even")}
    assert found[99997] == found[99999] == odd and found[99998] == even
    assert found[1] == {(0, 1, "all"), (2, 1, "all"), (3, 1, "all")} and found[0] == {(2, 2, "all,even"), (4, 2, "all,even"), (6, 2, "all,even")}
    assert found[2] == {(0, 2, "all,even"), (4, 2, "all,even"), (6, 2, "all,even")} and len(found) == 8


def test_enum_order_has_every_row_in_order(spark):
    from weftlens.plans import registry

    data = "/root/testdata/sf0.001"
    found = [tuple(r) for r in registry.queries()["enum_order_all"](spark, data).collect()]
    rows = [(r.o_orderkey, {"P": 1, "O": 2}.get(r.o_orderstatus), r.o_totalprice > 200000) for r in spark.read.parquet(f"{data}/orders.parquet").collect()]
    assert found == sorted(rows, key=lambda r: (r[1] or 3, not r[2], r[0]))
    assert {r[1] for r in found} == {1, 2, None}


def test_replies_are_parsed(spark):
    body = '{"list":{"dataIdx":"1","title":"제목","replyRegDate":""},"html":"<table><tr><th>담당부서</th><td>금융과</td></tr><tr><th>회답</th><td>된다</td></tr></table><a>240102_회신.hwp</a>"}'
    raw = spark.createDataFrame([("fsc.reply", "1", "h", None, 200, body, None)], landing.RAW)
    row = landing.parse_replies(raw).first()
    assert (row.id, row.dept, row.answer, row.published_on, row.search_text) == ("fsc.reply:1", "금융과", "된다", dt.date(2024, 1, 2), "제목  된다 ")
    assert landing.land(raw, raw.limit(0)).count() == 1
    hashed = landing.land(raw, raw.limit(0))
    assert landing.land(raw, hashed).count() == 0
    assert landing.unparsed(landing.mark_parsed(hashed, hashed, F.current_timestamp())).count() == 0


def test_raw_layer_travels(spark, tmp_path):
    raw = spark.createDataFrame([("s", "k", "h", dt.datetime(2024, 1, 2), 200, "{}", None)], landing.RAW)
    landing.dump(raw, str(tmp_path / "raw"))
    assert landing.load(spark, str(tmp_path / "raw")).collect() == raw.collect()


def test_late_and_repeated_rows(spark, tmp_path):
    schema = spark.range(0).toDF("k").schema
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k, (lo, hi) in enumerate([(0, 5), (3, 9), (0, 2)]):
        spark.range(lo, hi).toDF("k").write.mode("append").parquet(source)
        incremental.append_new(spark, source, schema, target, str(tmp_path / "checkpoint"), ["k"])
        assert spark.read.parquet(target).count() == [5, 9, 9][k]


def test_history_that_lay_there_before_is_known(spark, tmp_path):
    """A fresh checkpoint learns the target's keys, null ones and those of plain files included, and reads them no more."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, g string, v string"
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1)
    shape = make([]).schema
    make([(1, "a", "old"), (None, None, "old"), (2, None, "old")]).write.parquet(target)
    take = lambda at: incremental.append_new(spark, source, shape, target, str(tmp_path / at), ["k", "g"])
    make([(1, "a", "new"), (1, "b", "new"), (None, None, "new"), (2, None, "new"), (3, "a", "new")]).write.mode("append").parquet(source)
    take("one")
    rows = lambda: sorted(map(str, map(tuple, incremental.read_appended(spark, target, shape).collect())))
    assert rows() == sorted(map(str, [(1, "a", "old"), (None, None, "old"), (2, None, "old"), (1, "b", "new"), (3, "a", "new")]))
    make([(4, "a", "x"), (3, "a", "x")]).write.mode("append").parquet(source)
    take("one")
    assert len(rows()) == 6
    take("two")  # another checkpoint takes all files again and adds nothing
    assert len(rows()) == 6
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != incremental.STATE_STORE


def test_a_batch_that_fails_midway_is_not_there_twice(spark, tmp_path, monkeypatch):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = spark.range(0).toDF("k").schema
    take = lambda: incremental.append_new(spark, source, schema, target, checkpoint, ["k"])
    spark.range(0, 5).toDF("k").write.parquet(source)
    take()
    spark.range(3, 9).toDF("k").write.mode("append").parquet(source)
    from pyspark.sql.readwriter import DataFrameWriter

    whole = DataFrameWriter.parquet

    def torn(self, path, *args, **kwargs):
        whole(self, path, *args, **kwargs)
        raise RuntimeError("stopped after the write, before the commit")

    monkeypatch.setattr(DataFrameWriter, "parquet", torn)
    with pytest.raises(Exception, match="stopped after"):
        take()
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    assert incremental.read_appended(spark, target, schema).count() == 9
    take()
    assert sorted(r.k for r in incremental.read_appended(spark, target, schema).collect()) == list(range(9))


def test_a_run_reads_what_is_new(spark, tmp_path):
    """The rows that a batch takes in are those of new files: neither the target nor its keys are read again."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = spark.range(0).toDF("k").schema
    spark.range(0, 5000).toDF("k").write.parquet(target)
    taken = []
    for lo in (4990, 5005, 5015):
        spark.range(lo, lo + 20).toDF("k").write.mode("append").parquet(source)
        incremental.append_new(spark, source, schema, target, checkpoint, ["k"])
        commits = sorted((tmp_path / "checkpoint" / "commits").iterdir(), key=lambda p: p.name)
        taken.append(len([c for c in commits if not c.name.startswith(".")]))
    assert incremental.read_appended(spark, target, schema).count() == 5035 and taken == [1, 2, 3]
    sizes = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "out").glob("batch=*-*"), key=lambda p: int(p.name.split("-")[1]))]
    assert sizes == [10, 15, 10]


def test_windows_drop_late_rows(spark, tmp_path):
    """Tumbling windows on a stream of three files: a row later than the watermark is not counted any more."""
    schema = "ts timestamp, kind string"
    rows = [[("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "b")], [("2024-01-01 01:00:00", "a")], [("2024-01-01 00:02:00", "a"), ("2024-01-01 01:01:00", "a")]]
    source = str(tmp_path / "in")
    for part in rows:
        spark.createDataFrame(part, "ts string, kind string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "kind").coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(schema).parquet(source)
        query = incremental.windowed_counts(read, "ts", "kind", "5 minutes", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 1)]
    table = spark.read.schema(schema).parquet(source)
    assert sorted((r.start.hour, r.kind, r.n) for r in incremental.windowed_counts(table, "ts", "kind", "5 minutes", "10 minutes").collect()) == [(0, "a", 2), (0, "b", 1), (1, "a", 2)]


def test_llm_is_not_needed():
    import pathlib

    for path in pathlib.Path(store.__file__).parents[1].rglob("*.py"):
        if "llm" not in path.parts:
            assert "weftlens.llm" not in path.read_text()


def test_cooccurrence_does_not_pair_all_docs_of_a_light_item(spark):
    lines = spark.range(400).selectExpr("id AS d", "1 AS i", "1L AS _n", "1 AS _no").unionByName(spark.range(2).selectExpr("id AS d", "2 AS i", "3L AS _n", "2 AS _no"))
    pairs, _ = joins._light_pairs(lines, None, "d", "i", 3)
    rows = pairs.collect()
    assert len(rows) <= 400 * 4  # all pairs: 159,600
    assert {(r.d, r.other): r.shared for r in rows if r.d < 2 and r.other < 2} == {(0, 1): 10, (1, 0): 10}
    assert {r.other for r in rows if r.d == 399} == {0, 1, 2, 3}


@pytest.mark.parametrize("narrow", [0, 1, 2, 16])
def test_cooccurrence_of_wide_docs_equals_all_pairs(spark, monkeypatch, narrow):
    import random

    monkeypatch.setattr(joins, "NARROW_ITEMS", narrow)
    monkeypatch.setattr(joins, "HEAVY_DOCS", 9)
    draw = random.Random(narrow)
    lines = [(draw.randrange(40), min(int(draw.paretovariate(0.6)), 30), f"l{draw.randrange(3)}") for _ in range(300)]
    got = {(r.d, r.other): (r.shared, r.labels) for r in joins.cooccurrence(spark.createDataFrame(lines, "d long, i long, l string"), "d", "i", 4, "l").collect()}
    expected = {}
    for d in {x[0] for x in lines}:
        found = {}
        for o in {x[0] for x in lines} - {d}:
            both = [(a, b) for a in lines for b in lines if a[0] == d and b[0] == o and a[1] == b[1]]
            if both:
                found[o] = len(both), ",".join(sorted({a[2] for a, _ in both}))
        expected |= {(d, o): v for o, v in sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:4]}
    assert got == expected


def test_only_segments_with_articles_or_definitions_are_looked_through(spark):
    cases = [["a 1 (b)", "제 3 조"], ["( 이하 x", "b ( c )"], [None, "", "​", "同條 제 2 항"], ["『x』 ( y )"]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, s array<string>")
    both = rows.orderBy("k").select(citations._copies(F.col("s")).alias("got"), F.filter(F.transform("s", T.for_citation), lambda x: x != "").alias("whole")).collect()
    assert both[0].got == ["a 1 (b)", "제3조"] and both[1].got == both[1].whole and both[2].got[1] == both[2].whole[1] and len(both[2].got) == 2
    assert both[3].got == ["「x」 ( y )"] and [len(r.got) for r in both] == [len(r.whole) for r in both]


@pytest.mark.parametrize(("passes", "heavy"), [(3, 500), (2, 9)])
def test_cooccurrence_in_passes_equals_all_pairs(spark, monkeypatch, passes, heavy):
    import random

    draw = random.Random(passes)
    # Two docs are wide; some lines come several times, and some items have several labels or none.
    lines = [(f"d{draw.randrange(50)}", draw.randrange(60), draw.choice(["l1", "l2", None, "7"])) for _ in range(250)] + [(d, i, str(i)) for d in ("w1", "w2") for i in range(0, 60, 2)]
    monkeypatch.setattr(joins, "PASS_ROWS", -(-len(lines) // passes))
    monkeypatch.setattr(joins, "HEAVY_DOCS", heavy)
    got = {(r.d, r.other): (r.shared, r.labels) for r in joins.cooccurrence(spark.createDataFrame(lines, "d string, i int, l string"), "d", "i", 5, "l").collect()}
    expected = {}
    for d in {x[0] for x in lines}:
        found = {}
        for o in {x[0] for x in lines} - {d}:
            both = [a for a in lines for b in lines if a[0] == d and b[0] == o and a[1] == b[1]]
            if both:
                found[o] = len(both), ",".join(sorted({a[2] for a in both if a[2] is not None}))
        expected |= {(d, o): v for o, v in sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:5]}
    assert got == expected


def test_cooccurrence_leaves_no_shuffles_and_no_tables_of_its_own(spark, monkeypatch):
    import time

    made, store = [], joins.shared.store
    monkeypatch.setattr(joins.shared, "store", lambda df, name, *a: made.append(store(df, name, *a)) or made[-1])
    blocks = lambda: sum("shuffle_" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|"))
    before = blocks()
    rows = spark.range(4000).selectExpr("id DIV 4 AS d", "id * 7919 % 500 AS i", "string(id * 7919 % 500) AS l")
    found = joins.cooccurrence(rows, "d", "i", 6, "l")
    until = time.time() + 20
    while blocks() > before and time.time() < until:
        time.sleep(0.2)
    assert blocks() <= before
    # Only results are left.
    left = [f._weft_path.rsplit("/", 1)[1] for f in made if joins.shared.exists(spark, f._weft_path)]
    assert left and all(x.startswith("best-pairs") for x in left) and found.count() > 0
