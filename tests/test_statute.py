"""Statute payloads, cards and the graph on invented text."""

import datetime as dt
import json

from pyspark.sql import functions as F

from weftlens.functions import statute
from weftlens.operators import articles, cards

TODAY = dt.date(2026, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_items_follow_their_numbers(spark):
    cut = lambda x: one(spark, statute.item_lines(F.lit(x)))
    assert cut('다음과 같다.1. "전산실"이란 방이다.2. 둘째(2013. 12. 3. 개정)2의2. 끼움3. 셋째') == ["다음과 같다.", '1. "전산실"이란 방이다.', "2. 둘째(2013. 12. 3. 개정)", "2의2. 끼움", "3. 셋째"]
    assert cut("① 하나 ② 둘") == ["① 하나", "② 둘"]
    assert cut("1. 첫째가. 하나나. 둘 다. 셋2. 둘째가. 다시") == ["1. 첫째", "가. 하나", "나. 둘 다. 셋", "2. 둘째", "가. 다시"]
    assert cut("앞 <16> 열여섯 제① 인용") == ["앞", "⑯ 열여섯 제① 인용"]
    assert cut("나. 번호 없이 3. 셋") == ["나. 번호 없이 3. 셋"] and cut("") == []


def test_headings_are_cut(spark):
    cut = lambda x: one(spark, statute.heading_lines(F.lit(x)))
    text = "제1장 총칙 제1-1조(목적) 이 규정은 정한다.<개정 2013. 9. 17.>제1-2조(정의) 제1-1조(목적)에 따른 것. 제2장 업무 제2-1조(범위) 넓다."
    assert cut(text) == ["제1장 총칙", "제1-1조(목적) 이 규정은 정한다.<개정 2013. 9. 17.>", "제1-2조(정의) 제1-1조(목적)에 따른 것.", "제2장 업무", "제2-1조(범위) 넓다."]
    assert cut("제1편 첫 제1장 가 제1조(가) 나. 제2조의2(나) 제1조(가) 다. 제3장 없음 제2장 둘 제3조(다) 라.") == ["제1편 첫", "제1장 가", "제1조(가) 나.", "제2조의2(나) 제1조(가) 다.", "제3장 없음", "제2장 둘", "제3조(다) 라."]
    assert cut("제목 없음") == ["제목 없음"]


def test_marks_in_a_text_are_only_marks(spark):
    """A control character is a character; a hundred thousand candidates take no time that grows with their square."""
    assert statute.cut_items("앞\u0001말.1. 하나\u00012. 둘") == ["앞\u0001말.", "1. 하나\u0001", "2. 둘"]
    assert statute.cut_headings("제1조(가) 나\u0001다.제2조(나) 라") == ["제1조(가) 나\u0001다.", "제2조(나) 라"]
    assert statute.cut_items("말.1. 하나 5의2. 아님 2. 둘 112. 아님 03. 셋 3의2. 끼움") == ["말.", "1. 하나 5의2. 아님", "2. 둘 112. 아님", "03. 셋", "3의2. 끼움"]
    import time

    began = time.time()
    assert len(statute.cut_items("말.1. 첫째" + "7. 아님 " * 100_000 + "말.2. 둘째")) == 3
    assert len(statute.cut_headings("".join(f"제{k}조(이름) 글. " for k in range(1, 100_001)))) == 100_000
    assert len(statute.cut_headings("제5조(이름) 글. " * 100_000)) == 1
    assert time.time() - began < 20


def test_statutes_are_read_without_python(spark):
    deep = json.dumps([[['가. 목\n나. "둘"']], "<img src=1>", " 다 "], ensure_ascii=False)
    unit = f'{{"조문내용": "제3조(깊이)", "항": [{{"호": [{{"호내용": "1. 먼저", "목": {{"목내용": {deep}}}}}]}}, {{"항내용": "<2> 뒤"}}]}}'
    payload = f'{{"법령": {{"조문": {{"조문단위": [{unit}, {{"조문여부": "전문", "조문내용": ["제2장", "제1절"]}}, {{}}, {{"조문내용": null, "항": ""}}]}}, "부칙": "제1조(x) y"}}}}'
    frame = spark.createDataFrame([(1, payload)], "k int, p string").select(statute.statute_lines(F.try_variant_get(F.parse_json("p"), "$.법령", "variant"), TODAY).alias("x"))
    assert frame.first().x == ["제3조(깊이)", "1. 먼저", "가. 목", '나. "둘"', "다", "② 뒤", "제2장", "제1절"]
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_strings_of_any_json(spark):
    deep = "[" * 400 + '"안"' + "]" * 400
    assert statute.all_strings(f'{{"a": {deep}, "부칙(1)": {{"b": "없음"}}, "c": [1, null, "둘\\n 셋 ", {{"부칙": "x", "d": "넷"}}]}}') == ["안", "둘", "셋", "넷"]
    rows = spark.createDataFrame([(1, "{broken"), (2, "<p>쪽</p>"), (3, None), (4, "[]"), (5, '{"AdmRulService": {"조문내용": null}}'), (6, '{"AdmRulService": {"조문내용": ""}}')], "doc_id int, payload string")
    got = {r.doc_id: r.lines for r in statute.with_lines(rows, "payload", TODAY).collect()}
    assert got == {1: ["{broken"], 2: ["쪽"], 3: None, 4: [], 5: [], 6: []}


def test_payloads_become_articles(spark):
    unit = {"조문여부": "조문", "조문내용": "제1조(목적)", "항": {"항내용": "<16> 첫 항", "호": {"호내용": "1. 호", "목": [{"목내용": "가. 목"}]}}, "조문시행일자": "20261217"}
    body = json.dumps({"법령": {"조문": {"조문단위": [{"조문여부": "전문", "조문내용": "제1장 총칙"}, unit]}}}, ensure_ascii=False)
    rule = json.dumps({"AdmRulService": {"조문내용": ["제2조(정의)", "제3조(범위) 넓다."]}}, ensure_ascii=False)
    glued = json.dumps({"AdmRulService": {"조문내용": "제1장 총칙 제1조(목적) 가. 제2조(정의) 1. 하나2. 둘"}}, ensure_ascii=False)
    rows = [(6, glued), (1, body), (2, rule), (3, '{"lines": ["제5조(가) 나", "다"], "부칙": ["제1조(x) y"]}'), (4, "<p>제6조(나) 다</p>"), (5, None)]
    table = statute.with_lines(spark.createDataFrame(rows, "doc_id long, payload string"), "payload", TODAY)
    got = {(r.doc_id, r.no): r for r in articles.split_articles(table).collect()}
    assert got.pop((6, "1")).chapter == "제1장 총칙" and got.pop((6, "2")).body == "제2조(정의) 1. 하나\n2. 둘"
    assert set(got) == {(1, "1"), (2, "2"), (2, "3"), (3, "5"), (4, "6")}
    assert got[1, "1"].body == "제1조(목적) ⑯ 첫 항\n1. 호\n가. 목" and got[1, "1"].pending_from == dt.date(2026, 12, 17) and got[1, "1"].chapter == "제1장 총칙"
    assert got[3, "5"].body == "제5조(가) 나\n다"


def tables(spark):
    make = spark.createDataFrame
    arts = [("a:1", "a", "1", "x", "c1"), ("a:2", "a", "2", "y", "c1"), ("a:3", "a", "3", "z", "c2"), ("b:1", "b", "1", "w", None)]
    docs = [("d1", "법령해석", "하나", dt.date(2024, 1, 1)), ("d2", "법령해석", "둘", None), ("d3", "행정지도", "셋", dt.date(2023, 1, 1))]
    links = [("d1", "a:1", 0, 0.9, "e", "explicit"), ("d1", "a:1", 2, 0.8, "f", "abbr"), ("d2", "a:1", 0, 0.5, "e", "title"), ("d3", "a:2", 0, 0.9, "e", "abbr"), ("d2", "a:2", 0, 0.9, "e", "abbr")]
    out = {
        "laws": make([("a", "가법", "법률", None), ("b", "가법 시행령", "시행령", "a")], "slug string, name string, kind string, parent string"), "articles": make(arts, "key string, slug string, no string, title string, chapter string").withColumn("label", F.concat(F.lit("제"), "no", F.lit("조"))),
        "documents": make(docs, "id string, kind string, title string, published_on date"), "links": make(links, "doc_id string, key string, paragraph int, confidence double, evidence string, method string"),
        "versions": make([("a:1", dt.date(2024, 1, 1), "old"), ("a:1", dt.date(2026, 6, 1), "new")], "key string, effective_from date, body string"), "delegations": make([("a:1", "b:1", "text"), ("a:2", "b:1", "text"), ("b:1", "a:1", "thdcmp")], "from_key string, to_key string, origin string"),
    }
    return out | {"stats": cards.article_stats(out["links"], out["documents"])}


def test_cards(spark):
    t = tables(spark)
    assert [(r.slug, r.articles, r.linked_docs) for r in cards.law_list(t).collect()] == [("a", 3, 4), ("b", 1, 0)]
    assert [(r.key, r.run, r.total, r.pending) for r in cards.contents(t, "a", F.lit(TODAY)).collect()] == [("a:1", 1, 2, True), ("a:2", 1, 2, False), ("a:3", 2, 0, False)]
    card = cards.article_card(t, "a:1", F.lit(TODAY))
    assert card["current"].first()[1:] == ("old", "new") and card["neighbours"].first().next == "a:2"
    assert [(r.doc_id, r.paragraphs, r.title) for r in card["documents"].collect()] == [("d2", None, "둘"), ("d1", [2], "하나")]
    assert [r.effective_to for r in card["history"].collect()] == [dt.date(2026, 5, 31), None] and [r.key for r in card["delegates_to"].collect()] == ["b:1"]
    doc = cards.document_card(t, "d2")
    assert doc["document"].first().title == "둘" and doc["links"].count() == 2
    assert sorted((r.other, r.shared) for r in doc["related"].collect()) == [("d1", 2), ("d3", 1)]
    lines = {r.key: r for r in cards.article_cards(t, F.lit(TODAY)).collect()}
    assert (lines["a:1"].current, lines["a:1"].pending, lines["a:1"].documents, lines["a:1"].delegated_from, lines["a:3"].versions, lines["b:1"].previous) == ("old", "new", 2, 1, 0, None)


def test_graphs(spark):
    t = tables(spark)
    graph = cards.article_graph(t, "a:1", 2, 1)
    assert {(r.id, r.type, r.tier) for r in graph["nodes"].collect()} == {("a:1", "article", 0), ("a:2", "article", 0), ("b:1", "article", 1), ("d2", "document", None)}
    edges = {(r.src, r.dst, r.type, r.origin, r.method) for r in graph["edges"].collect()}
    # d2 cites both articles of the graph; a:2 is reached upwards from b:1, which delegates to a:1.
    assert edges == {("a:1", "b:1", "delegation", "text", None), ("b:1", "a:1", "delegation", "thdcmp", None), ("a:2", "b:1", "delegation", "text", None), ("d2", "a:1", "citation", None, "title"), ("d2", "a:2", "citation", None, "abbr")}
    assert [tuple(r) for r in graph["more"].collect()] == [("a:1", "법령해석", 1)]
    both = cards.article_graphs(t, spark.createDataFrame([("a:1",), ("a:3",), ("none",), (None,)], "key string"), 2, 1)
    assert {r.center for r in both["nodes"].collect()} == {"a:1", "a:3"} and both["edges"].where("center = 'a:1'").count() == 5


def test_inferred_delegations(spark):
    t = tables(spark)
    links = spark.createDataFrame([("b:1", "b", "a:1", "a"), ("b:1", "b", "b:2", "b")], "from_key string, slug string, key string, target string")
    none = spark.createDataFrame([], "root string")
    assert [tuple(r) for r in cards.inferred_delegations(links, t["laws"], none).collect()] == [("a:1", "b:1")]
    assert cards.inferred_delegations(links, t["laws"], spark.createDataFrame([("a",)], "root string")).count() == 0
