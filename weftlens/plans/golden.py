"""Queries on invented statute text, with their rows written out, and the incremental run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.functions.diff import word_diff
from weftlens.operators import articles, citations, windows
from weftlens.plans.registry import Tables, query
from weftlens.sources import shared
from weftlens.streaming import incremental

LAWS = [
    ("a", "가나금융업법", "법률", None, ["가나법"]), ("ad", "가나금융업법 시행령", "시행령", "a", []), ("ar", "가나금융업감독규정", "감독규정", "a", []),
    ("b", "다라거래법", "법률", None, []), ("bd", "다라거래법 시행령", "시행령", "b", []),
]
ARTICLES = [("a", n, "") for n in ("2", "5", "7", "12")] + [("a", "4", "주요주주의 범위")] + [("ad", n, "") for n in ("2", "13", "13의2")] + [("ar", n, "") for n in ("7-36", "5")] + [("b", n, "") for n in ("2", "3")]
CITING = [
    (1, ["「가나금융업법」 제2조제3호 및 제5조에 따라"], None, None), (2, ["가나금융업법(이하 '가금법')은 있다. 가금법 제 7 조의 경우"], None, None),
    (3, ["「가나금융업법」 제5조와 같은 법 시행령 제13조의2를 본다"], None, None), (4, ["「모르는진흥법」 제2조와 동법 제5조"], None, None), (5, ["이 법 제12조 및 영 제13조"], "a", None),
    (6, ["「가나금융업법」 제99조"], None, None), (7, ["가나법 2조 1항의 규정"], None, None), (8, ["부칙 제2조 별지 제5조"], "a", None), (9, ["「가나금융업법」 및 「다라거래법」에 관하여 동법 제2조"], None, None),
    (10, ["구 「가나금융업법」 제2조"], None, None), (11, ["가나금융업법 제4조(임원의 자격)"], None, None), (12, ["가나금융업법 제7-36조"], None, None), (13, ["제5조를 본다"], None, "a"), (14, ["감독규정 제5조"], "a", None),
    (15, ["「가나금융업법」 제5조에 따르며 같은 조 제2항제6호는 빠진다"], None, None), (16, ["「가나금융업법」 제5조와 「다라거래법」 제3조가 있고 같은 조 제2항은"], None, None), (17, ["「모르는진흥법」 제2조와 같은 조 제1항"], None, None),
]
LINES = [
    "제1장 총칙", "제1조(목적) 이 법은 금융을 다룬다.", "제2조(정의) 뜻은 다음과 같다.", "1. 첫째", "2. 둘째", "제2절 세부", "절 아래의 줄", "제3조(범위)  넓다.",
    "제3조(범위) 더 넓다. [시행일: 2026. 12. 17.] 제3조", "부 칙", "제1조(시행일) 곧 시행한다.",
]


def _session(t: Tables) -> SparkSession:
    return t("region").sparkSession


@query("""SELECT * FROM (VALUES (1,'a','2',0,'3','explicit'),(1,'a','5',0,'','explicit'),(2,'a','7',0,'','defined'),(3,'a','5',0,'','explicit'),(3,'ad','13의2',0,'','same_law'),(5,'a','12',0,'','this_law'),
 (5,'ad','13',0,'','parent_ref'),(7,'a','2',1,'','title'),(12,'ar','7-36',0,'','explicit'),(13,'a','5',0,'','inferred'),(14,'ar','5',0,'','parent_ref'),(15,'a','5',0,'','explicit'),(15,'a','5',2,'6','same_law'),(16,'a','5',0,'','explicit'),(16,'b','3',0,'','explicit')) v(doc_id,slug,no,paragraph,item,method)""")
def resolve_citations(t: Tables) -> DataFrame:
    return _resolved(t)["links"].select("doc_id", "slug", "no", "paragraph", "item", "method")


@query("""SELECT * FROM (VALUES (4,'모르는진흥법 제2조','unknown_law'),(4,'모르는진흥법 제5조','unknown_law'),(6,'「가나금융업법」 제99조','unknown_article'),(9,'제2조','ambiguous'),(10,'제2조','old_version'),
 (11,'가나금융업법 제4조','title_mismatch'),(16,'같은 조 제2항','ambiguous'),(17,'모르는진흥법 제2조','unknown_law'),(17,'같은 조 제1항','ambiguous')) v(doc_id,raw,reason)""")
def held_citations(t: Tables) -> DataFrame:
    return _resolved(t)["unresolved"]


def _resolved(t: Tables) -> dict[str, DataFrame]:
    spark = _session(t)
    laws = spark.createDataFrame(LAWS, "slug string, name string, kind string, parent string, aliases array<string>")
    docs = spark.createDataFrame(CITING, "doc_id long, segments array<string>, hint_law string, fallback_law string")
    return citations.resolve(docs, laws, spark.createDataFrame(ARTICLES, "slug string, no string, title string"))


@query("""SELECT * FROM (VALUES (1,'1','목적','제1장 총칙','제1조(목적) 이 법은 금융을 다룬다.',NULL),(1,'2','정의','제1장 총칙','제2조(정의) 뜻은 다음과 같다.'||chr(10)||'1. 첫째'||chr(10)||'2. 둘째',NULL),
 (1,'3','범위','제1장 총칙','제3조(범위) 넓다.',NULL),(1,'3','범위','제1장 총칙','제3조(범위) 더 넓다.',DATE '2026-12-17')) v(doc_id,no,title,chapter,body,pending_from)""")
def split_articles(t: Tables) -> DataFrame:
    docs = _session(t).createDataFrame([(1, LINES)], "doc_id long, lines array<string>")
    return articles.split_articles(docs).select("doc_id", "no", "title", "chapter", "body", "pending_from")


@query("""SELECT * FROM (VALUES ('a:1',DATE '2024-01-01',DATE '2025-12-31'),('a:1',DATE '2026-01-01',NULL),('a:2',DATE '2024-01-01',NULL)) v(key,effective_from,effective_to)""")
def article_versions(t: Tables) -> DataFrame:
    rows = [("a:1", "2024-01-01", "본문"), ("a:1", "2025-01-01", "본 문 <개정 2025. 1. 1.>"), ("a:1", "2026-01-01", "새 본문"), ("a:2", "2024-01-01", "둘")]
    table = _session(t).createDataFrame(rows, "key string, day string, body string").withColumn("effective_from", F.to_date("day"))
    return articles.versions(table, "key", "effective_from").select("key", "effective_from", "effective_to")


@query("""SELECT * FROM (VALUES ('a','2','시행령','3'),('a','2','시행령','4의2'),('a','5의2','시행규칙','7')) v(from_slug,from_no,kind,to_no)""")
def delegation_pairs(t: Tables) -> DataFrame:
    body = '{"LspttnThdCmpLawXService":{"위임조문삼단비교":{"법률조문":[{"조번호":"0002","조가지번호":"00","시행령조문":[{"조번호":"0003"},{"조번호":"0004","조가지번호":"02"}]},{"조번호":"0005","조가지번호":"02","시행규칙조문":[{"조번호":"0007","조가지번호":"00"}]}]}}}'
    return articles.delegations(_session(t).createDataFrame([("a", body)], "slug string, payload string"))


@query("""SELECT * FROM (VALUES (1,'=:a |-:b|+:x|=: c'),(2,''),(3,'+:new')) v(id,diff)""")
def word_differences(t: Tables) -> DataFrame:
    rows = _session(t).createDataFrame([(1, "a b c", "a x c"), (2, "", ""), (3, None, "new")], "id long, a string, b string")
    return rows.select("id", F.array_join(F.transform(word_diff("a", "b"), lambda d: F.concat_ws(":", d["op"], d["text"])), "|").alias("diff"))


@query("""SELECT * FROM (VALUES ('fetch','x','ok','2024-01-03'),('link','x','partial','2024-01-02')) v(stage,source,status,day)""")
def latest_run_status(t: Tables) -> DataFrame:
    rows = [("fetch", "x", "failed", "2024-01-01"), ("fetch", "x", "ok", "2024-01-03"), ("link", "x", "partial", "2024-01-02")]
    table = _session(t).createDataFrame(rows, "stage string, source string, status string, day string")
    return windows.latest_per(table, ["stage", "source"], ["day"], ["status", "day"])


@query("""SELECT user_id, event_type, count(DISTINCT event_id)::BIGINT AS n FROM events GROUP BY 1,2""")
def stream_dedupe(t: Tables) -> DataFrame:
    """Two incremental runs over the same files: the second adds nothing."""
    events = t("events")
    spark = events.sparkSession
    files = events.inputFiles()
    source, pattern = os.path.dirname(files[0]), "events.parquet" if files[0].endswith("/events.parquet") else "*.parquet"
    target = shared.new_path(spark, "stream")
    for k in range(2):
        incremental.append_new(spark, source, events.schema, f"{target}/rows", f"{target}/checkpoint-{k}", ["event_id"], pattern=pattern)
    return incremental.read_appended(spark, f"{target}/rows", events.schema).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
