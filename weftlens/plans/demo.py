"""A whole run on invented seeds: statute copies to articles, documents to links, both to events and figures."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.operators import articles, cards, citations, events
from weftlens.plans.registry import Tables, query
from weftlens.sources import landing, shared, store

TODAY = dt.date(2026, 1, 1)
LAWS = [("a", "가나금융업법", "법률", None, ["가나법"]), ("ad", "가나금융업법 시행령", "시행령", "a", [])]
COPIES = {
    "a": ["제1장 총칙", "제1조(목적) 이 법은 금융을 다룬다.", "제2조(정의) 뜻은 다음과 같다.", "제3조(허가) 허가를 받는다. [시행일: 2026. 7. 1.] 제3조"],
    "ad": ["제1조(목적) 이 영은 법 제2조에서 위임된 것을 정한다.", "제2조(절차) 법 제1조와 법 제2조에 따른다."],
}
DOCUMENTS = [
    ("1", "법령해석", "가나법 제2조의 뜻", "「가나금융업법」 제2조와 같은 법 시행령 제2조", None, "2025-03-01", None, None), ("2", "비조치의견", "문의", "「모르는진흥법」 제2조", None, None, None, None),
    ("3", "행정지도", "지도", "가나법 제9조", "시행", "2025-01-01", "2025-01-01", "2026-01-20"), ("4", "입법예고", "예고", None, None, None, "2025-12-20", "2026-01-05"),
]


def run(raw: DataFrame, documents: DataFrame, laws: DataFrame, today: dt.date) -> dict[str, DataFrame]:
    """The tables that a first run leaves: articles, versions, delegations, links, unresolved, events, stats.

    documents: id, kind, title, question, stage, published_on, valid_from, valid_to.
    """
    as_of: Column = F.lit(today)
    state = raw.sparkSession.createDataFrame([], "key string, effective_from date, title string, body string, source_seq string")
    parsed = articles.parse_laws(raw, state, laws, today)
    versions = shared.store(parsed["versions"], "versions")
    split = F.split("key", ":")
    found = versions.groupBy("key").agg(F.max_by("title", "effective_from").alias("title")).select("key", split[0].alias("slug"), split[1].alias("no"), "title")
    found = shared.store(found.withColumn("label", T.article_label(F.col("no"))).withColumn("ord", T.natural_order(F.col("no"))), "articles")
    texts = documents.select(F.col("id").alias("doc_id"), F.array("title", "question").alias("segments"), F.lit(None).cast("string").alias("hint_law"), F.lit(None).cast("string").alias("fallback_law"))
    cited = citations.resolve(texts, laws, found.select("slug", "no", "title"))
    links = shared.store(cited["links"], "cited").withColumn("key", F.concat_ws(":", "slug", "no")).withColumn("reviewed", F.lit(False))
    kept, lost = store.replace_per_key(links.limit(0), links, "doc_id", "reviewed", "key", found.select("key"), evidence="evidence")
    kept = shared.store(kept, "links")
    unresolved = cited["unresolved"].unionByName(lost.select("doc_id", F.col("evidence").alias("raw"), "reason")).distinct()
    docs = documents.join(cited["primary"].select(F.col("doc_id").alias("id"), F.col("primary").alias("primary_law")), "id", "left")
    bodies = versions.where(F.col("effective_from") <= as_of).groupBy("key").agg(F.max_by("body", "effective_from").alias("body")).withColumn("slug", F.split("key", ":")[0])
    own = bodies.select(F.col("key").alias("doc_id"), F.array("body").alias("segments"), F.col("slug").alias("hint_law"), F.lit(None).cast("string").alias("fallback_law"))
    upper = shared.store(citations.resolve(own, laws, found.select("slug", "no", "title"))["links"], "upper")
    upper = upper.select(F.col("doc_id").alias("from_key"), F.split("doc_id", ":")[0].alias("slug"), F.concat_ws(":", "slug", "no").alias("key"), F.col("slug").alias("target"))
    none = laws.select(F.col("slug").alias("root")).limit(0)
    news = events.document_events(docs, as_of).withColumn("key", F.lit(None).cast("string"))
    changes = news.unionByName(parsed["events"].withColumn("doc_id", F.lit(None).cast("string")))
    log = store.append_events(changes, changes.limit(0))
    return {"articles": found, "versions": versions, "links": kept, "unresolved": unresolved, "delegations": cards.inferred_delegations(upper, laws, none), "events": log, "stats": cards.article_stats(kept, documents)}


def seeds(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw, documents, laws) of the invented seeds."""
    payload = lambda slug, lines: json.dumps({"meta": {"slug": slug, "seq": "1", "version": "현행", "effective": "20240101", "via": "api"}, "body": {"lines": lines}}, ensure_ascii=False)
    raw = spark.createDataFrame([("lawgo.law", f"{slug}:1", None, dt.datetime(2025, 1, 1), 200, payload(slug, lines), None) for slug, lines in COPIES.items()], landing.RAW)
    docs = spark.createDataFrame(DOCUMENTS, "id string, kind string, title string, question string, stage string, p string, f string, t string")
    days = [F.col(c).cast("date").alias(n) for c, n in (("p", "published_on"), ("f", "valid_from"), ("t", "valid_to"))]
    return landing.land(raw, raw.limit(0)), docs.select("id", "kind", "title", "question", "stage", *days), spark.createDataFrame(LAWS, "slug string, name string, kind string, parent string, aliases array<string>")


@query("""SELECT * FROM (VALUES ('articles',5),('delegations',3),('events',6),('links',2),('stats',2),('unresolved',2),('versions',5)) v(name,n)""")
def demo_run(t: Tables) -> DataFrame:
    """Rows of each table after a run on the seeds."""
    out = run(*seeds(t("region").sparkSession), TODAY)
    parts = [df.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in out.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total
