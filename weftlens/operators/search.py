"""Document search: conditions, scores, facets and snippets from one filtered base."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.functions import trigram
from weftlens.operators.gram_index import GramIndex


def has(column: Column, term: str) -> Column:
    """Substring test without case; no pattern characters to escape."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(term.lower()))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def relevance(terms: list[str], title: Column, body: Column, query: str | None = None) -> Column:
    """Mean over terms of 3 for a hit in the body and 2 for one in the title, and the title's trigram similarity to the query."""
    hits = [F.when(has(body, t), 3.0).otherwise(0.0) + F.when(has(title, t), 2.0).otherwise(0.0) for t in terms]
    mean = reduce(lambda a, b: a + b, hits, F.lit(0.0)) / max(1, len(terms))
    return mean + (trigram.similarity(title, F.lit(query)) if query else F.lit(0.0))


def search(docs: DataFrame, query: str, title: str, body: str, kind: str, key: str, filters: dict[str, Column] | None = None, limit: int = 20, offset: int = 0) -> dict[str, DataFrame]:
    """items: a page of documents that match any term, best first; facets: matches by kind, with the kind's own filter left out."""
    filters = filters or {}
    terms = T.terms(query)
    match = any_of([has(F.col(title), t) | has(F.col(body), t) for t in terms]) if terms else F.lit(True)
    base = docs.where(match)
    scored = base.where(all_of(list(filters.values()))).withColumn("score", relevance(terms, F.col(title), F.col(body), query))
    items = scored.orderBy(F.desc("score"), F.asc(key)).offset(offset).limit(limit).withColumn("snippet", T.snippet(F.col(body), terms))
    facets = base.where(all_of([c for name, c in filters.items() if name != kind])).groupBy(kind).agg(F.count("*").alias("n"))
    return {"items": items, "facets": facets}


def indexed_search(spark: SparkSession, index: GramIndex, query: str, title: str, body: str, kind: str, key: str, filters: dict[str, Column] | None = None, limit: int = 20, offset: int = 0) -> dict[str, DataFrame]:
    """search() over the rows that a trigram index of title and body names, with the same result.

    Terms of under three characters, and those of hot grams only, make it read all rows.
    """
    return search(index.candidates(spark, T.terms(query)), query, title, body, kind, key, filters, limit, offset)


def service_search(t: dict[str, DataFrame], query: str, as_of: Column, kinds: list[str] | None = None, orgs: list[str] | None = None, laws: list[str] | None = None, since: Column | None = None, until: Column | None = None, by_date: bool = False, limit: int = 20, offset: int = 0) -> dict[str, DataFrame]:
    """All that a search shows: jump, items with their first four articles, facets by kind, and articles that match.

    Documents match by their text, or because they cite an article whose title
    has all terms. Without terms every document matches, the latest first.
    """
    from weftlens.operators import events
    from weftlens.operators.reports import with_law

    terms = T.terms(query)
    docs = t["documents"].withColumn("search_text", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    if terms:
        titled = t["articles"].where(all_of([has(F.col("title"), w) for w in terms])).select("key")
        through = t["links"].join(titled, "key", "left_semi").select(F.col("doc_id").alias("id")).distinct().withColumn("cites", F.lit(True))
        docs = docs.join(through, "id", "left").where(any_of([has(F.col("search_text"), w) for w in terms]) | F.coalesce("cites", F.lit(False))).drop("cites")
    if orgs:
        docs = docs.where(F.col("org").isin(orgs))
    if laws:
        docs = docs.join(with_law(t, t["links"].select("doc_id", "key")).where(F.col("root").isin(laws)).select(F.col("doc_id").alias("id")), "id", "left_semi")
    if since is not None:
        docs = docs.where(F.col("published_on") >= since)
    if until is not None:
        docs = docs.where(F.col("published_on") <= until)
    wanted = docs.where(F.col("kind").isin(kinds)) if kinds else docs
    scored = wanted.withColumn("score", relevance(terms, F.col("title"), F.col("search_text"), query) if terms else F.lit(0.0))
    order = [F.col("published_on").desc_nulls_first(), F.asc("id")]
    page = scored.orderBy(*(order if by_date or not terms else [F.desc("score"), *order])).offset(offset).limit(limit)
    cites = events.first_citations(t, page.select(F.col("id").alias("doc_id")), 4).select(F.col("doc_id").alias("id"), "articles")
    plain = F.regexp_replace("search_text", r"(?U)\s+", " ")
    items = page.join(cites, "id", "left").withColumn("snippet", T.snippet(plain, terms)).drop("search_text")
    return {"items": items, "facets": docs.groupBy("kind").agg(F.count("*").alias("n")), "total": wanted.agg(F.count("*").alias("total")), "articles": article_hits(t, terms, as_of), "jump": jump(t, query)}


def article_hits(t: dict[str, DataFrame], terms: list[str], as_of: Column, n: int = 12) -> DataFrame:
    """Articles with every term in the title or in the body in force; those with all in the title first, then the most cited."""
    body = t["versions"].where(F.col("effective_from") <= as_of).groupBy("key").agg(F.max_by("body", "effective_from").alias("body"))
    in_title = all_of([has(F.col("title"), w) for w in terms])
    laws = t["laws"].select("slug", F.col("name").alias("law_name"), F.col("kind").alias("law_kind"))
    rows = t["articles"].join(body, "key", "left").where(all_of([has(F.col("title"), w) | has(F.col("body"), w) for w in terms]) if terms else F.lit(False))
    rows = rows.join(laws, "slug").join(t["stats"].select("key", "total"), "key", "left").withColumn("linked", F.coalesce("total", F.lit(0).cast("long")))
    return rows.orderBy(in_title.desc(), F.desc("linked"), "law_kind", "ord", "key").limit(n).select("key", "label", "title", "law_name", "law_kind", "linked")


def jump(t: dict[str, DataFrame], query: str) -> DataFrame:
    """The article that a query cites, if it cites one; empty otherwise."""
    from weftlens.operators import citations

    spark = t["articles"].sparkSession
    named = t["articles"].join(t["laws"].select("slug", F.col("name").alias("law_name")), "slug").select("key", "slug", "no", "label", "title", "law_name")
    if not re.search(r"\d+\s*조", query):
        return named.limit(0).drop("slug", "no")
    asked = spark.createDataFrame([("q", [query], None, None)], "doc_id string, segments array<string>, hint_law string, fallback_law string")
    links = citations.resolve(asked, t["laws"], t["articles"])["links"].orderBy(F.desc("confidence"), "slug", "no").limit(1)
    return named.join(links.select("slug", "no"), ["slug", "no"], "left_semi").drop("slug", "no")
