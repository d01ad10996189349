"""Change events from dated records, their feed, and validity states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_rules(records: DataFrame, rules: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Events of (kind, condition, day, dedupe key) rules, in one pass over the records."""
    options = F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), day.cast("date").alias("occurred_on"), key.alias("dedupe_key"))) for kind, cond, day, key in rules])
    return records.withColumn("_e", F.explode(F.filter(options, lambda x: x.isNotNull()))).select("*", "_e.*").drop("_e")


def feed(events: DataFrame, kinds: list[str] | None, interest: Column, since: Column, order: list[Column], limit: int) -> dict[str, DataFrame]:
    """items: the latest events of interest; summary: all of them by kind."""
    base = events.where((F.col("ts") >= since) & interest & (F.col("event_type").isin(kinds) if kinds else F.lit(True)))
    return {"items": base.orderBy(*order).limit(limit), "summary": base.groupBy("event_type").agg(F.count("*").alias("n"))}


def validity(rows: DataFrame, start: str, end: str, as_of: Column, within: int) -> DataFrame:
    """status: notice before its start, then active or expiring, then expired; without an end it stays active."""
    status = (
        F.when(F.col(start) > as_of, "notice").when(F.col(end) < as_of, "expired").when(F.col(end) <= F.date_add(as_of, within), "expiring").otherwise("active")
    )
    return rows.withColumn("status", status)


def any_interest(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def document_events(docs: DataFrame, as_of: Column, expiring: int = 30, due: int = 7) -> DataFrame:
    """The events of dated documents: dedupe_key, occurred_on, kind, title, law_slug, doc_id.

    docs: id, kind, title, stage, published_on, valid_from, valid_to,
    primary_law. Replies are new on their day; guidance is announced, comes into
    force, is about to end and ends; notices begin and are about to close. What
    is about to happen is dated as_of.
    """
    kind, stage, begin, end, published = (F.col(c) for c in ("kind", "stage", "valid_from", "valid_to", "published_on"))
    guide, notice = kind == "행정지도", kind.isin("입법예고", "규정변경예고") & begin.isNotNull()
    in_force, soon = guide & (stage == "시행"), end.between(as_of, F.date_add(as_of, expiring))
    until = lambda form, text: F.concat(F.col("title"), F.lit(" — "), F.date_format(end, form), F.lit(text))
    named = lambda prefix, *more: F.concat_ws(":", F.lit(prefix), F.col("id"), *[m.cast("string") for m in more])
    rules = [
        ("해석_신규", (kind == "법령해석") & published.isNotNull(), published, named("doc_new"), F.col("title")),
        ("비조치_신규", (kind == "비조치의견") & published.isNotNull(), published, named("doc_new"), F.col("title")),
        ("행정지도_예고", guide & (stage == "예고") & begin.isNotNull(), begin, named("gd_notice"), F.col("title")),
        ("행정지도_시행", in_force & (begin <= as_of), begin, named("gd_start"), F.col("title")),
        ("행정지도_만료임박", in_force & soon, as_of, named("gd_expiring", end), until("yyyy.MM.dd", " 존속기간 만료")),
        ("행정지도_만료", in_force & (end < as_of), end, named("gd_expired", end), F.col("title")),
        ("입법예고_시작", notice, begin, named("notice_start"), F.col("title")),
        ("입법예고_마감임박", notice & end.between(as_of, F.date_add(as_of, due)), as_of, named("notice_due"), until("MM.dd", " 의견제출 마감")),
    ]
    event = lambda k, day, key, title: F.struct(key.alias("dedupe_key"), day.alias("occurred_on"), F.lit(k).alias("kind"), title.alias("title"))
    options = F.array(*[F.when(cond, event(k, day, key, title)) for k, cond, day, key, title in rules])
    rows = docs.select(F.col("primary_law").alias("law_slug"), F.col("id").alias("doc_id"), F.explode(F.filter(options, lambda x: x.isNotNull())).alias("e"))
    return rows.select("e.*", "law_slug", "doc_id")


def pending_events(versions: DataFrame, articles: DataFrame, laws: DataFrame, as_of: Column) -> DataFrame:
    """The event of each version to come: dedupe_key, occurred_on, kind, title, law_slug, key."""
    rows = versions.where(F.col("effective_from") > as_of).select("key", "effective_from").distinct().join(articles.select("key", "slug", "label", F.col("title").alias("article_title")), "key").join(laws.select("slug", "name"), "slug")
    day = F.col("effective_from")
    title = F.concat("name", F.lit(" "), "label", F.lit("("), "article_title", F.lit(") "), F.date_format(day, "yyyy.MM.dd"), F.lit(" 시행 예정"))
    return rows.select(F.concat_ws(":", F.lit("art_pending"), "key", day.cast("string")).alias("dedupe_key"), day.alias("occurred_on"), F.lit("조문_시행예정").alias("kind"), title.alias("title"), F.col("slug").alias("law_slug"), "key")


def first_citations(t: dict[str, DataFrame], docs: DataFrame, n: int) -> DataFrame:
    """Per document of docs (doc_id): its first n articles in the order of law kinds and numbers, and all their keys, sorted."""
    from weftlens.operators.reports import with_law

    cited = with_law(t, t["links"].join(docs, "doc_id", "left_semi").select("doc_id", "key").distinct())
    listed = F.array_sort(F.collect_list(F.struct("law_kind", "ord", "key", "label", "law_name")))
    return cited.groupBy("doc_id").agg(listed.alias("all")).select("doc_id", F.transform(F.slice("all", 1, n), lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), x["law_name"].alias("law_name"))).alias("articles"), F.array_sort(F.transform("all", lambda x: x["key"])).alias("keys"))


def service_feed(t: dict[str, DataFrame], since: Column, kinds: list[str] | None = None, laws: list[str] | None = None, articles: list[str] | None = None, limit: int = 50) -> dict[str, DataFrame]:
    """items: the latest events, named and with the articles that their documents cite; summary: all of them by kind.

    laws: roots of families of interest, by the event's law or by what its
    document cites; articles: keys of interest, likewise.
    """
    from weftlens.operators.reports import with_law

    dims = t["laws"].select(F.col("slug").alias("law_slug"), F.col("name").alias("law_name"), F.coalesce("parent", "slug").alias("root"))
    base = t["events"].where(F.col("occurred_on") >= since).join(dims, "law_slug", "left")

    def of_interest(rows: DataFrame, docs: DataFrame, own: Column) -> DataFrame:
        flagged = rows.join(docs.select("doc_id").distinct().withColumn("cites", F.lit(True)), "doc_id", "left")
        return flagged.where(F.coalesce(own, F.lit(False)) | F.coalesce("cites", F.lit(False))).drop("cites")

    if laws:
        base = of_interest(base, with_law(t, t["links"].select("doc_id", "key")).where(F.col("root").isin(laws)), F.col("root").isin(laws))
    if articles:
        base = of_interest(base, t["links"].where(F.col("key").isin(articles)), F.col("key").isin(articles))
    if kinds:
        base = base.where(F.col("kind").isin(kinds))
    top = base.orderBy(F.desc("occurred_on"), F.desc("dedupe_key")).limit(limit)
    cites = first_citations(t, top.where("doc_id IS NOT NULL").select("doc_id").distinct(), 3)
    items = top.join(t["articles"].select("key", F.col("label").alias("article_label")), "key", "left").join(t["documents"].select(F.col("id").alias("doc_id"), F.col("kind").alias("doc_kind"), "org"), "doc_id", "left").join(cites, "doc_id", "left")
    own = F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>"))
    keys = F.array_sort(F.array_union(F.coalesce("keys", F.array().cast("array<string>")), own))
    items = items.withColumn("article_keys", keys).drop("keys", "root").orderBy(F.desc("occurred_on"), F.desc("dedupe_key"))
    return {"items": items, "summary": base.groupBy("kind").agg(F.count("*").alias("n"))}
