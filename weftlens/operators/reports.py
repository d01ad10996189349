"""What the collected tables say about themselves: totals, distributions, structure, sources, runs, schedules.

tables: laws (slug, name, kind, parent, aliases), articles (key, slug, no,
label, title, chapter, ord), documents (id, kind, dept, title, body, dates,
stage), links (doc_id, key, ...), versions (key, effective_from), delegations
(from_key, to_key), unresolved (raw, reason), runs and raw. Laws are a small
dimension; whether it is broadcast is left to the optimiser, which knows its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlens.functions.names import Names, any_found
from weftlens.sources import shared

Frames = dict[str, DataFrame]
# Kinds of documents that are replies, and names of no particular law.
REPLIES = ["법령해석", "비조치의견"]
GENERIC = ["법률", "법", "규정", "감독규정", "업무규정", "시행세칙", "세칙", "규칙", "시행령", "고시", "지침", "기준", "감독업무시행세칙", "감독규정시행세칙", "업무시행세칙"]
# The columns of the structure matrix and the kinds of laws that they count.
LEVELS = {"law_articles": ["법률"], "decree_articles": ["시행령"], "rule_articles": ["시행규칙"], "reg_articles": ["감독규정", "고시"], "detail_articles": ["시행세칙"]}


def with_law(t: Frames, rows: DataFrame) -> DataFrame:
    """rows (key, ...) with the article's label, title and order, and its law's name, kind and root."""
    laws = t["laws"].select("slug", F.col("name").alias("law_name"), F.col("kind").alias("law_kind"), F.coalesce("parent", "slug").alias("root"))
    return rows.join(t["articles"].select("key", "slug", "label", "title", "ord"), "key").join(laws, "slug")


def family(t: Frames, slug: str) -> DataFrame:
    """The laws of a law's family: its root and all below it."""
    root = F.coalesce("parent", "slug")
    return t["laws"].withColumn("root", root).join(t["laws"].where(F.col("slug") == slug).select(root.alias("root")), "root", "left_semi").drop("root")


def totals(t: Frames, as_of: Column) -> DataFrame:
    """One row: laws with articles, articles, pending versions, delegations, documents, links, first and last reply."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    replies = t["documents"].where(F.col("kind").isin(REPLIES)).agg(F.min("published_on").alias("first_reply"), F.max("published_on").alias("last_reply"))
    parts = [
        n(t["laws"].join(t["articles"], "slug", "left_semi"), "laws"), n(t["articles"], "articles"), n(t["versions"].where(F.col("effective_from") > as_of), "pending_versions"), n(t["delegations"], "delegations"),
        n(t["documents"], "documents"), n(t["links"], "links"), replies,
    ]
    return reduce(DataFrame.crossJoin, parts)  # rows of one each


def top_laws(t: Frames, n: int = 12) -> DataFrame:
    """Laws whose families most documents cite."""
    links = t["links"].select("doc_id", "key")
    size = links.count()
    laws = t["laws"].select("slug", F.coalesce("parent", "slug").alias("root"))
    roots = shared.dealt(t["articles"].select("key", "slug").join(laws, "slug").select("key", "root"), size, "key")
    cited = shared.dealt(links, size, "key").join(roots, "key").select("doc_id", "root")
    rows = shared.dealt(cited.where("doc_id IS NOT NULL"), size, "doc_id").distinct().groupBy("root").agg(F.count("*").alias("docs"))
    return rows.join(t["laws"].select(F.col("slug").alias("root"), "name"), "root").orderBy(F.desc("docs"), "root").limit(n).select(F.col("root").alias("slug"), "name", "docs")


def top_articles(t: Frames, n: int = 15) -> DataFrame:
    """Articles that most documents cite."""
    cited = t["links"].groupBy("key").agg(F.count_distinct("doc_id").alias("docs"))
    return with_law(t, cited).orderBy(F.desc("docs"), "key").limit(n).select("key", "label", "title", "law_name", "law_kind", "docs")


def names_of(laws: DataFrame) -> list[str]:
    """All names and aliases, the longest first. Bounded by the register of laws."""
    rows = laws.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).distinct().collect()
    return sorted((r.n for r in rows if r.n), key=lambda n: (-len(n), n))


def link_rates(t: Frames, names: list[str] | None = None) -> DataFrame:
    """One row: replies, those with a link, and the share; with names, of replies that mention one of them in title or body."""
    docs = t["documents"].where(F.col("kind").isin(REPLIES))
    if names is not None:
        docs = docs.where(any_found(F.concat_ws(" ", "title", "body"), Names.of(names)))
    linked = t["links"].select(F.col("doc_id").alias("id")).distinct().withColumn("has", F.lit(1))
    per = docs.select("id").join(linked, "id", "left").agg(F.count("*").alias("docs"), F.count("has").alias("linked"))
    return per.withColumn("rate", F.round(F.try_divide(F.col("linked").cast("double"), "docs"), 3))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have each value."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def strange_laws(unresolved: DataFrame, n: int = 12) -> DataFrame:
    """Names of unregistered laws that are cited most: what stands before the number, without brackets and generic names."""
    before = F.regexp_replace(F.regexp_extract("raw", r"(?s)^(.*?)\s*제?\d", 1), r"^[「」\[\] ]+|[「」\[\] ]+$", "")
    whole = F.regexp_replace("raw", r"^[「」\[\] ]+|[「」\[\] ]+$", "")
    rows = unresolved.where("reason = 'unknown_law'").select(F.when(F.col("raw").rlike(r"\d"), before).otherwise(whole).alias("name"))
    return rows.where((F.col("name") != "") & ~F.col("name").isin(GENERIC)).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def spread(t: Frames) -> DataFrame:
    """One row: replies with links, their mean number of articles, and how many cite several, an act and what is below it, and have no number in the title."""
    docs = t["documents"].where(F.col("kind").isin(REPLIES)).select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"))
    rows = with_law(t, t["links"].select("doc_id", "key").distinct()).join(docs, "doc_id")
    is_act = F.col("law_kind") == "법률"
    per = rows.groupBy("doc_id").agg(F.count("*").alias("arts"), F.bool_or(is_act).alias("act"), F.bool_or(~is_act).alias("below"), F.first("doc_title").alias("doc_title"))
    return per.agg(
        F.count("*").alias("docs"), F.round(F.avg("arts"), 1).alias("avg_articles"), F.count_if(F.col("arts") >= 2).alias("multi_article"), F.count_if(F.col("act") & F.col("below")).alias("law_and_sub"),
        F.count_if("below").alias("with_sub"), F.count_if(~F.col("doc_title").rlike(r"제\s*[0-9]+\s*조")).alias("title_no_article"),
    )


def pending(t: Frames, as_of: Column) -> DataFrame:
    """One row: articles with a version to come, those that are cited, and the documents that cite them."""
    keys = t["versions"].where(F.col("effective_from") > as_of).select("key").distinct()
    cited = keys.join(t["links"].select("key", "doc_id").distinct(), "key", "left")
    return cited.agg(F.count_distinct("key").alias("articles"), F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("key"))).alias("with_links"), F.count_distinct("doc_id").alias("docs"))


def pending_top(t: Frames, as_of: Column, n: int = 5) -> DataFrame:
    """Cited articles with a version to come: its first day and their documents, most cited first."""
    first = t["versions"].where(F.col("effective_from") > as_of).groupBy("key").agg(F.min("effective_from").alias("effective_from"))
    docs = t["links"].groupBy("key").agg(F.count_distinct("doc_id").alias("docs"))
    return with_law(t, first.join(docs, "key")).orderBy(F.desc("docs"), "key").limit(n).select("key", "label", "title", "law_name", "effective_from", "docs")


def replies_by_year(t: Frames) -> DataFrame:
    rows = t["documents"].where(F.col("kind").isin(REPLIES) & F.col("published_on").isNotNull()).groupBy(F.year("published_on").alias("year"))
    return rows.agg(F.count_if(F.col("kind") == REPLIES[0]).alias("interp"), F.count_if(F.col("kind") == REPLIES[1]).alias("noaction"))


def replies_a_year(yearly: DataFrame, year: int) -> DataFrame:
    """One row: mean replies over those of the five years before ``year`` that have any, rounded half to even, and their span; null without."""
    recent = yearly.where(F.col("year").between(year - 5, year - 1)).withColumn("n", F.col("interp") + F.col("noaction"))
    return recent.agg(F.bround(F.avg("n")).cast("long").alias("a_year"), F.min("year").alias("first"), F.max("year").alias("last"))


def spikes(yearly: DataFrame, value: str, period: str, factor: int = 3) -> DataFrame:
    """Periods whose value is above ``factor`` times the upper median of all, with the median; none if that is 0."""
    one = yearly.agg(F.sort_array(F.collect_list(value)).alias("all")).select(F.element_at("all", (F.floor(F.size("all") / 2) + 1).cast("int")).alias("median"))
    # One row on the right; a row a period on the left.
    return yearly.crossJoin(one).where((F.col("median") > 0) & (F.col(value) > factor * F.col("median"))).select(period, value, "median")


def guidance(t: Frames, as_of: Column, within: int = 60) -> DataFrame:
    """One row: guidance in force, expiring soon, expired, announced, and its mean days."""
    in_force, end = F.col("stage") == "시행", F.col("valid_to")
    days = F.when(in_force & F.col("valid_from").isNotNull() & end.isNotNull(), F.datediff(end, F.col("valid_from")))
    return t["documents"].where("kind = '행정지도'").agg(
        F.count_if(in_force & (end.isNull() | (end >= as_of))).alias("active"), F.count_if(in_force & end.between(as_of, F.date_add(as_of, within))).alias("expiring"), F.count_if(in_force & (end < as_of)).alias("expired"),
        F.count_if(F.col("stage") == "예고").alias("notice"), F.round(F.avg(days)).cast("long").alias("avg_days"),
    )


def by_department(t: Frames, kinds: list[str], missing: str, n: int) -> DataFrame:
    rows = t["documents"].where(F.col("kind").isin(kinds)).groupBy(F.coalesce("dept", F.lit(missing)).alias("dept")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "dept").limit(n)


def structure(t: Frames, as_of: Column) -> DataFrame:
    """Per family with articles: articles of each level, delegations that begin in it, articles with a version to come."""
    roots = t["articles"].select("key", "slug").join(t["laws"].select("slug", "kind", F.coalesce("parent", "slug").alias("root")), "slug")
    per = roots.groupBy("root").agg(*[F.count_if(F.col("kind").isin(kinds)).alias(name) for name, kinds in LEVELS.items()], F.count("*").alias("all"))
    per = per.where(F.col("all") > 0)
    down = t["delegations"].join(roots, F.col("from_key") == F.col("key")).groupBy("root").agg(F.count("*").alias("delegations"))
    later = t["versions"].where(F.col("effective_from") > as_of).select("key").distinct().join(roots, "key").groupBy("root").agg(F.count("*").alias("pending"))
    rows = t["laws"].where("parent IS NULL").select(F.col("slug").alias("root"), "name").join(per, "root").join(down, "root", "left").join(later, "root", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(F.col("root").alias("slug"), "name", *LEVELS, zero("delegations"), zero("pending"))


def shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group its rows, the sum of a value, and that sum's share of all in percent, rounded; 0 if all is 0."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    whole = per.agg(F.sum("total").alias("whole"))
    # One row on the right.
    return per.crossJoin(whole).select(group, "n", "total", F.coalesce(F.round(F.try_divide(F.col("total") * 100.0, "whole")), F.lit(0.0)).cast("long").alias("percent"))


def by_source(raw: DataFrame, laws: DataFrame, seen: str = "fetched_at") -> DataFrame:
    """Per source: different keys (a statute's copies count once), the latest time, rows by interface. Statutes out of scope are left out."""
    slug = F.split_part("source_key", F.lit(":"), F.lit(1))
    statute = F.col("source").isin("lawgo.law", "lawgo.admrul")
    known = laws.select(F.col("slug").alias("s"), F.lit(True).alias("known")).distinct()
    rows = raw.withColumn("s", slug).join(known, "s", "left").where(~statute | F.col("known"))
    name = F.when(F.col("source").startswith("lawgo."), F.col("s")).otherwise(F.col("source_key"))
    api = F.count_if(F.coalesce(F.get_json_object("payload", "$.meta.via") == "api", F.lit(False)))
    return rows.groupBy("source").agg(F.count_distinct(name).alias("n"), F.max(seen).alias("last"), api.alias("api"))


def roll_up(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source of the service (key, raw, method, fallback; a row for each raw source): keys, latest time, and the method in use."""
    per = sources.join(summary, F.col("raw") == F.col("source"), "left").groupBy("key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("collected"), F.max("last").alias("last"), F.max("api").alias("api"), F.max("method").alias("method"), F.max("fallback").alias("fallback"))
    used = F.when((F.coalesce("api", F.lit(0)) > 0) | F.col("fallback").isNull(), F.col("method")).otherwise(F.col("fallback"))
    return per.select("key", "collected", "last", used.alias("method"))


def last_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """The last collecting run of each source of the service; sources (key, run_source) name the runs that count."""
    rows = runs.where("stage = 'fetch'").join(sources.select("key", F.col("run_source").alias("source")), "source")
    last = rows.groupBy("key").agg(F.max(F.struct("started_at", "id", "source", "status", "finished_at")).alias("r"))
    return sources.select("key").distinct().join(last, "key", "left").select("key", "r.id", "r.source", "r.status", "r.started_at", "r.finished_at")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last finished run of each stage and source."""
    last = runs.where("finished_at IS NOT NULL").groupBy("stage", "source").agg(F.max(F.struct("started_at", "id", "status", "finished_at")).alias("r"))
    return last.select("stage", "source", "r.id", "r.status", "r.finished_at")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The runs that began last, of any stage and state, the newest first."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n).select("id", "stage", "source", "status", "started_at", "finished_at")


def portal_total(runs: DataFrame, source: str = "fsc.reply", field: str = "total") -> DataFrame:
    """One row: how many entries the portal listed in the last run of the source that says so; null where none does."""
    said = runs.where(F.col("source") == source).withColumn("n", F.get_json_object("stats", f"$.{field}").try_cast("int")).where("n IS NOT NULL")
    return said.agg(F.max_by("n", F.struct("started_at", "id")).alias("portal_listed_total"))


def health(t: Frames) -> DataFrame:
    """One row: numbers of documents, articles, links and laws, and the time of the data."""
    n = lambda name: t[name].agg(F.count("*").alias(name))
    return reduce(DataFrame.crossJoin, [n("documents"), n("articles"), n("links"), n("laws"), latest_runs(t["runs"]).agg(F.max("finished_at").alias("data_as_of"))])


def schedule(pending_events: DataFrame, documents: DataFrame, as_of: Column, within: int = 60, first: int = 3) -> DataFrame:
    """Days to come: articles that change, grouped by day with the first labels, guidance that ends soon, notices that close.

    pending_events: occurred_on, key, label, law_name. Columns: day, kind, n, what, more.
    """
    later = pending_events.where(F.col("occurred_on") > as_of).groupBy(F.col("occurred_on").alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("key", "label"))).alias("all"))
    labels = F.array_join(F.transform(F.slice("all", 1, first), lambda x: x["label"]), ", ")
    changes = later.select("day", F.lit("조문").alias("kind"), "n", labels.alias("what"), (F.col("n") > first).alias("more"))
    ends = documents.where("kind = '행정지도'")
    soon = ends.where((F.col("stage") == "시행") & F.col("valid_to").between(as_of, F.date_add(as_of, within)))
    notices = ends.where((F.col("stage") == "예고") & (F.col("valid_to") >= as_of))
    other = lambda df, kind: df.select(F.col("valid_to").alias("day"), F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"), F.col("title").alias("what"), F.lit(False).alias("more"))
    return changes.unionByName(other(soon, "만료")).unionByName(other(notices, "예고")).orderBy("day", "kind", "what")


def kpis(events: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """One row: replies of the last days, changes to come and the first day of one."""
    day, coming = F.col("occurred_on"), (F.col("occurred_on") > as_of) & (F.col("kind") == "조문_시행예정")
    recent = F.col("kind").isin("해석_신규", "비조치_신규") & day.between(F.date_sub(as_of, days), as_of)
    return events.agg(F.count_if(recent).alias("new_replies"), F.count_if(coming).alias("pending"), F.min(F.when(coming, day)).alias("next_pending"))


def analysis(t: Frames, as_of: Column, year: int, sources: DataFrame, seen: str = "fetched_at") -> Frames:
    """Everything that the analysis page shows, each part a lazy DataFrame."""
    yearly = replies_by_year(t)
    return {
        "totals": totals(t, as_of), "portal_total": portal_total(t["runs"]), "sources": roll_up(by_source(t["raw"], t["laws"], seen), sources), "replies_by_year": yearly, "replies_by_dept": by_department(t, REPLIES, "(부서 미기재 · 과거 회신)", 12),
        "top_laws": top_laws(t), "top_articles": top_articles(t), "link_quality": link_rates(t), "in_scope": link_rates(t, names_of(t["laws"])), "by_method": distribution(t["links"], "method"),
        "by_reason": distribution(t["unresolved"], "reason"), "unknown_laws": strange_laws(t["unresolved"]), "spread": spread(t), "pending": pending(t, as_of), "pending_top": pending_top(t, as_of),
        "replies_a_year": replies_a_year(yearly, year), "guidance": guidance(t, as_of), "guidance_by_dept": by_department(t, ["행정지도"], "(미기재)", 8), "structure": structure(t, as_of),
    }
