"""Statute text: lines to versioned articles, with windows instead of a reader that keeps state."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlens.functions import statute
from weftlens.functions import text as T
from weftlens.operators import windows
from weftlens.sources import shared

# How headings, articles, addenda and pending dates are written.
ARTICLE = T.ARTICLE_LINE
CHAPTER = r"^제\d+(?:-\d+)?장\s+\S"
SECTION = r"^제\d+(?:-\d+)?(?:편|절|관)\s+\S"
ADDENDA = r"^부\s*칙"
PENDING = r"\[시행일\s*:\s*(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.\][^\n]*$"
UNNUMBERED_ADDENDA = r"^[①-⑳]?\s*\((시행일|적용례|경과조치)\)"
PAGE_DEBRIS = r"src=\"|href=|조문목록"


def split_articles(docs: DataFrame, key: str = "doc_id", lines: str = "lines") -> DataFrame:
    """(key, place, no, label, title, chapter, body, pending_from) for each article of each document.

    An article has the lines after its heading up to the next heading of any
    kind; the text ends where addenda begin: at their heading, where article
    numbers go back, or at an entry of unnumbered addenda.
    """
    by = Window.partitionBy(key).orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.select(key, F.posexplode(lines).alias("pos", "raw"))
    rows = rows.withColumn("line", F.regexp_replace(F.regexp_replace("raw", r"(?U)\s+", " "), "^ | $", "")).drop("raw")
    rows = rows.withColumn("addenda", F.col("line").rlike(ADDENDA))
    rows = rows.where(F.col("addenda") | ~F.col("line").rlike(PAGE_DEBRIS))
    art = F.regexp_extract("line", ARTICLE, 1)
    kind = F.when(F.col("line").rlike(CHAPTER), "chapter").when(F.col("line").rlike(SECTION), "section").when(art != "", "article")
    rows = rows.withColumn("kind", kind).withColumn("order", F.when(F.col("kind") == "article", T.natural_order(T.article_no(art))))
    rows = rows.withColumn("started", F.coalesce(F.bool_or(F.col("kind").isin("chapter", "article")).over(before), F.lit(False)))
    rows = rows.withColumn("high", F.max("order").over(before)).withColumn("heading", F.last(F.when(F.col("kind").isNotNull(), F.struct("pos", "kind", "line")), ignorenulls=True).over(upto))
    ends = (F.col("addenda") & F.col("started")) | (F.col("order") < F.col("high")) | (F.col("kind").isNull() & (F.col("heading.kind") == "article") & F.col("line").rlike(UNNUMBERED_ADDENDA))
    rows = rows.withColumn("over", F.coalesce(F.bool_or(F.coalesce(ends, F.lit(False))).over(upto), F.lit(False)))
    rows = rows.withColumn("chapter", F.coalesce(F.last(F.when(F.col("kind") == "chapter", F.col("line")), ignorenulls=True).over(upto), F.lit("")))
    own = ~F.col("over") & (F.col("heading.kind") == "article") & (~F.startswith("line", F.substring("heading.line", 1, 20)) | (F.col("pos") == F.col("heading.pos")))
    per = rows.where(own).groupBy(key, F.col("heading.pos").alias("place")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts"), F.min_by("chapter", "pos").alias("chapter"))
    body = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    per = per.withColumn("whole", body).withColumn("head", F.col("parts")[0]["line"])
    day = F.make_date(*[F.try_to_number(F.nullif(F.regexp_extract("whole", PENDING, k), F.lit("")), F.lit("9999")).cast("int") for k in (1, 2, 3)])
    label = F.regexp_extract("head", ARTICLE, 1)
    return per.select(
        key, "place", T.article_no(label).alias("no"), label.alias("label"), F.trim(F.regexp_extract("head", ARTICLE, 2)).alias("title"), "chapter",
        F.regexp_replace("whole", r"\s*" + PENDING, "").alias("body"), F.when(F.col("whole").rlike(PENDING), day).alias("pending_from"),
    )


def versions(articles: DataFrame, key: str, effective: str) -> DataFrame:
    """Versions that say something new: a copy whose substance is that of the version before it is left out.

    effective_to is the day before the next version that stays.
    """
    by = Window.partitionBy(key).orderBy(effective)
    told = articles.withColumn("_s", T.substance(F.col("body")))
    new = told.withColumn("_b", F.lag("_s").over(by)).where(~F.col("_s").eqNullSafe(F.col("_b"))).drop("_s", "_b")
    return new.withColumn("effective_to", F.date_sub(F.lead(effective).over(by), 1))


def upsert_versions(state: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state after, outcomes): versions (key, effective_from, title, body, source_seq) put into the state.

    Of several incoming copies of a version the one with the greatest
    source_seq counts. The outcome is same where the body is equal, or only its
    notation is new (which is taken over), changed where a version had another
    substance, else new. effective_to is the day before the next version.
    """
    names = ["key", "effective_from"]
    fields = ["title", "body", "source_seq"]
    fresh = incoming.groupBy(*names).agg(F.max_by(F.struct(*fields), "source_seq").alias("n"))
    both = state.select(*names, F.struct(*fields).alias("o")).join(fresh, names, "full_outer")
    same = (F.col("o.body") == F.col("n.body")) | (T.substance(F.col("o.body")) == T.substance(F.col("n.body")))
    outcome = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "new").when(same, "same").otherwise("changed")
    rows = both.withColumn("outcome", outcome).withColumn("v", F.coalesce("n", "o"))
    after = windows.close_intervals(rows.select(*names, "v.*"), "key", "effective_from")
    return after, rows.where("outcome <> 'kept'").select(*names, "outcome")


def parse_laws(raw: DataFrame, state: DataFrame, laws: DataFrame, today: date) -> dict[str, DataFrame]:
    """versions, outcomes and events of statute payloads {meta: {slug, seq, version, effective, via}, body}.

    raw: source, source_key, payload, parsed_at. Payloads of laws out of scope
    are left alone; of a law with a copy from the interface, web copies count no
    more. Of a copy of the text to come only articles that differ from the
    version before are taken. An article that changes on the first copy from
    the interface is no event, as its source has changed.
    """
    meta = lambda name: F.get_json_object("payload", f"$.meta.{name}")
    rows = raw.select("source", "payload", F.col("parsed_at").isNotNull().alias("done"), meta("slug").alias("slug"), meta("seq").alias("source_seq"), meta("version").alias("copy"), T.ymd(meta("effective")).alias("effective"), meta("via").alias("via"))
    rows = rows.join(laws.select("slug", "name"), "slug")
    by_api = F.col("via") == "api"
    known = rows.groupBy("source", "slug").agg(F.coalesce(F.bool_or(by_api), F.lit(False)).alias("api"), F.coalesce(F.bool_or(by_api & F.col("done")), F.lit(False)).alias("was_api"))
    rows = rows.join(known, ["source", "slug"]).where(~F.col("done") & ~(F.col("api") & F.coalesce(F.col("via") == "web", F.lit(False))))
    rows = rows.withColumn("payload", F.get_json_object("payload", "$.body")).withColumn("doc_id", F.concat_ws("|", "source", "slug", F.coalesce("source_seq", F.lit("")), F.coalesce("copy", F.lit(""))))
    lined = statute.with_lines(rows, "payload", today)
    about = lined.select("doc_id", "slug", "name", "source_seq", "copy", "effective", "via", "was_api").dropDuplicates(["doc_id"])
    found = split_articles(lined).join(about, "doc_id")
    start = F.coalesce("pending_from", "effective", F.lit(today))
    found = found.withColumn("key", F.concat_ws(":", "slug", "no")).withColumn("effective_from", start).withColumn("future", F.coalesce(F.col("copy") == "시행예정", F.lit(False)))
    # The version before: of the state, or of another copy in these payloads.
    told = state.select("key", "effective_from", "body").unionByName(found.where("NOT future").select("key", "effective_from", "body"))
    before = found.where("future").select("key", F.col("effective_from").alias("at")).distinct().join(told, "key").where(F.col("effective_from") < F.col("at"))
    before = before.groupBy("key", "at").agg(F.max_by("body", "effective_from").alias("prior")).withColumnRenamed("at", "effective_from")
    found = found.join(before, ["key", "effective_from"], "left").where(~F.col("future") | F.col("prior").isNull() | (T.substance(F.col("prior")) != T.substance(F.col("body"))))
    # Versions, outcomes and events all begin here; the payloads are cut into articles once.
    found = shared.store(found.withColumn("pending", F.col("future") | F.col("pending_from").isNotNull()), "parsed")
    after, outcomes = upsert_versions(state, found.select("key", "effective_from", "title", "body", "source_seq"))
    had = state.select("key").distinct().withColumn("had", F.lit(True))
    one = found.groupBy("key", "effective_from").agg(F.max_by(F.struct("slug", "name", "label", "title", "pending", "via", "was_api"), "source_seq").alias("a")).select("key", "effective_from", "a.*")
    news = one.join(outcomes.where("outcome <> 'same'"), ["key", "effective_from"]).join(had, "key", "left")
    switching = (F.col("via") == "api") & ~F.col("was_api")
    changed = F.coalesce("had", F.lit(False)) & ~F.coalesce(switching, F.lit(False))
    kind = F.when(F.col("pending"), "조문_시행예정").when(changed, "조문_개정")
    day = F.col("effective_from")
    title = F.concat("name", F.lit(" "), "label", F.when(F.col("pending"), F.concat(F.lit("("), "title", F.lit(") "), F.date_format(day, "yyyy.MM.dd"), F.lit(" 시행 예정"))).otherwise(F.concat(F.lit("("), "title", F.lit(") 개정"))))
    key = F.concat_ws(":", F.when(F.col("pending"), "art_pending").otherwise("art_changed"), "key", day.cast("string"))
    events = news.withColumn("kind", kind).where("kind IS NOT NULL").select(key.alias("dedupe_key"), day.alias("occurred_on"), "kind", title.alias("title"), F.col("slug").alias("law_slug"), "key")
    return {"versions": after, "outcomes": outcomes, "events": events}


def snapshot_lines(articles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lines): the lines that split_articles() reads back as these articles: each chapter once before its first article, dates to come in a mark."""
    by = Window.partitionBy(key).orderBy("place")
    new = (F.col("chapter") != "") & ~F.coalesce(F.col("chapter") == F.lag("chapter").over(by), F.lit(False))
    mark = F.concat(F.lit("[시행일: "), F.date_format("pending_from", "yyyy. M. d"), F.lit(".] "), "label")
    own = F.concat(F.when(F.col("new"), F.array("chapter")).otherwise(F.array().cast("array<string>")), F.split("body", "\n"), F.when(F.col("pending_from").isNotNull(), F.array(mark)).otherwise(F.array().cast("array<string>")))
    rows = articles.withColumn("new", new).select(key, F.struct("place", own.alias("lines")).alias("x"))
    return rows.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lines"])).alias("lines"))


#: Circled numbers at a line's beginning, as articles and statutes' payloads share them.
circled = T.circled


def delegations(payloads: DataFrame, slug: str = "slug", payload: str = "payload") -> DataFrame:
    """(from_slug, from_no, kind, to_no) of three-column comparison payloads: each statute article with the
    decree's and the rule's articles that it delegates to. Numbers come zero-padded, with an optional branch."""
    unit = "struct<`조번호`: string, `조가지번호`: string>"
    down = f"array<{unit}>"
    schema = f"struct<LspttnThdCmpLawXService: struct<`위임조문삼단비교`: struct<`법률조문`: array<struct<`조번호`: string, `조가지번호`: string, `시행령조문`: {down}, `시행규칙조문`: {down}>>>>>"
    rows = payloads.select(F.col(slug).alias("from_slug"), F.explode(F.from_json(payload, schema).getField("LspttnThdCmpLawXService").getField("위임조문삼단비교").getField("법률조문")).alias("a"))
    number = lambda x: F.concat(x["조번호"].cast("int").cast("string"), F.when(F.coalesce(x["조가지번호"].cast("int"), F.lit(0)) > 0, F.concat(F.lit("의"), x["조가지번호"].cast("int").cast("string"))).otherwise(""))
    parts = [rows.select("from_slug", number(F.col("a")).alias("from_no"), F.lit(kind).alias("kind"), F.explode(F.col("a")[f"{kind}조문"]).alias("b")) for kind in ("시행령", "시행규칙")]
    both = parts[0].unionByName(parts[1])
    return both.select("from_slug", "from_no", "kind", number(F.col("b")).alias("to_no")).distinct()


def delegation_keys(pairs: DataFrame, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """(from_key, to_key) of delegations(): the lower article is in the law of its kind in the same family; both ends exist in articles (key)."""
    family = laws.select("slug", "kind", F.coalesce("parent", "slug").alias("root"))
    rows = pairs.join(family.select(F.col("slug").alias("from_slug"), "root"), "from_slug").join(family.select(F.col("slug").alias("to_slug"), "kind", "root"), ["root", "kind"])
    keyed = rows.select(F.concat_ws(":", "from_slug", "from_no").alias("from_key"), F.concat_ws(":", "to_slug", "to_no").alias("to_key")).distinct()
    for end in ("from_key", "to_key"):
        keyed = keyed.join(articles.select(F.col("key").alias(end)), end, "left_semi")
    return keyed.select("from_key", "to_key")
