"""What a reader asks of one law, article or document, as compositions of joins and windows.

tables: laws, articles, versions, links (doc_id, key), documents (id),
delegations and stats, as DataFrames with natural keys. Each result is lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.operators import joins, windows

# Kinds of laws in their order.
LAW_KINDS = ["법률", "시행령", "시행규칙", "감독규정", "시행세칙", "고시"]


def article_stats(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Per article its documents, by kind, and the latest of their dates."""
    rows = links.select("key", "doc_id").join(documents.select(F.col("id").alias("doc_id"), "kind", "published_on"), "doc_id")
    # The kinds of documents that each count takes.
    kinds = {"interpretations": ["법령해석"], "no_action": ["비조치의견"], "guidance": ["행정지도"], "notices": ["입법예고", "규정변경예고"]}
    # One row for each article and document first, so that plain counts do instead of distinct ones.
    once = rows.groupBy("key", "doc_id").agg(F.first("kind").alias("kind"), F.max("published_on").alias("published_on"))
    counts = [F.count_if(F.col("kind").isin(k)).alias(n) for n, k in kinds.items()]
    return once.groupBy("key").agg(F.count("*").alias("total"), *counts, F.max("published_on").alias("latest_on"))


def law_list(tables: dict[str, DataFrame]) -> DataFrame:
    """Laws with articles: how many, and how often documents cite them (a document that cites two articles counts twice)."""
    per = tables["articles"].join(tables["stats"], "key", "left").groupBy("slug").agg(F.count("*").alias("articles"), F.sum(F.coalesce("total", F.lit(0))).alias("linked_docs"))
    order = F.array_position(F.array(*map(F.lit, LAW_KINDS)), F.col("kind"))
    rows = tables["laws"].join(per, "slug").withColumn("place", F.nullif(order, F.lit(0).cast("long")))
    return rows.orderBy(F.coalesce("parent", "slug"), F.col("place").asc_nulls_last(), "slug")


def all_contents(tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Each law's articles with the number of their chapter's run, their citations and whether a version is still to come."""
    order = Window.partitionBy("slug").orderBy("order")
    rows = tables["articles"].withColumn("order", T.natural_order(F.col("no")))
    new = (~F.lag("chapter").over(order).eqNullSafe(F.col("chapter"))).cast("long")
    rows = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).drop("_new")
    coming = tables["versions"].groupBy("key").agg(F.bool_or(F.col("effective_from") > as_of).alias("coming"))
    rows = rows.join(tables["stats"].select("key", "total"), "key", "left").join(coming, "key", "left")
    return rows.select("slug", "key", "no", "title", "chapter", "run", "order", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("coming", F.lit(False)).alias("pending"))


def contents(tables: dict[str, DataFrame], slug: str, as_of: Column) -> DataFrame:
    """all_contents() of one law, in order."""
    return all_contents(tables | {"articles": tables["articles"].where(F.col("slug") == slug)}, as_of).orderBy("order")


def article_documents(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """Per article of keys (key) and document: the greatest confidence, the evidence, the paragraphs above 0 (null without any)."""
    links = tables["links"].join(keys, "key", "left_semi")
    paragraphs = F.array_sort(F.collect_set(F.when(F.col("paragraph") > 0, F.col("paragraph"))))
    per = links.groupBy("key", "doc_id").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("evidence")).alias("evidence"), paragraphs.alias("paragraphs"))
    return per.withColumn("paragraphs", F.when(F.size("paragraphs") > 0, F.col("paragraphs")))


def delegated(tables: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """Delegations with the label, title and law of their other end."""
    laws = tables["laws"].select("slug", F.col("name").alias("law_name"), F.col("kind").alias("law_kind"))
    ends = tables["articles"].select(F.col("key").alias(end), "slug", "label", "title").join(laws, "slug")
    return tables["delegations"].join(ends, end).select(start, F.col(end).alias("key"), "label", "title", "law_name", "law_kind", "origin")


def related_events(tables: dict[str, DataFrame], keys: DataFrame, n: int = 10) -> DataFrame:
    """The latest events of each article of keys (key), its own and those of documents that cite it."""
    events = tables["events"].select("occurred_on", "kind", "title", "doc_id", F.col("key").alias("own"), "dedupe_key")
    direct = events.join(keys, F.col("own") == F.col("key")).select("key", "occurred_on", "kind", "title", "doc_id", "dedupe_key")
    cited = tables["links"].join(keys, "key", "left_semi").select("key", "doc_id").distinct()
    through = events.join(cited, "doc_id").select("key", "occurred_on", "kind", "title", "doc_id", "dedupe_key")
    both = direct.unionByName(through).dropDuplicates(["key", "dedupe_key"])
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("occurred_on"), "dedupe_key"))
    return both.withColumn("place", place).where(F.col("place") <= n)


def article_card(tables: dict[str, DataFrame], key: str, as_of: Column) -> dict[str, DataFrame]:
    """All of an article: itself with its law, versions, delegations both ways, documents, figures, events and neighbours.

    An unknown key gives an empty ``article``.
    """
    own = F.col("key") == key
    versions, one = tables["versions"].where(own), tables["articles"].where(own).select("key")
    laws = tables["laws"].select("slug", F.col("name").alias("law_name"), F.col("kind").alias("law_kind"), F.col("parent").alias("law_parent"))
    docs = tables["documents"].select(F.col("id").alias("doc_id"), *[c for c in ("kind", "title", "org", "dept", "published_on", "stage", "valid_from", "valid_to") if c in tables["documents"].columns])
    out = {
        "article": tables["articles"].where(own).join(laws, "slug"), "current": windows.current_and_pending(versions, "key", "effective_from", "body", as_of),
        "history": windows.close_intervals(versions, "key", "effective_from").select("effective_from", "effective_to").orderBy("effective_from"),
        "delegates_to": delegated(tables, "from_key", "to_key").where(F.col("from_key") == key), "delegated_from": delegated(tables, "to_key", "from_key").where(F.col("to_key") == key),
        "documents": article_documents(tables, one).join(docs, "doc_id").orderBy(F.col("published_on").desc_nulls_first(), "doc_id"), "stats": tables["stats"].where(own),
        "neighbours": windows.neighbours(tables["articles"].where(F.col("slug") == key.split(":")[0]).withColumn("order", T.natural_order(F.col("no"))), "slug", ["order"], "key").where(own),
    }
    return out | ({"events": related_events(tables, one)} if "events" in tables else {})


def document_card(tables: dict[str, DataFrame], doc_id: str, related: int = 6) -> dict[str, DataFrame]:
    """A document, its links with their articles, and the documents that share most of them."""
    links = tables["links"].where(F.col("doc_id") == doc_id)
    keys = links.select("key").distinct()
    near = tables["links"].join(keys, "key", "left_semi").select("doc_id", "key", "paragraph", F.col("key").alias("label"))
    return {
        "document": tables["documents"].where(F.col("id") == doc_id), "links": links.join(tables["articles"].select("key", "slug", "title"), "key").join(tables["laws"].select("slug", "name"), "slug"),
        "related": joins.cooccurrence(near, "doc_id", "key", related, "label").where(F.col("doc_id") == doc_id),
    }


def article_cards(tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """A line for each article: its law, what is in force and what comes, its delegations, documents and neighbours."""
    laws = tables["laws"].select("slug", F.col("name").alias("law_name"), F.col("kind").alias("law_kind"))
    count = lambda df, key, name: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(name))
    parts = [
        windows.current_and_pending(tables["versions"], "key", "effective_from", "body", as_of), count(tables["versions"], "key", "versions"), count(tables["delegations"], "from_key", "delegates_to"),
        count(tables["delegations"], "to_key", "delegated_from"), tables["stats"].select("key", F.col("total").alias("documents")),
    ]
    rows = windows.neighbours(tables["articles"].withColumn("order", T.natural_order(F.col("no"))), "slug", ["order"], "key").drop("order").join(laws, "slug")
    for part in parts:
        rows = rows.join(part, "key", "left")
    return rows.fillna(0, ["versions", "delegates_to", "delegated_from", "documents"])


# How high each kind of law stands in a drawing.
TIERS = {"법률": 0, "시행령": 1, "시행규칙": 1, "감독규정": 2, "고시": 2, "시행세칙": 3}


def article_graphs(tables: dict[str, DataFrame], centres: DataFrame, depth: int = 2, per_kind: int = 3, many: bool = True) -> dict[str, DataFrame]:
    """Around each article of centres (key): delegations up and down, and the newest documents of each kind that cite it.

    nodes: center, id, type (article or document), tier, kind, title; edges:
    center, src, dst, type (delegation or citation), origin, method, confidence;
    more: center, kind and how many documents of the kind are left out. A
    citation leads from a document to any article of its graph. Keys that are
    no articles give nothing. All centres are expanded together. many: centres
    grow with the tables, so that joins with what is found for them are between
    shuffles; their sizes are estimated from files that are packed much tighter
    than what a broadcast would send through the driver.
    """
    far = (lambda df: df.hint("merge")) if many else (lambda df: df)
    known = centres.select("key").distinct().join(far(tables["articles"].select("key")), "key", "left_semi")
    start = known.select(F.col("key").alias("center"), F.col("key").alias("node"))
    lines, seen, frontiers = None, start, {"down": start, "up": start}
    ends = {"down": ("from_key", "to_key"), "up": ("to_key", "from_key")}
    for _ in range(depth):
        steps = {way: tables["delegations"].join(far(frontiers[way].withColumnRenamed("node", near)), near) for way, (near, _) in ends.items()}
        for step in steps.values():
            found = step.select("center", F.col("from_key").alias("src"), F.col("to_key").alias("dst"), "origin")
            lines = found if lines is None else lines.unionByName(found)
        frontiers = {way: step.select("center", F.col(ends[way][1]).alias("node")).distinct().join(far(seen), ["center", "node"], "left_anti") for way, step in steps.items()}
        seen = seen.unionByName(frontiers["down"]).unionByName(frontiers["up"]).distinct()
    none = F.lit(None)
    edges = lines.distinct().select("center", "src", "dst", F.lit("delegation").alias("type"), "origin", none.cast("string").alias("method"), none.cast("double").alias("confidence"))
    docs = tables["links"].select("key", F.col("doc_id").alias("id")).distinct().join(far(known.select("key")), "key").join(far(tables["documents"]), "id").withColumnRenamed("key", "center")
    place = F.row_number().over(Window.partitionBy("center", "kind").orderBy(F.col("published_on").desc_nulls_first(), "id"))
    shown = docs.withColumn("place", place).where(F.col("place") <= per_kind)
    cited = tables["links"].join(far(shown.select("center", F.col("id").alias("doc_id"))), "doc_id").join(far(seen.withColumnRenamed("node", "key")), ["center", "key"])
    cited = cited.groupBy("center", "doc_id", "key").agg(F.min("method").alias("method"), F.max("confidence").cast("double").alias("confidence"))
    edges = edges.unionByName(cited.select("center", F.col("doc_id").alias("src"), F.col("key").alias("dst"), F.lit("citation").alias("type"), none.cast("string").alias("origin"), "method", "confidence"))
    tier = F.coalesce(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("law_kind")], F.lit(1))
    laws = tables["laws"].select("slug", F.col("kind").alias("law_kind"))
    articles = tables["articles"].select(F.col("key").alias("node"), "slug", "title").join(laws, "slug")
    nodes = seen.join(far(articles), "node").select("center", F.col("node").alias("id"), F.lit("article").alias("type"), tier.alias("tier"), F.col("law_kind").alias("kind"), "title")
    nodes = nodes.unionByName(shown.select("center", "id", F.lit("document").alias("type"), none.cast("int").alias("tier"), "kind", "title"))
    more = docs.groupBy("center", "kind").agg((F.count("*") - per_kind).alias("more")).where("more > 0")
    return {"nodes": nodes, "edges": edges, "more": more}


def article_graph(tables: dict[str, DataFrame], key: str, depth: int = 2, per_kind: int = 3) -> dict[str, DataFrame]:
    """article_graphs() around one article."""
    return article_graphs(tables, tables["articles"].where(F.col("key") == key), depth, per_kind, many=False)


def inferred_delegations(links: DataFrame, laws: DataFrame, official: DataFrame, most: int = 4) -> DataFrame:
    """(from_key, to_key): upper articles of the same family that a lower one cites; none if it cites more than
    ``most``, or if its family has official delegations and it is an ordinance. links: from_key, slug, key, target."""
    # The level of each kind of law.
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in {"법률": 0, "시행령": 1, "시행규칙": 2, "감독규정": 3, "고시": 3, "시행세칙": 4}.items() for x in kv])[F.col("kind")], F.lit(9))
    dims = laws.select("slug", F.coalesce("parent", "slug").alias("root"), level.alias("level"), "kind")
    lower = links.join(dims, "slug")
    upper = dims.select(F.col("slug").alias("target"), F.col("root").alias("r"), F.col("level").alias("l"))
    rows = lower.join(upper, "target").where("root = r AND l < level").select("from_key", F.col("key").alias("to_key"), "root", "kind").distinct()
    sized = rows.groupBy("from_key").agg(F.count_distinct("to_key").alias("n")).where(F.col("n") <= most)
    rows = rows.join(sized, "from_key", "left_semi")
    known = official.select("root").distinct().withColumn("_official", F.lit(True))
    kept = rows.join(known, "root", "left").where(F.col("_official").isNull() | ~F.col("kind").isin("시행령", "시행규칙"))
    return kept.select(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"))
