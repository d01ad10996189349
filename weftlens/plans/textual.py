"""Queries over the text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.functions import names, text, trigram
from weftlens.functions.diff import difference_sizes
from weftlens.operators import gram_index, search
from weftlens.plans.registry import Tables, query
from weftlens.sources import shared, store


@query("""SELECT source, count(*)::BIGINT AS docs, count(*) FILTER (WHERE regexp_matches(text, 'License|Lizenz|reserved'))::BIGINT AS in_scope FROM documents GROUP BY 1""")
def regex_scope(t: Tables) -> DataFrame:
    return t("documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.coalesce(F.col("text").rlike("License|Lizenz|reserved"), F.lit(False))).alias("in_scope"))


@query("""SELECT sha2 AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(coalesce(text,'') || chr(31) || coalesce(lang,'') || chr(31)) AS sha2 FROM documents) GROUP BY 1 HAVING count(*)>1""")
def content_hash(t: Tables) -> DataFrame:
    rows = t("documents").select("doc_id", store.content_hash(F.col("text"), F.col("lang")).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_TERMS = "license reserved the"


@query("""SELECT doc_id, source, round((3*(contains(lower(text),'license')::INT + contains(lower(text),'reserved')::INT + contains(lower(text),'the')::INT)
 + 2*(contains(lower(source),'license')::INT + contains(lower(source),'reserved')::INT + contains(lower(source),'the')::INT))/3.0, 6)::DOUBLE AS score
 FROM documents WHERE contains(lower(text),'license') OR contains(lower(text),'reserved') OR contains(lower(text),'the') ORDER BY score DESC, doc_id LIMIT 30""")
def search_documents(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id", "source", "text")
    got = search.search(docs, _TERMS, "source", "text", "source", "doc_id", limit=30)["items"]
    return got.select("doc_id", "source", F.round(F.col("score") - trigram.similarity(F.col("source"), F.lit(_TERMS)), 6).alias("score"))


# What the searched terms are in the tables' documents: one in a few, one in many, one with a blank, one in none.
_RARE = "licen the, reserved zzqqzz"
_GRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w<>''), lambda w: list_transform(range(1, length(w)+2), lambda k: substr('  '||w||' ', k, 3)))))"""


@query(f"""WITH q AS (SELECT *, {_GRAMS.format("coalesce(source,'')")} AS a, {_GRAMS.format(f"'{_RARE}'")} AS b FROM documents), h AS (SELECT unnest(['licen','the,','reserved','zzqqzz']) AS term),
 m AS (SELECT q.doc_id, any_value(q.source) AS source, sum(3.0*contains(lower(coalesce(text,'')),term)::INT + 2.0*contains(lower(coalesce(source,'')),term)::INT)/4 AS hits,
 any_value(len(list_intersect(a,b))::DOUBLE / greatest(len(list_distinct(list_concat(a,b))), 1)) AS likeness FROM q CROSS JOIN h GROUP BY q.doc_id)
 SELECT doc_id, source, round(hits + likeness, 9)::DOUBLE AS score FROM m WHERE hits > 0 ORDER BY hits + likeness DESC, doc_id LIMIT 100""")
def search_by_grams(t: Tables) -> DataFrame:
    """The first page for four terms by the whole score, similarity of the title included, through a trigram index of all documents."""
    docs = t("documents").select("doc_id", "source", "text")
    spark = docs.sparkSession
    index = gram_index.GramIndex.build(docs, ["source", "text"], shared.new_path(spark, "gram-index"))
    found = search.indexed_search(spark, index, _RARE, "source", "text", "source", "doc_id", limit=100)["items"]
    return found.select("doc_id", "source", F.round("score", 9).alias("score"))


@query("""WITH h AS (SELECT unnest(['licen','of the','reserved','zzqqzz','th','日本','. the ']) AS term)
 SELECT term, count(doc_id)::BIGINT AS docs, coalesce(sum(doc_id),0)::BIGINT AS ids FROM h LEFT JOIN documents ON contains(lower(text), term) GROUP BY 1""")
def grams_by_term(t: Tables) -> DataFrame:
    """How many documents have each of several terms, each found through the index and tested exactly."""
    docs = t("documents").select("doc_id", "text")
    spark = docs.sparkSession
    index = gram_index.GramIndex.build(docs, ["text"], shared.new_path(spark, "gram-index"))
    parts = []
    for term in ["licen", "of the", "reserved", "zzqqzz", "th", "日本", ". the "]:
        found = index.candidates(spark, [term]).where(search.has(F.col("text"), term))
        parts.append(found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("doc_id"), F.lit(0).cast("long")).alias("ids")).select(F.lit(term).alias("term"), "docs", "ids"))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT source, count(*)::BIGINT AS n FROM documents WHERE lang='en' AND (contains(lower(text),'license') OR contains(lower(text),'reserved')) GROUP BY 1""")
def search_facets(t: Tables) -> DataFrame:
    filters = {"lang": F.col("lang") == "en", "source": F.col("source") == "src1"}
    return search.search(t("documents"), "license reserved", "source", "text", "source", "doc_id", filters)["facets"]


@query("""WITH h AS (SELECT doc_id, text, least(nullif(instr(text,'License'),0), nullif(instr(text,'reserved'),0)) AS a FROM documents), p AS (SELECT *, greatest(a-70,1) AS s, a+70 AS e FROM h)
 SELECT doc_id, CASE WHEN a IS NULL THEN substr(text,1,140) ELSE (CASE WHEN s>1 THEN '…' ELSE '' END) || substr(text, s, e-s) || (CASE WHEN e<=length(text) THEN '…' ELSE '' END) END AS snippet FROM p""")
def snippet(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.snippet(F.col("text"), ["License", "reserved"]).alias("snippet"))


@query("""WITH g AS (SELECT item_id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w<>''), lambda w: list_transform(range(1, length(w)+2), lambda k: substr('  '||w||' ', k, 3))))) AS a,
 list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower('the other of and'), '[^\\p{L}\\p{N}]+'), lambda w: w<>''), lambda w: list_transform(range(1, length(w)+2), lambda k: substr('  '||w||' ', k, 3))))) AS b FROM benchmark)
 SELECT item_id, round(len(list_intersect(a,b))::DOUBLE / len(list_distinct(list_concat(a,b))), 9) AS similarity FROM g""")
def trigram_similarity(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.round(trigram.similarity(F.col("text"), F.lit("the other of and")), 9).alias("similarity"))


@query("""SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, json_extract_string(props,'$.k') IS NOT NULL AS has_k FROM events""")
def json_path(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", k.cast("long").alias("k"), k.isNotNull().alias("has_k"))


@query("""WITH a AS (SELECT page_id, regexp_replace(coalesce(html,''), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '<\\s*(?:br|/p|/div|/li|/tr|/h\\d)\\b[^>]*>', chr(10), 'gi') AS t FROM a),
 c AS (SELECT page_id, regexp_replace(t, '<[^>]+>', '', 'g') AS t FROM b),
 d AS (SELECT page_id, replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&middot;','·'),'&copy;?','©','g'),'&amp;?','&','g'), chr(160), ' ') AS t FROM c),
 e AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM d)
 SELECT page_id, coalesce(array_to_string(l, chr(10)), '') AS body FROM e""")
def html_to_text(t: Tables) -> DataFrame:
    """Pages as text. The SQL decodes the entities that these pages have; all others are tested on golden rows."""
    return t("pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


# RE2 has no look-around: the characters around a number are taken along and put back, twice, as two numbers may share one.
_PHONES = r"(^|[^0-9.])(?:0[0-9]{1,2}[)-]\s?[0-9]{3,4}-[0-9]{4}|1[568][0-9]{2}-[0-9]{4})([^0-9]|$)"
_BARE = r"\((?:[0-9]{3}|[03-9][0-9]{3}|1[0-8][0-9]{2}|2[1-9][0-9]{2})-[0-9]{4}\)"


@query(f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_PHONES}', '\\1연락처 생략\\2', 'g'), '{_PHONES}', '\\1연락처 생략\\2', 'g') AS t FROM documents)
 SELECT doc_id, regexp_replace(regexp_replace(t, '{_BARE}', '(연락처 생략)', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '이메일 생략', 'g') AS text FROM a""")
def redact(t: Tables) -> DataFrame:
    """Documents with phones and mail addresses masked; names before ranks, which these texts have none of, are tested on golden rows."""
    return t("documents").select("doc_id", text.redact(F.col("text")).alias("text"))


_HEADS = """SELECT split_part(trim(text), ' ', 1) AS name FROM benchmark UNION SELECT split_part(trim(text), ' ', 1) || ' ' || split_part(trim(text), ' ', 2) FROM benchmark UNION SELECT 'Licen' UNION SELECT 'License'"""


@query(f"""WITH n AS ({_HEADS}), p AS (SELECT string_agg(regexp_escape(name), '|' ORDER BY length(name) DESC, name) AS pattern FROM n WHERE name <> ''),
 m AS (SELECT doc_id, unnest(regexp_extract_all(text, pattern)) AS name FROM documents, p) SELECT name, count(*)::BIGINT AS mentions, count(DISTINCT doc_id)::BIGINT AS docs FROM m GROUP BY 1""")
def name_mentions(t: Tables) -> DataFrame:
    """How often documents mention the names that benchmark texts begin with: their first word and their first two, of which the longer wins."""
    first = F.split(F.trim("text"), " ")
    heads = t("benchmark").select(F.explode(F.array(first[0], F.concat_ws(" ", F.slice(first, 1, 2)))).alias("name")).distinct()
    # A register of names: two for each of the benchmark's items.
    register = names.Names.of([r.name for r in heads.collect() if r.name] + ["Licen", "License"])
    rows = t("documents").select("doc_id", F.explode(names.found("text", register)).alias("m"))
    return rows.groupBy(F.col("m.name").alias("name")).agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


@query()
def document_differences(t: Tables) -> DataFrame:
    """Each document against the one before it: numbers of runs and of characters kept, removed and added.

    The first four are null where the service shows no differences, as the texts are too long; the whole_ ones are those of all pairs.
    """
    docs = t("documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    return difference_sizes(docs.join(before, "doc_id"), "doc_id", "before", "text", whole=True)
