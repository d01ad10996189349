"""Raw payloads: landing files, parsing into documents, export and import, catalogue.

Collecting over HTTP is left to whatever fills the landing folder; from there
on a payload is a row (source, source_key, content_hash, fetched_at, payload).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftlens.functions import text as T
from weftlens.sources import store

RAW = "source string, source_key string, content_hash string, fetched_at timestamp, http_status int, payload string, parsed_at timestamp"
# The headings that make a table of a page relevant, and the fields that hold personal data.
TABLE_HEADINGS = "질의요지|회답|이유"
PERSONAL_KEYS = ["regId", "regNm", "담당자명", "담당자", "전화번호", "부서연락처", "담당자연락처"]


def land(payloads: DataFrame, raw: DataFrame) -> DataFrame:
    """Payloads (source, source_key, http_status, payload, fetched_at) that raw does not have, by content."""
    hashed = payloads.withColumn("content_hash", store.content_hash(F.col("payload"))).withColumn("parsed_at", F.lit(None).cast("timestamp"))
    return store.new_rows(hashed.select(*raw.columns), raw, ["source", "source_key", "content_hash"])


def unparsed(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Rows without a processing mark, current copies before pending ones, then by their third key part."""
    rows = raw.where(F.col("parsed_at").isNull() & (F.col("source") == source if source else F.lit(True)))
    pending = F.get_json_object("payload", "$.meta.version") == "pending"
    return rows.orderBy("fetched_at", F.coalesce(pending, F.lit(False)), F.split_part("source_key", F.lit(":"), F.lit(3)), "source_key")


def mark_parsed(raw: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """raw with the mark set on the keys (source, source_key, content_hash)."""
    names = ["source", "source_key", "content_hash"]
    done = keys.select(*names).distinct().withColumn("_done", F.lit(True))
    return raw.join(done, names, "left").withColumn("parsed_at", F.when(F.col("_done"), at).otherwise(F.col("parsed_at"))).select(*raw.columns)


def content_tables(page: Column) -> Column:
    """Only the tables of a page with a relevant heading; the whole page where none has one."""
    tables = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1)), lambda x: x.rlike(TABLE_HEADINGS))
    return F.when(F.size(tables) > 0, F.array_join(tables, "\n")).otherwise(page)


def cell(page: Column, label: str) -> Column:
    """The text of the cell after the heading ``label``; null if there is none."""
    found = F.regexp_extract(page, rf"(?is)<th[^>]*>\s*{label}\s*</th>\s*<td[^>]*>(.*?)</td>", 1)
    return F.nullif(T.html_to_text(found), F.lit(""))


def parse_replies(raw: DataFrame) -> DataFrame:
    """Document rows of reply payloads {list: {dataIdx, title, replyRegDate, pastreqType}, html}.

    The date is the reply's, else the list's, else that of a file name that begins with YYMMDD_.
    """
    item = lambda name: F.get_json_object("payload", f"$.list.{name}")
    page = F.get_json_object("payload", "$.html")
    file_day = F.try_to_date(F.nullif(F.regexp_extract(page, r"(?:^|[^\d])(\d{6})_", 1), F.lit("")), "yyMMdd")
    rows = raw.select(
        F.concat_ws(":", "source", "source_key").alias("id"), item("title").alias("title"), T.department(cell(page, "담당부서")).alias("dept"), T.redact(cell(page, "질의요지")).alias("question"),
        T.redact(cell(page, "회답")).alias("answer"), T.redact(cell(page, "이유")).alias("reason"), F.coalesce(T.ymd(cell(page, "회신일")), T.ymd(item("replyRegDate")), file_day).alias("published_on"),
    )
    return rows.withColumn("search_text", search_text("title", "question", "answer", "reason"))


def parse_guidance(raw: DataFrame) -> DataFrame:
    """Document rows of guidance payloads; empty dates become null."""
    item = lambda name: F.get_json_object("payload", f"$.{name}")
    return raw.select(
        F.concat_ws(":", "source", "source_key").alias("id"), item("title").alias("title"), item("rootDpNm").alias("org"), T.department(item("dpNm")).alias("dept"), item("_stage").alias("stage"),
        T.ymd(item("regDate")).alias("published_on"), T.ymd(item("eventStartDate")).alias("valid_from"), T.ymd(item("eventEndDate")).alias("valid_to"),
    )


def search_text(title: str, *others: str) -> Column:
    """What search reads: the title and all other fields, with a blank between them even where one is null."""
    return F.concat(F.coalesce(title, F.lit("")), *[F.concat(F.lit(" "), F.coalesce(c, F.lit(""))) for c in others])


def _bare(value):
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if k not in PERSONAL_KEYS}
    return [_bare(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def _without_personal(payload: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        try:
            return json.dumps(_bare(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return text

    return payload.map(one, na_action="ignore")


def without_personal(payload: Column) -> Column:
    """A JSON text without its personal fields, whatever they hold, at any depth.

    Texts that name no such field, and texts that are no JSON, stay as they are.
    """
    named = payload.rlike("|".join(f'"{k}"' for k in PERSONAL_KEYS) + r"|\\u")
    return F.coalesce(_without_personal(F.when(named, payload)), payload)


def scrub(raw: DataFrame) -> DataFrame:
    """raw with personal data masked and hashes made anew; changed reply rows lose their processing mark."""
    clean = T.redact(without_personal(F.col("payload")))
    rows = raw.withColumn("_p", clean).withColumn("_changed", ~F.col("_p").eqNullSafe(F.col("payload")))
    rows = rows.withColumn("parsed_at", F.when(F.col("_changed") & F.startswith("source", F.lit("fsc.")), F.lit(None)).otherwise(F.col("parsed_at")))
    rows = rows.withColumn("payload", F.col("_p")).withColumn("content_hash", F.when(F.col("_changed"), store.content_hash(F.col("_p"))).otherwise(F.col("content_hash")))
    return rows.select(*raw.columns).dropDuplicates(["source", "source_key", "content_hash"])


def dump(raw: DataFrame, path: str) -> None:
    raw.write.mode("overwrite").option("compression", "gzip").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def search_index(documents: DataFrame, links: DataFrame, articles: DataFrame, laws: DataFrame, length: int = 600) -> DataFrame:
    """Per document the head of its search text and its articles as JSON, '[]' without any: an index for clients.

    links: doc_id, key; articles: key, slug, label, title; laws: slug, name, kind, parent.
    """
    cited = links.select("doc_id", "key").distinct().join(articles.select("key", "slug", "label", "title"), "key")
    cited = cited.join(laws.select("slug", F.col("name").alias("law_name"), F.col("kind").alias("law_kind"), F.coalesce("parent", "slug").alias("law_root")), "slug")
    listed = cited.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", "label", "title", "law_name", "law_kind", "law_root")))).alias("articles"))
    rows = documents.join(listed, documents["id"] == listed["doc_id"], "left").drop("doc_id")
    return rows.withColumn("search_text", F.substring("search_text", 1, length)).withColumn("articles", F.coalesce("articles", F.lit("[]")))


def catalogue(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, references: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(table, position, column, type, nullable, is_key, refers_to, rows) of tables.

    keys: the key columns of a table; references: (table, column) -> the table that it points to.
    """
    spark, keys, references = next(iter(tables.values())).sparkSession, keys or {}, references or {}
    rows = [(name, k, f.name, f.dataType.simpleString(), f.nullable, f.name in keys.get(name, []), references.get((name, f.name))) for name, df in tables.items() for k, f in enumerate(df.schema)]
    columns = spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean, is_key boolean, refers_to string")
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return columns.join(reduce(DataFrame.unionByName, counts), "table")


RUNS = "stage string, source string, status string, started_at timestamp, finished_at timestamp, stats string, error string"


@contextmanager
def logged_run(spark: SparkSession, path: str, stage: str, source: str) -> Iterator[dict]:
    """Runs a block and appends its row to the log of runs under path.

    The block gets a dict for its figures. It is ok, or partial where a figure
    ``errors`` is above 0; where it raises, the run is failed, with the error's
    first 500 characters, and the error goes on.
    """
    began, stats, error = dt.datetime.now(dt.UTC), {}, None
    try:
        yield stats
    except Exception as e:
        error = f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        status = "failed" if error else "partial" if int(stats.get("errors", 0)) > 0 else "ok"
        row = (stage, source, status, began, dt.datetime.now(dt.UTC), json.dumps(stats, ensure_ascii=False, sort_keys=True, default=str), error)
        spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)
