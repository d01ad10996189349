"""Table maintenance as set operations: read the old state, join the new rows, write a new state.

Parquet tables have no MERGE, so each operator returns the state to write to a
new path; swap() then makes it current.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Content-addressed insert: incoming rows, one for each key, whose key is not there yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(incoming: DataFrame, existing: DataFrame, key: str, keep_old_if_null: list[str]) -> DataFrame:
    """Incoming rows replace existing ones; in the columns named a null keeps the old value."""
    old, new = existing.alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    columns = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in existing.columns:
        if c != key:
            taken = F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old_if_null else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
            columns.append(taken.alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by a unit separator; null counts as empty."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\u001f")) for p in parts]), 256)


def classify(incoming: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, changed or same, by comparing digests."""
    old = existing.select(F.col(key), F.col(digest).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(digest), "same").otherwise("changed")
    return incoming.join(old, key, "left").select(key, state.alias("state"))


def upsert_by_hash(incoming: DataFrame, existing: DataFrame, key: str, at: Column) -> DataFrame:
    """The state after an upsert of rows by the hash of all their columns, with ``state``: new, changed, same or kept.

    existing has incoming's columns, first_seen_at, changed_at and digest. A
    changed row keeps when it was first seen; a same row keeps both times.
    """
    names = [c for c in existing.columns if c not in ("first_seen_at", "changed_at", "digest")]
    fresh = incoming.select(*names).withColumn("digest", content_hash(*[F.col(c) for c in names]))
    old, new = existing.select(F.struct("*").alias("o"), F.col(key).alias("k")), fresh.select(F.struct("*").alias("n"), F.col(key).alias("k"))
    both = old.join(new, "k", "full_outer")
    state = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "new").when(F.col("o.digest") == F.col("n.digest"), "same").otherwise("changed")
    taken = [F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in [*names, "digest"]]
    rows = both.withColumn("state", state)
    first, changed = F.coalesce("o.first_seen_at", at), F.when(F.col("state").isin("new", "changed"), at).otherwise(F.col("o.changed_at"))
    return rows.select(*taken, first.alias("first_seen_at"), changed.alias("changed_at"), "state")


def by_priority(rows: DataFrame, keys: list[str], origin: str, order: list[str]) -> DataFrame:
    """One row for each key, with the origin that comes first in ``order``: a better origin is never downgraded."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(origin))
    return rows.groupBy(*keys).agg(F.min_by(origin, F.when(rank > 0, rank).otherwise(len(order) + 1)).alias(origin))


def replace_per_key(old: DataFrame, new: DataFrame, key: str, reviewed: str, target: str, targets: DataFrame, evidence: str | None = None, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows whose target is missing): new rows replace a key's old ones but for reviewed ones.

    evidence: a column that is cut to ``most`` characters. Rows without their target carry the reason article_not_loaded.
    """
    if evidence:
        new = new.withColumn(evidence, F.substring(evidence, 1, most))
    touched = new.select(key).distinct()
    kept = old.where(F.col(reviewed)).unionByName(old.where(~F.col(reviewed)).join(touched, key, "left_anti"))
    good = new.join(targets.select(target), target, "left_semi")
    lost = new.join(targets.select(target), target, "left_anti").withColumn("reason", F.lit("article_not_loaded"))
    fresh = good.join(kept.select(key, target), [key, target], "left_anti")
    return kept.unionByName(fresh), lost


def append_events(events: DataFrame, log: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Events that the log does not have; the set of known keys is not bounded in time."""
    return new_rows(events, log, [key])


def prune(keys: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows whose column has none of the keys left."""
    return {name: df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi") for name, (df, column) in tables.items()}


def prune_laws(laws: DataFrame, scope: DataFrame, tables: dict[str, DataFrame], raw: DataFrame) -> dict[str, DataFrame]:
    """All tables without the laws out of scope (slug), and raw with their statutes unmarked, so that they can be parsed again.

    tables: articles (key, slug), versions and links (key), delegations
    (from_key, to_key), documents (primary_law), events (law_slug, key).
    """
    kept = laws.join(scope.select("slug").distinct(), "slug", "left_semi")
    gone = laws.join(scope.select("slug"), "slug", "left_anti").select("slug")
    articles = tables["articles"].join(kept.select("slug"), "slug", "left_semi")
    keys = articles.select("key")
    has = lambda df, column: df.join(keys.select(F.col("key").alias(column)), column, "left_semi")
    lost = gone.withColumn("lost", F.lit(True))
    flag = lambda df, column, names: df.join(lost.withColumnRenamed("slug", column), column, "left").select(*names, "lost")
    docs = flag(tables["documents"], "primary_law", tables["documents"].columns)
    out = {"laws": kept, "articles": articles, "versions": has(tables["versions"], "key"), "links": has(tables["links"], "key"), "delegations": has(has(tables["delegations"], "from_key"), "to_key")}
    out["documents"] = docs.withColumn("primary_law", F.when(F.col("lost").isNull(), F.col("primary_law"))).drop("lost")
    events = tables["events"].join(gone.withColumnRenamed("slug", "law_slug"), "law_slug", "left_anti")
    dead = tables["articles"].join(gone, "slug", "left_semi").select("key")
    out["events"] = events.join(dead, "key", "left_anti").select(*tables["events"].columns)
    slug = F.when(F.col("source").isin("lawgo.law", "lawgo.admrul"), F.split_part("source_key", F.lit(":"), F.lit(1)))
    marked = flag(raw.withColumn("slug_", slug), "slug_", raw.columns)
    out["raw"] = marked.withColumn("parsed_at", F.when(F.col("lost").isNull(), F.col("parsed_at"))).drop("lost")
    return out


def swap(state: DataFrame, path: str) -> None:
    """Write the state as a new version under path and make it current.

    The pointer is a small file that a rename replaces, so at each moment it
    names a whole version; current() follows it. The version before stays for
    those who still read it, older ones go.
    """
    jvm, conf = state.sparkSession._jvm, state.sparkSession._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    fs = at().getFileSystem(conf)
    before = version(state.sparkSession, path)
    name = f"version-{uuid.uuid4().hex}"
    state.write.parquet(f"{path}/{name}")
    out = fs.create(at(f"pointer-{name}"), True)
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = state.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(at(f"pointer-{name}")), fs.makeQualified(at("pointer")), overwrite)
    for found in fs.listStatus(at()):
        if found.getPath().getName().startswith("version-") and found.getPath().getName() not in (name, before):
            fs.delete(found.getPath(), True)


def version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that swap() made current; None before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state that swap() wrote last."""
    return spark.read.parquet(f"{path}/{version(spark, path)}")
