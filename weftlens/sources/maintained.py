"""Figures of articles that are kept up to date by signed deltas.

Three tables lie in folders by a hash of their key: ``pairs`` (an article and a
document that cites it, with the number of links and what the document counts
as), the same pairs by document (``docs``), and ``stats``, one row an article. A
change of links or documents touches pairs; what a pair counted before is taken
off and what it counts now is added, so that counts of distinct documents fall
again, too. A maximum cannot be taken off: it is made anew from its pairs, for
the articles that have lost theirs. Only folders with a touched key are written;
a manifest, swapped by one rename, says which version of each folder is current.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.sources import shared, store

# The kinds of documents that each count takes.
KINDS = {"interpretations": ["법령해석"], "no_action": ["비조치의견"], "guidance": ["행정지도"], "notices": ["입법예고", "규정변경예고"]}
COUNTS = ["total", *KINDS]
PAIRS = "key string, doc_id string, n long, kind string, published_on date, known boolean"
STATS = f"key string, {', '.join(f'{c} long' for c in COUNTS)}, latest_on date"
SCHEMAS = {"pairs": PAIRS, "docs": "doc_id string, key string", "stats": STATS}
OF = {"pairs": "key", "docs": "doc_id", "stats": "key"}
MANIFEST = "name string, bucket int, version string, batch string"


def _counts(kind: Column, sign: Column) -> list[Column]:
    """Sums of signs for each count."""
    return [F.sum(sign).alias("total"), *[F.sum(F.when(kind.isin(v), sign).otherwise(0)).alias(n) for n, v in KINDS.items()]]


@dataclass(frozen=True)
class ArticleStats:
    """The figures under ``path``, in ``buckets`` folders a table."""

    path: str
    buckets: int = 64

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{store.version(spark, f'{self.path}/manifest')}")

    def _write(self, rows: DataFrame, name: str, version: str) -> None:
        """Rows into their folders of a new version, one file each."""
        key = OF[name]
        out = rows.withColumn("bucket", self._bucket(key))
        out.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/{name}/{version}")

    def _read(self, spark: SparkSession, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as the manifest has it, or some of its folders. The manifest has a line for each folder."""
        found = self._manifest(spark).where(F.col("name") == name)
        places = [r for r in found.collect() if buckets is None or r.bucket in set(buckets)]
        schema = StructType.fromDDL(SCHEMAS[name])
        paths = [f"{self.path}/{name}/{r.version}/bucket={r.bucket}" for r in places]
        there = [p for p in paths if shared.exists(spark, p)]
        return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)

    def build(self, links: DataFrame, documents: DataFrame) -> None:
        """All tables from links (key, doc_id) and documents (id, kind, published_on)."""
        version = f"v-{uuid.uuid4().hex}"
        spark = links.sparkSession
        pairs = shared.store(self._known(links.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key", "doc_id").agg(F.count("*").alias("n")), documents), "pairs")
        for name, rows in (("pairs", pairs), ("docs", pairs.select("doc_id", "key")), ("stats", self._whole(pairs))):
            self._write(rows, name, version)
        lines = spark.range(self.buckets).select(F.explode(F.array(*map(F.lit, SCHEMAS))).alias("name"), F.col("id").cast("int").alias("bucket"), F.lit(version).alias("version"), F.lit("").alias("batch"))
        store.swap(lines.coalesce(1), f"{self.path}/manifest")
        shared.drop(pairs)

    @staticmethod
    def _known(pairs: DataFrame, documents: DataFrame) -> DataFrame:
        """pairs with what their documents count as; a link to a document that is not there counts nothing."""
        docs = documents.where("id IS NOT NULL").groupBy(F.col("id").alias("doc_id")).agg(F.max(F.struct("kind", "published_on")).alias("d"))
        return pairs.join(docs, "doc_id", "left").select("key", "doc_id", "n", "d.kind", "d.published_on", F.col("d").isNotNull().alias("known"))

    @staticmethod
    def _whole(pairs: DataFrame) -> DataFrame:
        return pairs.where("known").groupBy("key").agg(*_counts(F.col("kind"), F.lit(1).cast("long")), F.max("published_on").alias("latest_on"))

    def stats(self, spark: SparkSession) -> DataFrame:
        """key, total, a count for each group of kinds, latest_on: as a rebuild would give them."""
        return self._read(spark, "stats")

    def folders(self, spark: SparkSession) -> dict[tuple[str, int], str]:
        """The current version of each folder."""
        return {(r.name, r.bucket): r.version for r in self._manifest(spark).collect()}

    def apply(self, links: DataFrame, changed: DataFrame, documents: DataFrame, batch: str) -> bool:
        """Takes a batch of changes in; False, with nothing done, where it was the last one taken in.

        links: key, doc_id, sign (1 for a link that came, -1 for one that went);
        they add up, and a pair has no fewer than 0. changed: id, kind,
        published_on, gone: documents as they are now. documents: where documents
        of new pairs are looked up that are not among the changed ones. The cost
        follows the folders of the touched keys. A run that fails leaves the
        manifest, and so all figures, as they were.
        """
        spark = links.sparkSession
        manifest = self._manifest(spark)
        if manifest.where(F.col("batch") == batch).limit(1).count():
            return False
        moved = links.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key", "doc_id").agg(F.sum("sign").cast("long").alias("dn")).where("dn <> 0")
        now = changed.where("id IS NOT NULL").groupBy(F.col("id").alias("doc_id")).agg(F.max(F.struct("kind", "published_on", "gone")).alias("now"))
        now = shared.store(now, "changed-documents")
        near = self._read(spark, "docs", self._folders(now, "doc_id")).join(now.select("doc_id"), "doc_id", "left_semi").select("key", "doc_id", F.lit(0).cast("long").alias("dn"))
        touched = shared.store(moved.unionByName(near).groupBy("key", "doc_id").agg(F.sum("dn").alias("dn")), "touched-pairs")
        folders = self._folders(touched, "key")
        if not folders:
            store.swap(manifest.withColumn("batch", F.lit(batch)).coalesce(1), f"{self.path}/manifest")
            return True
        old = self._read(spark, "pairs", folders).withColumn("old", F.struct("n", "kind", "published_on", "known")).select("key", "doc_id", "old")
        rows = old.join(touched, ["key", "doc_id"], "full_outer").join(now, "doc_id", "left")
        fresh = rows.where("old IS NULL AND now IS NULL").select("doc_id").distinct()
        found = documents.join(fresh.withColumnRenamed("doc_id", "id"), "id", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.max(F.struct("kind", "published_on")).alias("found"))
        rows = rows.join(found, "doc_id", "left").withColumn("m", F.greatest(F.coalesce("old.n", F.lit(0).cast("long")) + F.coalesce("dn", F.lit(0).cast("long")), F.lit(0).cast("long")))
        case = lambda field: F.when(F.col("now").isNotNull(), F.col(f"now.{field}")).when(F.col("old").isNotNull(), F.col(f"old.{field}")).otherwise(F.col(f"found.{field}"))
        here = F.when(F.col("now").isNotNull(), ~F.coalesce("now.gone", F.lit(False))).when(F.col("old").isNotNull(), F.col("old.known")).otherwise(F.col("found").isNotNull())
        rows = rows.withColumn("new", F.when(F.col("m") > 0, F.struct(F.col("m").alias("n"), F.when(here, case("kind")).alias("kind"), F.when(here, case("published_on")).alias("published_on"), here.alias("known"))))
        rows = shared.store(rows.select("key", "doc_id", "old", "new", F.col("dn").isNotNull().alias("touched")), "pairs-after")
        version = f"v-{uuid.uuid4().hex}"
        after = rows.where("new IS NOT NULL").select("key", "doc_id", "new.*")
        self._write(after, "pairs", version)
        # What a touched pair counted is taken off, what it counts now is added.
        signs = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("sign"), F.col("old").alias("v")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("new").alias("v"))))
        deltas = rows.where("touched AND NOT (old <=> new)").select("key", signs.alias("s")).where("s.v.known").select("key", "s.sign", "s.v.kind", "s.v.published_on")
        date = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("published_on")))
        change = deltas.groupBy("key").agg(*_counts(F.col("kind"), F.col("sign")), date(1).alias("came"), date(-1).alias("went"))
        change = shared.store(change.select("key", F.struct(*COUNTS, "came", "went").alias("d")), "stats-deltas")
        held = self._read(spark, "stats", self._folders(change, "key"))
        both = held.select("key", F.struct(*COUNTS, "latest_on").alias("h")).join(change, "key", "full_outer")
        zero = F.lit(0).cast("long")
        sums = [(F.coalesce(f"h.{c}", zero) + F.coalesce(f"d.{c}", zero)).alias(c) for c in COUNTS]
        lost = F.coalesce(F.col("d.went") == F.col("h.latest_on"), F.lit(False))
        both = shared.store(both.select("key", *sums, F.greatest("h.latest_on", "d.came").alias("latest_on"), lost.alias("lost")), "stats-after")
        again = after.where("known").join(both.where("lost").select("key"), "key", "left_semi").groupBy("key").agg(F.max("published_on").alias("rebuilt"))
        out = both.join(again, "key", "left").where("total > 0").select("key", *COUNTS, F.when(F.col("lost"), F.col("rebuilt")).otherwise(F.col("latest_on")).alias("latest_on"))
        self._write(out, "stats", version)
        # Pairs that came or went, by document.
        turned = shared.store(rows.where("(old IS NULL) <> (new IS NULL)").select("doc_id", "key", F.col("new").isNotNull().alias("came")), "docs-turned")
        listed = self._read(spark, "docs", self._folders(turned, "doc_id"))
        listed = listed.join(turned.where("NOT came"), ["doc_id", "key"], "left_anti").unionByName(turned.where("came").select("doc_id", "key"))
        self._write(listed, "docs", version)
        new = {"pairs": folders, "stats": self._folders(change, "key"), "docs": self._folders(turned, "doc_id")}
        moved_on = F.lit(False)
        for name, numbers in new.items():
            if numbers:
                moved_on = moved_on | ((F.col("name") == name) & F.col("bucket").isin(numbers))
        lines = manifest.select("name", "bucket", F.when(moved_on, F.lit(version)).otherwise(F.col("version")).alias("version"), F.lit(batch).alias("batch"))
        store.swap(lines.coalesce(1), f"{self.path}/manifest")
        shared.drop(now, touched, rows, change, both, turned)
        return True

    def _folders(self, rows: DataFrame, key: str) -> list[int]:
        """The folders of some keys: ``buckets`` at most."""
        return sorted(r[0] for r in rows.select(self._bucket(key)).distinct().collect())
