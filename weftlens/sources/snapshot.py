"""Snapshots for clients that read files by byte ranges.

Entities are JSON lines in a bounded number of files, sorted by key over all of
them, and an index says in which file, where and how long each one is. A
snapshot becomes current by one rename; a run that fails leaves the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlens.sources import shared, store


def write(rows: DataFrame, path: str, key: str, files: int = 16) -> None:
    """Write rows as ``files`` files of lines at most, whatever their number, and swap in their index.

    Rows of one key lie side by side. The index has key (as text), folder, file,
    start and bytes, sorted by key. Rows with a null key are left out, as no
    client can ask for them. The snapshot before stays for its readers; what is
    older goes.
    """
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    # The key stands before its line as JSON of its own, which has no tab, so that it is read back without parsing the line.
    head = F.to_json(F.struct(F.col("_key").alias("k")))
    lines = named.select("_key", F.concat(head, F.lit("\t"), "value").alias("value")).repartitionByRange(files, "_key").sortWithinPartitions("_key", "value")
    lines.select("value").write.text(f"{path}/{folder}", lineSep="\n")
    found = spark.read.text(f"{path}/{folder}", lineSep="\n").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    found = found.withColumn("head", F.split_part("value", F.lit("\t"), F.lit(1))).withColumn("key", F.get_json_object("head", "$.k"))
    # As the lines lie in the file: sorted by key and line.
    before = F.sum((F.octet_length("value") + 1).cast("long")).over(Window.partitionBy("file").orderBy("key", "value").rowsBetween(Window.unboundedPreceding, -1))
    skip = F.octet_length("head") + 1
    index = found.select("key", F.lit(folder).alias("folder"), "file", (F.coalesce(before, F.lit(0).cast("long")) + skip).alias("start"), (F.octet_length("value") - skip).alias("bytes"))
    old = _folders(spark, path)
    store.swap(index.repartitionByRange(files, "key").sortWithinPartitions("key", "start"), f"{path}/index")
    fs, where = shared.place(spark, path)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("data-") and name != folder and name not in old:
            fs.delete(status.getPath(), True)


def _folders(spark: SparkSession, path: str) -> set[str]:
    """The folders of the current snapshot: one."""
    if store.version(spark, f"{path}/index") is None:
        return set()
    return {r.folder for r in index(spark, path).select("folder").distinct().collect()}


def index(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot's index."""
    return spark.read.schema("key string, folder string, file string, start long, bytes int").parquet(f"{path}/index/{store.version(spark, f'{path}/index')}")


def entity(spark: SparkSession, path: str, key: str) -> list[dict]:
    """The rows of one key, read by their byte ranges; none for an unknown key."""
    out = []
    for r in index(spark, path).where(F.col("key") == key).orderBy("start").collect():
        fs, where = shared.place(spark, f"{path}/{r.folder}/{r.file}")
        stream = fs.open(where)
        try:
            stream.seek(r.start)
            out.append(json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r.bytes)).decode()))
        finally:
            stream.close()
    return out
