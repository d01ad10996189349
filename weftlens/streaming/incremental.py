"""Incremental runs with Structured Streaming: new files in, each row once out."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.sources import shared

#: Keys live in the state store of this provider: on disk, with a change log for each batch.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEED = "_weft_known"


def _adopt(spark: SparkSession, target: str) -> None:
    """Files that lie in the target itself become its first batch, as Spark reads folders of batches or plain files, not both."""
    fs, where = shared.place(spark, target)
    plain = [f.getPath() for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if plain:
        _, before = shared.place(spark, f"{target}/batch=before")
        fs.mkdirs(before)
        for path in plain:
            fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(before, path.getName()))


def append_new(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, pattern: str = "*.parquet") -> None:
    """Take all files that are new since the last run and append the rows whose keys the target does not have.

    Keys are remembered without a bound in time, in the state store beside the
    checkpoint: a late row is taken, a repeated one never, and a run reads what
    is new and looks up its keys, however long the target has grown. Only where a
    checkpoint begins are the target's keys read, once, and put into the state.
    Of rows with one key in a batch one is taken. Null keys equal each other.

    A batch is written to a folder with its own name, which is written over when
    a batch is run again after a failure, so that nothing is there twice. One
    checkpoint at a time appends to a target. read_appended() reads the target.
    """
    seeds = f"{checkpoint}-known"
    if not shared.exists(spark, f"{checkpoint}/offsets"):
        known = prepare(spark.createDataFrame([], schema))
        if shared.exists(spark, target):
            _adopt(spark, target)
            known = read_appended(spark, target, known.schema)
        known.select(*keys).distinct().write.mode("overwrite").parquet(seeds)
    rows = prepare(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)).withColumn(_SEED, F.lit(False))
    shape = StructType([rows.schema[k] for k in keys])
    old = spark.readStream.schema(shape).parquet(seeds)
    blank = [F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != _SEED]
    stream = rows.unionByName(old.select(*blank).withColumn(_SEED, F.lit(True))).dropDuplicates(keys)

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.where(~F.col(_SEED)).drop(_SEED)
        if number == 0:  # the batch in which the target's keys enter the state: they may have come after a row of theirs
            held = spark.read.schema(shape).parquet(seeds)
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
            fresh = fresh.alias("a").join(held.alias("b"), same, "left_anti")
        # Named by the checkpoint too, so that the next one's batches stand beside it.
        fresh.write.mode("overwrite").parquet(f"{target}/batch={zlib.crc32(checkpoint.encode()):08x}-{number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read_appended(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """All rows that append_new() has written, and those that lay in the target before."""
    return spark.read.schema(schema).parquet(target).select(*schema.names)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str, late: str) -> DataFrame:
    """Counts by kind in tumbling windows; works on a stream, where rows later than ``late`` are dropped, and on a table."""
    timed = events.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", size).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")
