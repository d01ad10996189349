"""Intermediate tables in the folder that the cluster shares.

A lost executor must not take an intermediate result with it, so lineage is
cut by writing Parquet under ``spark.checkpoint.dir`` and reading it again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL: list[str] = []
#: Rows of a partition of dealt().
ROWS = 500_000


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the session names none and runs on this machine alone (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="weftlens-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def place(spark: SparkSession, path: str):
    """(file system, path) of a file or folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = place(spark, path)
    return fs.exists(where)


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df and return it as read back, with the same schema; codec: other than the session's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = StructType.fromJson(df.schema.jsonValue())
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(schema).parquet(path)
    out._weft_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_weft_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's own setting by which an execution deletes what it has shuffled when it ends; else that stays until the driver collects it.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What frames made and stored within it have shuffled is deleted as soon as they are stored."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by the hash of its keys, so that a task gets some ROWS of ``rows`` rows, whatever their number.

    The size of partitions that Spark aims at is one of shuffled bytes, which
    sorts and tables of groups unfold to thirty times as many.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)
