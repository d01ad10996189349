"""A posting-list index of trigrams for substring search.

Texts are copied once with a number for each row, in folders of row numbers.
A gram is three neighbouring characters of a lower-cased text, as one long. Each task turns a
bounded block of rows into posting lists, so that neither pairs of rows and
grams nor whole lists are ever shuffled; a gram's list is the union of its
blocks' lists. Lists are delta-coded and lie in folders by a hash of the gram.
Grams of a large share of the rows say little: only their number is kept.

A search reads the lists of the rarest grams of each term, intersects them, and
applies the exact test to the rows that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlens.sources import shared

#: Characters of text that make a block of posting lists: what a task holds.
BLOCK = 4 << 20
#: A gram of more than this share of the rows is hot.
HOT = 0.2
#: Lists that are intersected for a term.
LISTS = 3
LISTED = "gram long, base long, n long, width int, ids binary"


def grams_of(term: str) -> list[int]:
    """The distinct grams of a term; none if it has fewer than three characters."""
    points = [ord(c) for c in term.lower()]
    return sorted({a << 42 | b << 21 | c for a, b, c in zip(points, points[1:], points[2:], strict=False)})


def _pairs(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of all grams of a column of texts, with repeats."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    inside = np.ones(len(points), bool)  # whether a gram that starts here ends in the same text
    ends = np.cumsum(size)
    for back in (1, 2):
        inside[ends[size >= back] - back] = False
    inside = inside[:-2]
    return gram[inside], np.repeat(rows, size)[:-2][inside]


def _lists(gram: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """Posting lists of a block: its first row as base, and each gram's rows as differences in as few bytes as they need."""
    base = int(row.min())
    order = np.lexsort((row, gram))
    gram, row = gram[order], row[order] - base
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    first = np.ones(len(gram), bool)
    first[1:] = gram[1:] != gram[:-1]
    delta = np.where(first, row, np.diff(row, prepend=0))
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(gram)))
    most = np.maximum.reduceat(delta, starts)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, np.where(most < 1 << 32, 4, 8)))
    parts = []
    for size in (1, 2, 4, 8):
        mine = np.flatnonzero(width == size)
        if len(mine):
            held = np.repeat(width, n) == size
            data = delta[held].astype(f"<u{size}").tobytes()
            offsets = np.concatenate([[0], np.cumsum(n[mine] * size)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            parts.append(pa.RecordBatch.from_arrays([pa.array(gram[starts[mine]]), pa.array(np.full(len(mine), base)), pa.array(n[mine]), pa.array(np.full(len(mine), size, np.int32)), ids], names=["gram", "base", "n", "width", "ids"]))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _postings(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """The posting lists of rows (number, columns): each task makes a list a gram for every ``block`` characters."""

    def work(batches):
        held, size = [], 0
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for k in range(1, batch.num_columns):
                for at in range(0, batch.num_rows, 64):
                    pairs = _pairs(batch.column(k).slice(at, 64), numbers[at : at + 64])
                    held.append(pairs)
                    size += len(pairs[0])
                    if size >= block:
                        yield _lists(*map(np.concatenate, zip(*held, strict=True)))
                        held, size = [], 0
        if size:
            yield _lists(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("number", *[F.lower(c).alias(f"t{k}") for k, c in enumerate(columns)]).mapInArrow(work, LISTED)


def _bucket(gram, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class GramIndex:
    """An index under ``path``: rows/part=*/ and lists/bucket=*/. Opened by its path; it can be read from any session."""

    path: str
    buckets: int
    parts: int
    rows: int
    schema: StructType

    @staticmethod
    def build(docs: DataFrame, columns: list[str], path: str, buckets: int = 64, parts: int = 64, hot: float = HOT, block: int = BLOCK) -> GramIndex:
        """Index the text columns of docs. docs may have any other columns but number and part."""
        spark = docs.sparkSession
        number = F.monotonically_increasing_id()
        copied = docs.withColumn("number", number).withColumn("part", F.pmod(F.shiftright("number", 33), F.lit(parts)).cast("int"))
        # A task's rows all have one part, so the number of files is that of tasks.
        copied.write.partitionBy("part").parquet(f"{path}/rows")
        schema = StructType.fromJson(copied.schema.jsonValue())
        rows = spark.read.schema(schema).parquet(f"{path}/rows")
        total = rows.count()
        found = shared.store(_postings(rows, columns, block), "grams")
        often = found.groupBy("gram").agg(F.sum("n").alias("df"))
        often = shared.store(often, "gram-counts")
        # At most (grams of a row) / hot grams can be in so many rows.
        common = often.where(F.col("df") > hot * total)
        lists = found.join(F.broadcast(common.select("gram")), "gram", "left_anti").join(often, "gram")
        none = F.lit(None)
        marks = common.select("gram", none.cast("long").alias("base"), none.cast("long").alias("n"), none.cast("int").alias("width"), none.cast("binary").alias("ids"), "df")
        out = lists.select(*marks.columns).unionByName(marks).withColumn("bucket", _bucket("gram", buckets))
        out.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "base").write.partitionBy("bucket").parquet(f"{path}/lists")
        shared.drop(found, often)
        return GramIndex(path, buckets, parts, total, schema)

    def lists(self, spark: SparkSession, grams: list[int]) -> DataFrame:
        """The posting lists of some grams; only their folders are read, and in them only the row groups that may hold them."""
        asked = spark.range(1).select(F.explode(F.array(*[F.lit(g).cast("long") for g in grams])).alias("g")).select(_bucket("g", self.buckets)).distinct()
        folders = sorted(r[0] for r in asked.collect())
        schema = StructType.fromDDL(f"{LISTED}, df long, bucket int")
        return spark.read.schema(schema).parquet(f"{self.path}/lists").where(F.col("bucket").isin(folders) & F.col("gram").isin(grams))

    def numbers(self, spark: SparkSession, term: str, lists: int = LISTS) -> DataFrame | None:
        """Numbers of the rows that may hold the term; None where the index cannot tell: a short term, or one of hot grams only."""
        grams = grams_of(term)
        if not grams:
            return None
        found = self.lists(spark, grams)
        df = {r.gram: r.df for r in found.groupBy("gram").agg(F.max("df").alias("df"), F.count("ids").alias("k")).where("k > 0").collect()}
        known = {r.gram for r in found.select("gram").distinct().collect()} if len(df) < len(grams) else set(df)
        if len(known) < len(grams):  # no row has this gram
            return found.select(F.col("base").alias("number")).limit(0)
        rarest = sorted(df, key=lambda g: (df[g], g))[:lists]
        if not rarest:
            return None

        def decode(batches):
            for batch in batches:
                got = []
                for base, width, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    got.append(base + np.cumsum(np.frombuffer(ids, f"<u{width}").astype(np.int64)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got))], names=["number"])

        rows = self.lists(spark, rarest).where(F.col("ids").isNotNull()).select("base", "width", "ids").mapInArrow(decode, "number long")
        # A row is once in a gram's lists, so it is in all of them if it is there as often.
        return rows.groupBy("number").agg(F.count("*").alias("k")).where(F.col("k") == len(rarest)).select("number")

    def candidates(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """A superset of the rows in which any term stands, with all columns of the indexed table; all rows where the index cannot tell."""
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        found = [self.numbers(spark, term) for term in terms]
        if not found or any(x is None for x in found):
            return rows.drop("number", "part")
        numbers = found[0]
        for other in found[1:]:
            numbers = numbers.unionByName(other)
        numbers = shared.store(numbers.distinct().withColumn("part", F.pmod(F.shiftright("number", 33), F.lit(self.parts)).cast("int")), "candidates")
        folders = [r.part for r in numbers.select("part").distinct().collect()]
        return rows.where(F.col("part").isin(folders) if folders else F.lit(False)).join(numbers.select("number"), "number", "left_semi").drop("number", "part")
