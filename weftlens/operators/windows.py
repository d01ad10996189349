"""Ordered operators: top-k by group, intervals, islands, versions, neighbours, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_with_remainder(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place and how many more the group has.

    The group's size comes from an aggregate, so that only k rows of a group
    are shuffled for the ranking.
    """
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= k)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    return ranked.join(sizes, group).withColumn("more", F.greatest(F.col("_n") - k, F.lit(0).cast("long"))).drop("_n")


def page_with_total(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of rows and the number of all rows, without a window over the whole table."""
    total = rows.agg(F.count("*").alias("total"))
    # One row on the right.
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def close_intervals(versions: DataFrame, key: str, start: str, out: str = "effective_to") -> DataFrame:
    """Each version ends the day before the next one of its key; the last stays open."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return versions.withColumn(out, F.date_sub(following, 1))


def latest_per(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in the order given, by one aggregate with partial results."""
    last = F.max(F.struct(*order, *[c for c in columns if c not in order]))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: run number, value, length and first order value."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = (~F.lag(value).over(by).eqNullSafe(F.col(value)) | (F.row_number().over(by) == 1)).cast("long")
    marked = rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.count("*").alias("length"), F.min(order[0]).alias("first_at"))


def first_distinct(rows: DataFrame, key: str, value: str, order: list[str], n: int, out: str) -> DataFrame:
    """Per key its first n different values in order, joined with commas."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_o"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_o", value))).where(F.col("_k") <= n)
    items = F.array_sort(F.collect_list(F.struct("_k", F.col(value).cast("string").alias("v"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["v"]), ",").alias(out))


def current_and_pending(versions: DataFrame, key: str, start: str, value: str, as_of: Column) -> DataFrame:
    """Per key the version in force on a day, and the first that comes after it."""
    now = F.when(F.col(start) <= as_of, F.struct(start, value))
    later = F.when(F.col(start) > as_of, F.struct(start, value))
    per = versions.groupBy(key).agg(F.max(now).alias("_now"), F.min(later).alias("_later"))
    return per.select(key, F.col(f"_now.{value}").alias("current"), F.col(f"_later.{value}").alias("pending"))


def neighbours(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Each row with the values before and after it in its group."""
    by = Window.partitionBy(group).orderBy(*order)
    return rows.select("*", F.lag(value).over(by).alias("previous"), F.lead(value).over(by).alias("next"))
