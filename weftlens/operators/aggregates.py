"""Grouped statistics: distinct and filtered counts, rates, two-level rollups, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_stats(facts: DataFrame, key: str, entity: str, kinds: dict[str, Column], latest: str) -> DataFrame:
    """Per key: distinct entities, distinct entities of each kind, and the latest date.

    One row for each key and entity comes first, with partial results, so that
    plain counts do and no row is expanded for each distinct count.
    """
    once = facts.groupBy(key, entity).agg(*[F.bool_or(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in kinds.items()], F.max(latest).alias("latest_on"))
    counts = [F.count_if(F.col(name) & F.col(entity).isNotNull()).alias(name) for name in kinds]
    return once.groupBy(key).agg(F.count(entity).alias("total"), *counts, F.max("latest_on").alias("latest_on"))


def yearly_split(rows: DataFrame, date: str, kinds: dict[str, Column]) -> DataFrame:
    """Rows of each kind by year; rows without a date are left out."""
    years = rows.where(F.col(date).isNotNull()).groupBy(F.year(date).cast("long").alias("year"))
    return years.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in kinds.items()])


def top_groups(rows: DataFrame, group: str, entity: str, n: int, label: str = "docs") -> DataFrame:
    """The n groups with most distinct entities; ties by group, null groups left out."""
    counted = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(entity).alias(label))
    return counted.orderBy(F.desc(label), F.asc(group)).limit(n)


def coverage(entities: DataFrame, key: str, facts: DataFrame, fact_key: str, by: str) -> DataFrame:
    """Per group: entities, entities with a fact, and their share to three places (null without entities)."""
    linked = facts.select(F.col(fact_key).alias(key)).distinct().withColumn("_has", F.lit(1))
    per = entities.join(linked, key, "left").groupBy(by).agg(F.count("*").alias("docs"), F.count("_has").alias("linked"))
    return per.withColumn("rate", F.round(F.try_divide(F.col("linked").cast("double"), "docs"), 3))


def spread(rows: DataFrame, key: str, member: str, flags: dict[str, Column]) -> DataFrame:
    """Over keys: how many have several members, how many meet every flag somewhere, and the mean member count."""
    per = rows.groupBy(key).agg(F.count_distinct(member).alias("_n"), *[F.bool_or(c).alias(f"_{n}") for n, c in flags.items()])
    every = None
    for name in flags:
        every = F.col(f"_{name}") if every is None else every & F.col(f"_{name}")
    return per.agg(F.count("*").alias("keys"), F.count_if(F.col("_n") > 1).alias("multi"), F.count_if(every).alias("all_flags"), F.round(F.avg("_n"), 1).alias("avg_members"))


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Element floor(n / 2) of the sorted values of each group, by rank rather than by collecting a group."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(value)
    sized = rows.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(order) - 1)
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    return sized.join(n, list(keys)).where("_k = floor(_n / 2)").select(*keys, F.col(value).alias("median"))


def sorted_distinct(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Per key its distinct values, sorted and joined with commas; null where it has none."""
    some = F.array_sort(F.collect_set(value))
    return rows.groupBy(key).agg(F.when(F.size(some) > 0, F.array_join(some, ",")).alias(out))


def edges(rows: DataFrame, a: str, b: str, weight: str, method: str) -> DataFrame:
    """Per pair the greatest weight and the least method."""
    return rows.groupBy(a, b).agg(F.max(weight).alias("weight"), F.min(method).alias("method"))
