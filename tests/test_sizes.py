"""Steps whose tasks must not grow with the tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftlens.plans import registry
from weftlens.sources import shared

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["entity_stats", "family_shares", "law_contents", "search_articles", "analysis_top_laws"])
def test_pairs_are_dealt_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr(shared, "ROWS", 100)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {-(-rows // 100)})" in plan


@pytest.mark.parametrize("name", ["graph_edges", "graph_nodes"])
def test_graphs_send_no_growing_table_through_the_driver(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # Only nations and laws, of fixed number, are broadcast.
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
    assert all("n_nationkey" in x or "slug" in x for x in joins), joins


def test_a_statute_s_lines_are_computed_once(spark):
    from weftlens.functions import statute

    lines = statute.statute_lines(F.parse_json(F.lit("{}")), dt.date(2026, 1, 1))
    plan = spark.range(1).select(lines)._jdf.queryExecution().analyzed().toString()
    assert [plan.count(f"$.{name},") for name in ("조문내용", "항내용", "호내용", "목내용", "조문시행일자")] == [1] * 5
