"""The analysis page as a whole, and labels without a number."""

import pytest
from pyspark.sql import functions as F

from weftlens.functions import text as T
from weftlens.operators import reports
from weftlens.plans import model, service


def test_analysis_has_all_its_parts(spark):
    tables = model.tables(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    sources = spark.createDataFrame(service.SOURCES, "key string, raw string, method string, fallback string")
    parts = reports.analysis(tables, F.lit(model.AS_OF).cast("date"), 1999, sources, seen="seen")
    got = {name: part.collect() for name, part in parts.items()}
    assert len(got) == 19 and got["portal_total"][0][0] is None
    assert got["totals"][0].documents == 1500 and got["link_quality"][0].docs >= got["in_scope"][0].docs
    assert sum(r.n for r in got["by_method"]) == got["totals"][0].links and len(got["top_laws"]) <= 12


def test_the_portal_total_is_that_of_the_last_run_that_has_one(spark):
    rows = [(1, "fsc.reply", "2024-01-01", '{"total": 5}'), (2, "fsc.reply", "2024-01-03", '{"total": 7}'), (3, "fsc.reply", "2024-01-04", "{}"), (4, "lawgo", "2024-01-09", '{"total": 9}'), (5, "fsc.reply", "2024-01-05", None)]
    assert reports.portal_total(spark.createDataFrame(rows, "id int, source string, started_at string, stats string")).first()[0] == 7


def test_labels_without_a_number(spark):
    rows = spark.createDataFrame([("제25조의2",), ("없음",)], "t string")
    assert [r[0] for r in rows.select(T.article_no(F.col("t"))).collect()] == ["25의2", None]
    assert rows.where("t <> '없음'").select(T.article_no(F.col("t"), strict=True)).first()[0] == "25의2"
    with pytest.raises(Exception, match="no article number: 없음"):
        rows.select(T.article_no(F.col("t"), strict=True)).collect()
