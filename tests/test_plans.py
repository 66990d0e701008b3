"""Plan guards: no cross products, pruned scans, pushed filters, partial top-N."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SKIP = {"genre_models_accuracy", "cluster_docs", "page_quality_predict"}


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_") and n not in SKIP))
def test_no_cross_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_page_scan_prunes_html(spark):
    from websift.sources import derived as D
    p = D.site(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p
    assert "html" not in p


def test_filters_reach_the_scan(spark):
    assert "GreaterThan(o_orderdate" in plan(spark, "delta_docs")
    assert "GreaterThanOrEqual(n_chars,50)" in plan(spark, "facet_field")


def test_top_n_is_cut_before_the_shuffle(spark):
    from websift.operators import facets as FC
    from pyspark.sql import functions as F
    d = spark.read.parquet(f"{SF}/documents.parquet")
    p = FC.group_top(d, "lang", F.col("n_chars").desc(), "doc_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p
