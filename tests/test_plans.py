"""What the physical plans must and must not have."""

import re

import pytest

from yieldspark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["extract_split"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:\w+>", text)


def test_no_python_where_expressions_do(spark):
    for name in ("moving_range", "we_rules", "pchart", "column_quality", "hedges_g", "score_rank_decile", "daily_grid", "spearman", "average_precision"):
        assert not re.search(r"Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, SF))), name


def test_positions_have_no_single_window(spark):
    from pyspark.sql import functions as F

    from yieldspark.operators.ordering import positions

    text = plan(positions(spark.range(1000).withColumn("x", F.rand(1)), [F.col("x"), F.col("id")], ranges=8))
    assert "hashpartitioning(range__" in text


def test_models_of_orders_read_the_lines_once(spark):
    """Edges, bins and scores come from the staged orders."""
    for name in ("contribution_importance", "gbt_score"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "by_order-" in text and "lineitem.parquet" not in text, name
