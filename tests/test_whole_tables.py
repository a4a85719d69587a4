"""Queries run over whole tables, not over their first ids or rows."""

import pytest
from weftgraph.plans import catalog
from weftgraph.sources.star import STEP


def column(spark, sf_dir, name, col):
    return {r[0] for r in catalog.QUERIES[name](spark, sf_dir).select(col).distinct().collect()}


@pytest.mark.parametrize("name", ["aka_collect3", "dedup_alias", "cousins"])
def test_all_customers(name, spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    keys = {r[0] for r in (customers.select("c_custkey") if name == "cousins" else orders.select("o_custkey")).distinct().collect()}
    assert max(keys) >= 20
    assert column(spark, sf_dir, name, "id" if name == "cousins" else "c") == {3 * STEP + k for k in keys}


def test_all_parts_and_nations(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert catalog.QUERIES["inv"](spark, sf_dir).count() == lines.count()
    assert catalog.QUERIES["ine"](spark, sf_dir).count() == lines.filter("l_returnflag = 'A'").count()
    assert column(spark, sf_dir, "script_add_edge", "src") == {2 * STEP + k for k in range(25)}


@pytest.mark.parametrize("name", ["order_asc", "order_desc", "order_mix", "sum_asc"])
def test_all_ranks(name, spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/{'lineitem' if name == 'sum_asc' else 'part'}.parquet")
    n = parts.select("l_partkey" if name == "sum_asc" else "p_partkey").distinct().count()
    assert n > 50
    assert column(spark, sf_dir, name, "rank") == set(range(1, n + 1))
