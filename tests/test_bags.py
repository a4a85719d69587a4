"""Counts over aliases are those of the path rows, without a row for each path."""

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators import traversal
from weftgraph.sources.star import Star

CASES = {
    "without": lambda g: g.V().outV().aka("a").inV().outV().without("a"),
    "without_of_root": lambda g: g.V().aka("a").outV().inV().without("a"),
    "two_aliases": lambda g: g.V().aka("a").outV().aka("b").outV().without("a").inV().without("b"),
    "alias_of_two_steps": lambda g: g.V().aka("a").outV().without("a").outV().without("a").inV(),
    "rebound": lambda g: g.V().aka("a").outV().without("a").aka("a").inV().without("a"),
    "twice_the_same": lambda g: g.V().outV().aka("a").aka("b").inV().without("a", "b").outV(),
    "not_read": lambda g: g.V().aka("a").outV(2),
    "of_other_kind": lambda g: g.V().outE().aka("e").outV().without("e").inE(),
    "edges": lambda g: g.V().outE().aka("e").outV().inE().without("e").outV(),
    "both": lambda g: g.V().aka("a").bothV().both_().without("a").bothE().bothV(),
    "along": lambda g: g.V().aka("a").out_().in_().without("a").out_(w=1),
    "filters": lambda g: g.V().aka("a").outV(n__in=[1, 2]).inV().filter(n=2).without("a").outV(),
    "dedup": lambda g: g.V().outV().aka("a").outV().dedup().inV().without("a"),
    "dedup_alias": lambda g: g.V().aka("a").outV().aka("b").outV().dedup("a").inV().without("b"),
    "limit_then_hops": lambda g: g.V().aka("a").outV().limit(9).inV().without("a").outV(),
    "order_then_hops": lambda g: g.V().aka("a").outV().order_by("-n").inV().without("a").limit(11).outV(),
    "random_then_hops": lambda g: g.V().aka("a").random("outV", seed=3).inV().without("a").outV(),
    "names_of_parameters": lambda g: g.V().aka("reads").outV().aka("kind").inV().without("reads", "kind"),
    "hops_then_limit": lambda g: g.V().outV().aka("a").inV().outV().without("a").limit(12),
}


@pytest.fixture(scope="module")
def multigraph(spark, tmp_path_factory):
    """Seven nodes, parallel edges and loops, in files, whose sizes are known."""
    g, at = PropertyGraph.empty(spark), tmp_path_factory.mktemp("multigraph")
    g.bulk_add_node([{"n": i % 3} for i in range(7)])
    g.bulk_add_edge_by_ids([(i * i % 7, (3 * i + i % 4) % 7, {"w": i % 2}) for i in range(16)])
    g.nodes.write.parquet(f"{at}/nodes")
    g.edges.write.parquet(f"{at}/edges")
    return PropertyGraph(spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_counts_are_those_of_rows(name, multigraph, monkeypatch):
    """Also with more tasks behind a fresh alias."""
    monkeypatch.setattr(traversal, "SPREAD", 256)
    t = CASES[name](multigraph)
    rows = t.frame().groupBy("_id").agg(F.min("_ord").alias("_ord"), F.count(F.lit(1)).alias("_m"))
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, t.counts().select("_id", "_ord", "_m").collect())) == want
    assert t.count() == sum(m for _, _, m in want)
    assert want


def test_tasks_behind_an_alias_go_by_the_edges(multigraph, monkeypatch):
    spread = lambda: "RepartitionByExpression" in CASES["without"](multigraph).counts()._jdf.queryExecution().optimizedPlan().toString()
    assert not spread()
    monkeypatch.setattr(traversal, "SPREAD", 256)
    assert spread()


def test_paths_behind_an_alias_are_not_rows(spark):
    """10^16 paths over parallel edges."""
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{}, {}])
    g.bulk_add_edge_by_ids([(i % 2, 1 - i % 2, {}) for i in range(200)])
    t = g.V().aka("a").outV(7).without("a").outV()
    assert t._frame(bag=True).df.count() <= 200
    assert {r["_id"]: r["_m"] for r in t.counts().collect()} == {0: 10**16, 1: 10**16}
    assert t.count() == 2 * 10**16


def test_without_pairs_parts_and_orders(spark, sf_dir):
    """A row for each pair of lines of an order at most, not for each path."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").count()
    g = Star(spark, sf_dir).graph(("customer", "order", "part"), ("placed", "contains"))
    t = g.V(kind="customer").outV().outV().aka("a").inV().outV().without("a")
    assert t._frame(bag=True).df.count() <= lines.agg(F.sum(F.expr("count * count"))).first()[0] < t.count()
