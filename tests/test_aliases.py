"""Aliases, collect, dedup, without and the expression language."""

import pytest

from weftgraph import errors
from weftgraph.graph import PropertyGraph


def test_collect(shop):
    t = shop.v(9).aka("r").out_(action="saw").aka("b").in_(action="bought").aka("other").out_(action="bought").aka("x")
    rows = [[e.get_id() for e in row] for row in t.collect("b", "other", "x")]
    assert rows == [[0, 6, 0], [0, 6, 2], [0, 6, 3], [0, 8, 0], [0, 8, 2], [0, 8, 4], [0, 8, 5]]
    assert t.collect("nope")[0] == [None]
    assert t.collect("b", "x") == t.collect("b", "x")


def test_rows_keep_their_own_bindings(shop):
    t = shop.V(kind="reader").aka("r").both_().order_by("kind").aka("b")
    pairs = sorted((a.get_id(), b.get_id()) for a, b in t.collect("r", "b"))
    assert pairs == sorted((r["src"], r["dst"]) for r in shop.edges.collect())


def test_rebinding_overwrites(shop):
    t = shop.v(9).aka("x").outV().aka("x")
    assert [[e.get_id() for e in row] for row in t.collect("x")] == [[0]]


def test_dedup_and_without(shop):
    t = shop.v(9).out_().aka("b").in_(action="bought").aka("r").out_()
    assert t.ids() == [0, 2, 3, 0, 2, 4, 5]
    assert t.dedup().ids() == [0, 2, 3, 4, 5]
    assert t.dedup("b").ids() == [0, 2, 3, 4, 5]
    assert t.dedup("r").ids() == [0, 2, 3, 0, 2, 4, 5]
    assert t.without("b").ids() == [2, 3, 2, 4, 5]
    assert t.without("r").ids() == t.ids()
    assert t.without("b").dedup().ids() == [2, 3, 4, 5]
    for f in (t.dedup, t.without):
        with pytest.raises(errors.UnknownAlias):
            f("nope")


def test_sum_and_percent(shop):
    t = shop.v(9).out_(action="saw").in_(action="bought").out_(action="bought")
    assert t.count() == 7
    assert t.sum().pairs() == [(0, 2), (2, 2), (3, 1), (4, 1), (5, 1)]
    assert t.sum(asc=True).pairs() == [(3, 1), (4, 1), (5, 1), (0, 2), (2, 2)]
    assert t.sum().limit(2).pairs() == [(0, 2), (2, 2)]
    assert t.sum().limit(2).entities().in_(action="saw").ids() == [9]
    assert t.sum().entities().ids() == [0, 2, 3, 4, 5]
    assert [(e.get_id(), n) for e, n in t.sum().limit(1)] == [(0, 2)]
    assert sum(p for _, p in t.percent().pairs()) == pytest.approx(1)
    assert t.percent().pairs()[0] == (0, pytest.approx(2 / 7))
    assert shop.V(kind="nothing").sum().pairs() == []
    agg = t.sum()
    assert agg.next()[1] == 2


def test_expressions(spark):
    g = PropertyGraph.empty(spark)
    a, b, c, d = g.bulk_add_node([{}, {"n": 7, "in": {"side": 4}}, {"n": -7}, {"n": 2}])
    g.bulk_add_edge([(a, b, {"w": 2}), (a, c, {"w": 3}), (b, d, {}), (c, d, {})])
    t = g.v(0).outE().aka("e").outV().aka("m").outV()
    of = lambda text: t.sum(text).pairs()
    assert of("_.e.w") == [(3, 5)]
    assert of("_.e.w + 1") == [(3, 7)]
    assert of("1 if _.e.w > 2 else 0") == [(3, 1)]
    assert of("_.nobody.w + _.e.nothing") == [(3, 0)]
    assert of("_.m.n // 2") == [(3, -1)]
    assert of("_.m.n / 2") == [(3, 0.0)]
    assert of("_.e.w ** 2 - n") == [(3, 9)]
    assert of("-_.e.w * 2") == [(3, -10)]
    assert of("1 < _.e.w < 2") == [(3, 2)]
    assert of("_.e.w == 2") == [(3, 1)]
    assert t.percent("0 * _.e.w").pairs() == [(3, 0.0)]
    for bad in ("import os", "(1).__class__", "len(n)", "n[0]", "nothing", "'a'", "True", "n != 1", "n and 1", "n % 2", "not n", "", "_", "_.e", "a.b.c.d", "n.__class__", "lambda: 1", "[1]"):
        with pytest.raises(errors.InvalidExpression):
            t.sum(bad).pairs()


def test_nested_fields(spark):
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"box": {"w": 4, "h": 2}}, {"box": {"w": 5}}])
    assert g.V().sum("box.w * (box.h + 1) + box.nope").pairs() == [(0, 12), (1, 5)]
