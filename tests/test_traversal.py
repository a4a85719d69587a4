"""Hops from nodes and edges: bag semantics, order, filters, counts and laws between operators."""

import random

import pytest

from weftgraph import errors
from weftgraph.graph import PropertyGraph


@pytest.fixture(scope="module")
def mesh(spark):
    """A random multigraph with self-loops and parallel edges."""
    rng = random.Random(3)
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"n": i} for i in range(9)])
    g.bulk_add_edge_by_ids([(rng.randrange(9), rng.randrange(9), {"w": rng.randrange(4)}) for _ in range(26)])
    edges = [(r["id"], r["src"], r["dst"], r["w"]) for r in g.edges.orderBy("id").collect()]
    return g, edges


def test_one_hop(trio):
    bo = trio.V(name="Bo")
    assert (bo.inV().ids(), bo.outV().ids(), bo.bothV().ids()) == ([0], [2], [0, 2])
    assert (bo.inE().ids(), bo.outE().ids(), bo.bothE().ids()) == ([0], [1], [0, 1])
    assert bo.outE(label="likes").ids() == []
    assert bo.out_(label="helps").ids() == [2]
    assert bo.in_(label="likes").ids() == [0]
    assert bo.both_().ids() == [2, 0]
    assert trio.V(name="Cy").outV().ids() == []


def test_from_edges(trio):
    e = trio.E(label="likes")
    assert (e.inV().ids(), e.outV().ids(), e.bothV().ids()) == ([0], [1], [0, 1])
    assert e.outV(name="Cy").ids() == []
    for name in ("inE", "outE", "bothE"):
        with pytest.raises(errors.NoSuchTraversal):
            getattr(e, name)()
    for name in ("in_", "out_", "both_"):
        with pytest.raises(AssertionError):
            getattr(e, name)()


def test_depth_first_order_by_hand(mesh):
    g, edges = mesh
    out = {i: [(e, t) for e, s, t, _ in edges if s == i] for i in range(9)}
    want = [t2 for i in range(9) for _, t in out[i] for _, t2 in out[t]]
    assert g.V().outV(2).ids() == want
    both = {i: [x for e, s, t, _ in edges for x in ([t] if s == i else []) + ([s] if t == i else [])] for i in range(9)}
    assert g.V().bothV().ids() == [x for i in range(9) for x in both[i]]


def test_both_gives_outs_of_all_rows_before_ins(mesh):
    g, edges = mesh
    sides = lambda rows: [t for i in rows for _, s, t, _ in edges if s == i != t] + [s for i in rows for _, s, t, _ in edges if t == i != s]
    assert g.V().both_().ids() == sides(range(9))
    assert g.V().both_(2).ids() == sides(sides(range(9)))


def test_laws(mesh):
    g, _ = mesh
    v = g.V()
    assert sorted(v.out_(w=2).ids()) == sorted(v.outE(w=2).outV().ids())
    assert sorted(v.in_(w__gt=1).ids()) == sorted(v.inE(w__gt=1).inV().ids())
    assert v.outV(3).ids() == v.outV().outV().outV().ids()
    assert v.bothV(2).count() == v.bothV().bothV().count() == len(v.bothV(2).ids())
    assert v.outV(0).ids() == v.ids()
    assert v.outV(3).count() == len(v.outV(3).ids())
    assert v.outV(2).dedup().count() == len(set(v.outV(2).ids()))
    assert v.outV(2).dedup().ids() == list(dict.fromkeys(v.outV(2).ids()))


def test_bag_mode_counts_what_row_mode_lists(mesh):
    g, _ = mesh
    for t in (g.V().outV(3), g.V().both_(2, w__lt=3), g.V().outE(w=1).bothV(), g.V().inV(n__gt=3).dedup().outV(), g.E().outV().inV()):
        rows = t.ids()
        assert {r["_id"]: r["_m"] for r in t.counts().collect()} == {i: rows.count(i) for i in set(rows)}


def test_counts_are_checked(trio):
    for bad in (-1,):
        with pytest.raises(AssertionError):
            trio.V().outV(bad)
    with pytest.raises(AssertionError):
        trio.V().out_(0)
    with pytest.raises(AssertionError):
        trio.V().outV(1, 2)


def test_limit_and_order(trio):
    assert trio.V().limit(2).ids() == [0, 1]
    assert trio.V().limit(0).ids() == []
    assert trio.V().order_by("-age", "+name").ids() == [1, 2, 0]
    assert trio.V().order_by("-name").limit(2).ids() == [2, 1]
    assert trio.V().order_by("note").ids() == [1, 2, 0]
    assert trio.V().order_by("-note").ids() == [0, 1, 2]
    assert trio.V().order_by("-rank").outE().ids() == [0, 1]
    assert trio.V().order_by("nothing").ids() == [0, 1, 2]
    for bad in ("*age", "", "age name", 3):
        with pytest.raises(errors.InvalidExpression):
            trio.V().order_by(bad)


def test_iteration(trio):
    t = trio.V()
    assert [t.next().get_id() for _ in range(3)] == [0, 1, 2]
    with pytest.raises(StopIteration):
        t.next()
    assert t.next().get_id() == 0
    assert [e.get_id() for e in t] == [0, 1, 2]
    assert [e.name for e in t.all()] == ["Ada", "Bo", "Cy"]
    assert t.data("name", flat=True) == [["Ada"], ["Bo"], ["Cy"]]
    assert t.data("name", "note")[1] == {"name": "Bo"}
    assert t.data()[0] == {"rank": 1, "age": 20, "name": "Ada", "note": "only here"}
    with pytest.raises(KeyError):
        t.data("note", flat=True)


def test_membership(trio):
    it = trio.V(age=30)
    assert trio.v(1) in it
    assert trio.v(0) not in it
    assert trio.e(1) not in it
    assert "Bo" not in it


def test_random_draws_one_neighbour_a_row(mesh):
    g, edges = mesh
    for method in ("outV", "inV", "bothV", "outE", "inE", "bothE"):
        t = g.V().aka("r").random(method, seed=4)
        live = {i for _, s, d, _ in edges for i in ((s,) if method.startswith("out") else (d,) if method.startswith("in") else (s, d))}
        got = [(r["_a_r"], r["_id"]) for r in t.frame().collect()]
        assert sorted(r for r, _ in got) == sorted(live)
        near = {(i, x) for i in range(9) for x in getattr(g.v(i), method)().ids()}
        assert set(got) <= near
        assert t.ids() == g.V().random(method, seed=4).ids()
    ends = g.E().random("bothV", seed=1).ids()
    assert len(ends) == len(edges)
    assert {"src", "dst"} == {"src" if x == s else "dst" for x, (_, s, d, _) in zip(ends, edges, strict=True) if s != d}
    assert g.V().random("outV", seed=4, n=77).count() == 0
    with pytest.raises(errors.UnknownMethod):
        g.V().random("sideways")


def test_entities(trio):
    bo = trio.v(1)
    assert (bo.get_id(), bo.name, bo.get("note"), bo.get("note", 5), repr(bo)) == (1, "Bo", None, 5, "<Node id:1 data:{'rank': 1, 'age': 30, 'name': 'Bo'}>")
    with pytest.raises(AttributeError):
        bo.note
    assert bo == trio.V(name="Bo").next() != trio.v(2)
    assert trio.v(1) != trio.e(1)
    assert bo.outV().ids() == [2]
    assert bo.both_().ids() == [2, 0]
    assert trio.e(0).bothV().ids() == [0, 1]
    assert trio.v(0).random("outV") == bo
    assert trio.v(0).random("outV", name="Cy") is None
    with pytest.raises(IndexError):
        trio.v(2).random("outV")
    with pytest.raises(errors.UnknownMethod):
        trio.e(0).random("outE")
    assert trio.v(77).data() == {}


def test_closed(trio):
    trio.close()
    for f in (trio.V, trio.E, lambda: trio.v(0), lambda: trio.e(0), lambda: trio.add_node(a=1)):
        with pytest.raises(errors.DataError):
            f()


def test_rows_at_one_node_draw_apart(spark):
    """Rows that meet at one node each draw for themselves."""
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{}] * 205)
    g.bulk_add_edge_by_ids([(i, 200, {}) for i in range(200)] + [(200, 201 + k, {}) for k in range(4)])
    for seed in (1, 2):
        drawn = g.V(_id__lt=200).outV().random("outV", seed=seed).ids()
        assert len(drawn) == 200
        assert all(25 <= drawn.count(201 + k) <= 80 for k in range(4))
    assert g.V(_id__lt=200).outV().random("outV").ids() != g.V(_id__lt=200).outV().random("outV").ids()


def test_whole_powers_are_exact(spark):
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"k": 3, "n": 39, "m": -1}, {"k": -2, "n": 63, "m": 0}, {"k": 1, "n": 500, "m": 2}, {"k": 0, "n": 64, "m": 5}, {"k": -1, "n": 1001, "m": 1}])
    assert g.V(k=3).sum("k**39").pairs() == [(0, 3**39)]
    assert sorted(g.V().sum("k**n").pairs()) == [(0, 3**39), (1, -(2**63)), (2, 1), (3, 0), (4, -1)]
    assert sorted(g.V().sum("k**0").pairs()) == [(i, 1) for i in range(5)]
    assert g.V(k=3).sum("k**2.0").pairs() == [(0, 9.0)]
    for bad in ("k**40", "k**m"):
        with pytest.raises(Exception, match="power beyond|negative exponent"):
            g.V(k=3).sum(bad).pairs()


def test_next_starts_again_after_the_last(trio):
    t = trio.V()
    assert [t.next().get_id() for _ in range(3)] == [0, 1, 2]
    with pytest.raises(StopIteration):
        t.next()
    assert t.next().get_id() == 0
