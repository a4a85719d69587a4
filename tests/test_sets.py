"""Set algebra over distinct ids."""

import pytest

from weftgraph import errors


def test_operators_and_methods_agree_with_python(trio):
    g = trio
    pools = {"a": g.V(rank=1), "b": g.V(age=30), "c": g.V(name__in=["Ada", "Cy"]), "none": g.V(rank=9), "bag": g.V().bothV()}
    sets = {k: set(t.ids()) for k, t in pools.items()}
    for x in pools:
        for y in pools:
            p, q, s, t = pools[x], pools[y], sets[x], sets[y]
            assert set((p | q).ids()) == s | t
            assert set((p & q).ids()) == s & t
            assert set((p - q).ids()) == s - t
            assert set((p ^ q).ids()) == s ^ t
            assert (p <= q, p >= q) == (s <= t, s >= t)
            assert len((p | q).ids()) == len(s | t)


def test_several_operands(trio):
    g = trio
    a, b, c = g.V(rank=1), g.V(age=30), g.V(name__in=["Ada", "Cy"])
    assert g.union(a, b, c).ids() == [0, 1, 2]
    assert g.intersection(a, b, g.V(name="Bo")).ids() == [1]
    assert g.difference(g.V(), a, b).ids() == []
    assert set(g.symmetric_difference(a, b, c).ids()) == {0, 1} ^ {1, 2} ^ {0, 2}


def test_first_seen_order(trio):
    assert (trio.V(name="Cy") | trio.V(name="Ada")).ids() == [2, 0]


def test_results_go_on_and_operands_stay(trio):
    a, b = trio.V(name="Ada"), trio.V(name="Bo")
    assert (a | b).outV().ids() == [1, 2]
    assert a.ids() == [0]
    assert (trio.E(year__lt=1905) | trio.E(year__gt=1905)).outV().ids() == [1, 2]


def test_mixed_kinds(trio):
    for f in (trio.union, trio.intersection, trio.difference, trio.symmetric_difference, trio.issubset, trio.issuperset):
        with pytest.raises(errors.MixedKind):
            f(trio.V(), trio.E())
    with pytest.raises(errors.MixedKind):
        trio.V() | trio.E()
