"""Keyword predicates: each lookup by column type, and errors at build time."""

import pytest

from weftgraph import errors
from weftgraph.graph import PropertyGraph


def ids(g, **filters):
    return g.V(**filters).ids()


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({}, [0, 1, 2]),
        ({"rank": 1}, [0, 1]),
        ({"rank": 1.0}, [0, 1]),
        ({"rank": True}, [0, 1]),
        ({"rank": "1"}, []),
        ({"rank": 1, "age": 30}, [1]),
        ({"name__exact": "Bo"}, [1]),
        ({"name": 5}, []),
        ({"name": None}, []),
        ({"nothing": 5}, []),
        ({"name__iexact": "bO"}, [1]),
        ({"age__iexact": "20"}, []),
        ({"name__contains": "d"}, [0]),
        ({"name__icontains": "A"}, [0]),
        ({"name__in": ["Ada", "Cy", 7]}, [0, 2]),
        ({"name__in": ("Bo",)}, [1]),
        ({"name__in": {"Bo"}}, [1]),
        ({"name__in": "Ada and Bo"}, [0, 1]),
        ({"rank__in": [2.0, "1"]}, [2]),
        ({"rank__in": 7}, []),
        ({"rank__in": []}, []),
        ({"rank__gt": 1}, [2]),
        ({"rank__gte": 1}, [0, 1, 2]),
        ({"age__lt": 30}, [0]),
        ({"age__lte": 30.5}, [0, 1, 2]),
        ({"name__gt": "B"}, [1, 2]),
        ({"name__gt": 3}, []),
        ({"name__startswith": "A"}, [0]),
        ({"name__istartswith": "c"}, [2]),
        ({"name__endswith": "o"}, [1]),
        ({"name__iendswith": "O"}, [1]),
        ({"age__startswith": "2"}, []),
        ({"note__isnull": True}, [1, 2]),
        ({"note__isnull": False}, [0]),
        ({"nothing__isnull": True}, [0, 1, 2]),
        ({"nothing__isnull": False}, []),
        ({"_id": 1}, [1]),
        ({"_id__gte": 1, "_id__lt": 2}, [1]),
        ({"_id__in": [0, 2, 9]}, [0, 2]),
        ({"id": 1}, []),
    ],
)
def test_scan(trio, filters, want):
    assert ids(trio, **filters) == want


def test_edges_have_their_own_types(trio):
    assert trio.E(rank__iexact="high").ids() == [0]
    assert trio.E(year__gt=1901, town="Oslo").ids() == [1]
    assert trio.E(src=0).ids() == []
    assert trio.V(name="Ada").outV(name="Bo").ids() == [1]
    assert trio.V(name="Ada").outV(name="Cy").ids() == []


def test_structures(spark):
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"tags": ["a", "b"], "where": {"x": 1, "y": 2}}, {"tags": ["b"], "where": {"x": 1}}, {"tags": []}])
    assert ids(g, tags=["a", "b"]) == [0]
    assert ids(g, tags=[]) == [2]
    assert ids(g, tags__contains="b") == [0, 1]
    assert ids(g, tags__contains=1) == []
    assert ids(g, tags__gt=["a"]) == [0, 1]
    assert ids(g, where={"x": 1, "y": 2}) == [0]
    assert ids(g, where={"x": 1}) == [1]
    assert ids(g, where__contains="y") == [0]


def test_bool_and_nan(spark):
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"on": True, "x": 1.5}, {"on": False, "x": float("nan")}, {"x": 2}])
    assert ids(g, on=1) == [0]
    assert ids(g, on__lt=1) == [1]
    assert ids(g, x=float("nan")) == []
    assert ids(g, x__gt=0) == [0, 2]


@pytest.mark.parametrize(("key", "error"), [("rank__foo", errors.InvalidLookup), ("rank__sub__gt", errors.SubLookupNotImplemented), ("_id__nope", errors.InvalidLookup)])
def test_errors_come_when_the_plan_is_built(trio, key, error):
    for make in (trio.V, trio.E, trio.V().outV, trio.V().outE, trio.V().in_, trio.V().both_):
        with pytest.raises(error):
            make(**{key: 1})


def test_filters_reach_the_scan(spark, sf_dir):
    from weftgraph.sources.star import Star

    plan = Star(spark, sf_dir).graph(("part",), ("contains",)).V(size__gt=40).frame()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
