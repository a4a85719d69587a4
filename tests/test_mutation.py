"""New snapshots: adding, updating and removing; field rules; the index catalog."""

import pytest

from weftgraph import errors
from weftgraph.graph import PropertyGraph


def test_ids_follow_input_order_and_never_return(spark):
    g = PropertyGraph.empty(spark)
    assert g.add_node(a=1).get_id() == 0
    assert [n.get_id() for n in g.bulk_add_node([{"a": 2}, {"b": "x"}])] == [1, 2]
    g.v(2).remove()
    assert g.add_node().get_id() == 3
    assert g.V().ids() == [0, 1, 3]
    assert g.bulk_add_node([{}], silent=True) is None
    assert g.bulk_add_node([]) == []


def test_traversals_keep_their_snapshot(trio):
    before = trio.V()
    trio.V(name="Bo").remove()
    assert before.ids() == [0, 1, 2]
    assert trio.V().ids() == [0, 2]
    assert trio.E().count() == 0


def test_edges(trio):
    e = trio.add_edge(trio.v(2), trio.v(2), label="self")
    assert e.get_id() == 2
    assert trio.v(2).bothE().ids() == [1, 2, 2]
    trio.v(2).remove()
    assert trio.E().ids() == [0]
    trio.e(0).remove()
    assert trio.E().ids() == []
    assert trio.add_edge_by_ids(0, 1).get_id() == 3


@pytest.mark.parametrize("row", [(1, 2), (1, 2, {}, 4), "abc"])
def test_edge_shape(trio, row):
    with pytest.raises(errors.DataError):
        trio.bulk_add_edge([row])


def test_edge_ends(trio):
    with pytest.raises(errors.InvalidDataType):
        trio.add_edge("a", "b")
    with pytest.raises(errors.DataError):
        trio.bulk_add_edge([(trio.v(0), trio.v(1), 5)])
    with pytest.raises(errors.DataError):
        trio.add_edge(trio.v(0), trio.v(99))
    assert trio.E().count() == 2


@pytest.mark.parametrize("data", [{"_a": 1}, {"a_": 1}, {"a__b": 1}, {"1a": 1}, {"": 1}, {"a": object()}, {"a": [1, object()]}, {"a": {"_b": 1}}, {"a": (1,)}, {"a": b"x"}])
def test_invalid_data(trio, data):
    with pytest.raises(errors.InvalidDataType):
        trio.bulk_add_node([data])
    with pytest.raises(errors.InvalidDataType):
        trio.add_edge_by_ids(0, 1, **data)
    with pytest.raises(errors.InvalidDataType):
        trio.bulk_add_node([("a", 1)])


def test_update_merges(trio):
    trio.V(age=30).update(age=31, fresh="yes")
    assert trio.v(1).data() == {"rank": 1, "age": 31, "name": "Bo", "fresh": "yes"}
    assert trio.v(0).data()["age"] == 20
    trio.v(0).name = "Eve"
    assert trio.v(0).name == "Eve"
    trio.e(0).update(year=1999.5)
    assert trio.e(0).year == 1999.5
    trio.update_data("v", 2, "box", {"w": [1, 2]})
    assert trio.v(2).box == {"w": [1, 2]}
    trio.V(rank=1).outV().update(seen=True)
    assert trio.V(seen=True).ids() == [1, 2]
    with pytest.raises(errors.InvalidDataType):
        trio.V().update(_x=1)


def test_remove_takes_repeated_rows_once(trio):
    trio.V().bothV().remove()
    assert (trio.V().count(), trio.E().count()) == (0, 0)


def test_bulk_frames(spark):
    g = PropertyGraph.empty(spark)
    g.append_nodes(spark.range(1000, numPartitions=7).selectExpr("id * 2 AS twice"))
    assert g.V().count() == 1000
    assert {(r["id"], r["twice"]) for r in g.nodes.collect()} == {(i, 2 * i) for i in range(1000)}
    g.append_edges(spark.range(999, numPartitions=3).selectExpr("id AS src", "id + 1 AS dst", "id % 3 AS w"))
    assert g.V(_id=0).outV(3).ids() == [3]
    assert g.add_node().get_id() == 1000
    with pytest.raises(errors.DataError):
        g.append_edges(spark.createDataFrame([(0, 5000)], "src long, dst long"))


def test_index_catalog_is_transparent(trio):
    want = {k: trio.V(**k_).ids() for k, k_ in (("a", {"rank": 1}), ("b", {"name": "Cy"}))}
    trio.add_node_index("rank")
    trio.add_node_index("rank", "age", name="Bo")
    trio.add_edge_index("label")
    assert trio.get_node_indexes() == [[["rank"], {}], [["rank", "age"], {"name": "Bo"}]]
    assert trio.get_edge_indexes() == [[["label"], {}]]
    with pytest.raises(errors.IndexAlreadyExists):
        trio.add_node_index("rank")
    with pytest.raises(errors.IndexCreationFailed):
        trio.add_node_index()
    assert want == {"a": trio.V(rank=1).ids(), "b": trio.V(name="Cy").ids()}
    trio.remove_node_index("rank")
    with pytest.raises(errors.IndexRemovalFailed):
        trio.remove_node_index("rank")
    trio.remove_edge_index("label")
    assert trio.get_edge_indexes() == []


def test_supernode(spark):
    g = PropertyGraph.empty(spark)
    g.append_nodes(spark.range(1001).selectExpr("id AS n"))
    g.append_edges(spark.range(1, 1001).selectExpr("id AS src", "0L AS dst"))
    assert g.v(0).inV().count() == 1000
    g.v(0).remove()
    assert (g.V().count(), g.E().count()) == (1000, 0)


def test_fields_of_several_types(spark):
    """What entities disagree about is kept as it is and compared by its own type."""
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"x": 1}, {"x": "1"}, {"x": 1.5}, {"x": [1, "a"]}, {"x": {"k": 2, "a": None}}, {}, {"x": True}, {"x": "Text"}])
    found = lambda **f: g.V(**f).ids()
    assert g.V().data("x") == [{"x": 1}, {"x": "1"}, {"x": 1.5}, {"x": [1, "a"]}, {"x": {"k": 2, "a": None}}, {}, {"x": True}, {"x": "Text"}]
    assert found(x=1) == [0, 6]
    assert found(x="1") == [1]
    assert found(x=1.5) == [2]
    assert found(x=[1, "a"]) == [3]
    assert found(x={"a": None, "k": 2}) == [4]
    assert found(x__gt=1) == [2]
    assert found(x__gte="1") == [1, 7]
    assert found(x__contains="a") == [3, 4]
    assert found(x__contains=1) == [3]
    assert found(x__icontains="T") == [7]
    assert found(x__istartswith="te") == [7]
    assert found(x__in=[1.5, "Text"]) == [2, 7]
    assert found(x__in="12") == [1]
    assert found(x__isnull=True) == [5]
    assert g.V(_id__in=[0, 1, 2, 5, 7]).order_by("x").ids() == [5, 0, 2, 1, 7]
    assert g.V(_id__in=[0, 2]).sum("x * 2").pairs() == [(2, 3.0), (0, 2.0)]
    g.v(0).x = "now text"
    assert g.v(0).x == "now text"


def test_a_typed_field_widens(trio, tmp_path, spark):
    trio.add_node(age="unknown", rank=2.5)
    assert trio.V().data("age", "rank") == [{"age": 20, "rank": 1.0}, {"age": 30, "rank": 1.0}, {"age": 30, "rank": 2.0}, {"age": "unknown", "rank": 2.5}]
    assert trio.V(age=30).ids() == [1, 2]
    trio.v(0).update(age=[1])
    assert trio.v(0).age == [1]
    trio.write(str(tmp_path / "mixed.json"))
    copy = PropertyGraph.empty(spark)
    copy.read(str(tmp_path / "mixed.json"))
    assert copy.V().data("age") == trio.V().data("age")
    trio.save(str(tmp_path / "store"))
    assert PropertyGraph.load(spark, str(tmp_path / "store")).V(age__isnull=False).data("age") == trio.V().data("age")
    trio.v(1).update(name={"first": "Bo"})
    assert trio.V().data("name")[:2] == [{"name": "Ada"}, {"name": {"first": "Bo"}}]


def test_many_single_additions_leave_a_small_plan(spark):
    g = PropertyGraph.empty(spark)
    first = g.add_node(n=0)
    plan = lambda: len(g.nodes._jdf.queryExecution().optimizedPlan().toString())
    for i in range(1, 1000):
        node = g.add_node(n=i)
        if i % 3 == 0:
            g.add_edge(first, node, w=i)
        if i % 250 == 0:
            assert g.nodes.filter(f"n = {i}").count() == 1
    assert plan() < 15_000
    assert g.V().count() == 1000
    assert g.E().sum("w").frame().agg({"value": "sum"}).first()[0] == sum(range(3, 1000, 3))
    for i in range(20):
        g.v(0).update(n=-i)
    assert plan() < 15_000
    assert g.v(0).n == -19


def test_batch(trio, spark):
    with trio.batch() as b:
        dee = b.add_node(name="Dee")
        b.add_edge(trio.v(0), dee, label="new")
        b.add_edge(dee, trio.v(1))
        b.update(trio.v(0), age=21, extra=True)
        b.update(trio.v(0), age=22)
        b.update(trio.v(2), name="Zoe", note="z")
        b.remove(trio.v(1))
        assert trio.V().ids() == [0, 1, 2]
    assert trio.V().ids() == [0, 2, 3]
    assert trio.E().data("label") == [{"label": "new"}]
    assert trio.v(0).data() == {"rank": 1, "age": 22, "name": "Ada", "note": "only here", "extra": True}
    assert trio.v(2).data() == {"rank": 2, "age": 30, "name": "Zoe", "note": "z"}
    with pytest.raises(errors.DataError):
        b.apply()


def test_a_batch_that_fails_changes_nothing(trio):
    with pytest.raises(errors.DataError), trio.batch() as b:
        b.add_node(name="Dee")
        b.remove(trio.v(0))
        b.add_edge(trio.v(0), trio.v(99))
    with pytest.raises(ZeroDivisionError), trio.batch() as b:
        b.add_node(name="Dee")
        raise ZeroDivisionError
    with pytest.raises(errors.InvalidDataType), trio.batch() as b:
        b.add_edge("a", trio.v(0))
    assert trio.V().ids() == [0, 1, 2]
    a, b = trio.batch(), trio.batch()
    a.add_node(name="x")
    b.add_node(name="y")
    b.update(trio.v(0), name="later")
    a.update(trio.v(0), name="first")
    a.merge(b)
    a.apply()
    assert sorted(n["name"] for n in trio.V().data()) == ["Bo", "Cy", "later", "x", "y"]


def test_fields_that_bear_system_names(spark, tmp_path):
    g = PropertyGraph.empty(spark)
    a, b = g.bulk_add_node([{"id": "x7", "src": 1, "ID2": 1}, {"id": "x8", "dst": 2}])
    g.add_edge(a, b, id=5, src="here", dst="there")
    g.v(1).update(id="x9")
    assert g.V(id="x7").ids() == [0]
    assert g.V().data() == [{"id": "x7", "src": 1, "ID2": 1}, {"id": "x9", "dst": 2}]
    assert g.E(id=5, src="here").data("id", "dst", flat=True) == [[5, "there"]]
    assert g.E().sum("id * 2").pairs() == [(0, 10)]
    assert g.V().order_by("-id").ids() == [1, 0]
    assert '[label="x7"]' in str(g.V().dot(node_label="id"))
    g.write(str(tmp_path / "dump.json"))
    copy = PropertyGraph.empty(spark)
    copy.read(str(tmp_path / "dump.json"))
    assert copy.V().data() == g.V().data()
    assert copy.E().data() == g.E().data()
    copy.append_nodes(spark.createDataFrame([("x1", 4)], "id string, src long"))
    assert copy.V(id="x1", src=4).ids() == [2]


def test_stored_indexes_answer_scans_alone(trio, tmp_path, spark):
    trio.add_node_index("rank", "age")
    trio.add_node_index("name", rank=1)
    trio.add_edge_index("label")
    path = str(tmp_path / "store")
    trio.save(path)
    back = PropertyGraph.load(spark, path)
    source = lambda **f: back.V(**f).frame().inputFiles()[0]
    for filters, where in (({"rank": 1, "age__in": [20, 30]}, "index-v-0"), ({"name": "Bo", "rank": 1}, "index-v-1"), ({"name": "Bo"}, "nodes"), ({"rank": 1, "age__gt": 20}, "nodes"), ({"rank": 1}, "nodes")):
        assert f"/{where}/" in source(**filters)
        assert back.V(**filters).ids() == trio.V(**filters).ids()
    assert "/index-e-0/" in back.E(label="likes").frame().inputFiles()[0]
    index = back._now.indexes["v"][0]
    with pytest.raises(errors.IncompetentIndex):
        index.ids({"rank": 1})
    back.v(0).update(rank=7)
    assert back.V(rank=1, age__in=[20, 30]).ids() == [1]
