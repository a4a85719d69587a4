"""JSON dump, Parquet store, edge lists, Graphviz text, the star schema, numbering."""

import json
import sys

import pytest

from weftgraph import errors
from weftgraph.graph import PropertyGraph
from weftgraph.sources.export import simple_edges
from weftgraph.sources.files import ParquetStore, edge_list
from weftgraph.sources.star import LINES, Star
from weftgraph.storage import numbered


def test_json_dump(trio, tmp_path, spark):
    trio.add_node_index("rank", age=30)
    path = str(tmp_path / "dump.json")
    trio.write(path)
    found = json.loads((tmp_path / "dump.json").read_text())
    assert found["nodes"][1] == {"rank": 1, "age": 30, "name": "Bo", "_id": 1}
    assert found["edges"][0] == {"label": "likes", "year": 1901, "town": "oslo", "rank": "HiGh", "_src": 0, "_tgt": 1}
    assert found["node_indexes"] == [[["rank"], {"age": 30}]]
    copy = PropertyGraph.empty(spark)
    copy.add_node(name="first")
    assert copy.read(path) == {0: 1, 1: 2, 2: 3}
    assert copy.V(name="Ada").outV(2).data("name", flat=True) == [["Cy"]]
    assert copy.get_node_indexes() == [[["rank"], {"age": 30}]]
    own = {}
    assert copy.read(path, own) is own
    assert copy.V(name="Ada").count() == 2


def test_empty_dump(spark, tmp_path):
    g = PropertyGraph.empty(spark)
    g.write(str(tmp_path / "none.json"))
    assert PropertyGraph.empty(spark).read(str(tmp_path / "none.json")) == {}


def test_store(trio, tmp_path, spark):
    path = str(tmp_path / "store")
    trio.add_node_index("name")
    trio.save(path)
    back = PropertyGraph.load(spark, path)
    assert back.V().data() == trio.V().data()
    assert back.E(label="helps").inV().data("name", flat=True) == [["Bo"]]
    assert back.get_node_indexes() == [[["name"], {}]]
    back.V(name="Bo").remove()
    back.save(path)
    assert PropertyGraph.load(spark, path).V().ids() == [0, 2]
    with pytest.raises(errors.DataPreparationFailed):
        PropertyGraph.load(spark, str(tmp_path / "nowhere"))


def test_edge_list(spark, tmp_path):
    (tmp_path / "web.txt").write_text("# from to\n b\ta\n\na c\nb a\n")
    g = edge_list(spark, str(tmp_path / "web.txt"))
    assert [n.gid for n in g.V().all()] == ["a", "b", "c"]
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [(0, 2), (1, 0), (1, 0)]
    assert g.V(gid="b").outV().data("gid", flat=True) == [["a"], ["a"]]
    assert g.get_node_indexes() == [[["gid"], {}]]


def test_dot(trio):
    text = trio.V().dot(node_label="name", edge_label="label").to_dot()
    assert text.splitlines() == ["digraph G {", '  0 [label="Ada"];', '  1 [label="Bo"];', '  2 [label="Cy"];', '  0 -> 1 [label="likes"];', '  1 -> 2 [label="helps"];', "}"]
    assert str(trio.V().dot(limit=2)).count("->") == 1
    assert '[label="0"]' in str(trio.E(label="likes").dot())
    trio.v(0).name = 'A"da<>'
    assert 'label="Ada"' in str(trio.V().dot(node_label="name"))
    with pytest.raises(AssertionError):
        trio.V().dot(limit=0)


def test_simple_edges(trio):
    trio.add_edge_by_ids(0, 1, label="again")
    assert sorted((r["src"], r["dst"], r["label"]) for r in simple_edges(trio).collect()) == [(0, 1, "again"), (1, 2, "helps")]


def test_networkx_graph(trio, monkeypatch):
    """With a stand-in that keeps what it is given."""

    class DiGraph:
        def __init__(self):
            self.nodes, self.edges = {}, {}

        def add_nodes_from(self, rows):
            self.nodes.update(dict(rows))

        def add_edges_from(self, rows):
            self.edges.update({(s, t): d for s, t, d in rows})

    monkeypatch.setitem(sys.modules, "networkx", type(sys)("networkx"))
    sys.modules["networkx"].DiGraph = DiGraph
    trio.add_edge_by_ids(0, 1, label="again", id=7)
    made = trio.nx_graph()
    assert made.nodes[1] == {"rank": 1, "age": 30, "name": "Bo"}
    assert made.edges == {(0, 1): {"label": "again", "id": 7}, (1, 2): {"label": "helps", "year": 1907, "town": "Oslo", "rank": "igloo"}}


def test_an_order_of_too_many_lines_is_an_error(spark, tmp_path):
    spark.range(LINES + 1).selectExpr("1L AS l_orderkey", "1L AS l_partkey", "1L AS l_suppkey", "int(id) AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "timestamp_ntz'2020-01-01 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(Exception, match="an order of more than"):
        Star(spark, str(tmp_path)).edges("contains").agg({"id": "max"}).collect()


def test_networkx_is_optional(trio):
    try:
        import networkx  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            trio.nx_graph()
    else:
        assert list(trio.nx_graph().edges) == [(0, 1), (1, 2)]


def test_star_reads_only_the_tables_it_needs(spark, sf_dir):
    g = Star(spark, sf_dir).graph(("part",), ("contains",))
    assert set(g.nodes.columns) == {"id", "kind", "name", "brand", "type", "size", "retailprice"}
    whole = Star(spark, sf_dir).graph()
    for part in (whole.nodes, whole.edges):
        assert part.count() == part.select("id").distinct().count()
    ends = whole.edges.selectExpr("src AS id").union(whole.edges.selectExpr("dst AS id"))
    assert ends.join(whole.nodes, "id", "left_anti").isEmpty()


def test_numbering_keeps_the_order_of_rows(spark):
    df = spark.range(500, numPartitions=9).selectExpr("999 - id AS x").orderBy("x")
    got = {r["x"]: r["no"] for r in numbered(df, "no", 10).collect()}
    assert got == {x: 10 + x - 500 for x in range(500, 1000)}
    assert numbered(spark.range(0), "no").count() == 0


def test_store_versions(trio, tmp_path, spark):
    store = ParquetStore(str(tmp_path / "store"), keep=1)
    trio.save(store)
    first = store.load(spark)
    staged = store.stage(trio)
    assert store.load(spark).V().count() == 3
    store.commit(trio, staged)
    trio.add_node(name="Dee")
    assert store.load(spark).V().count() == 3
    trio.save(store)
    assert store.load(spark).V().count() == 4
    assert store.load(spark, staged).V().count() == 3
    with pytest.raises(errors.MissingKey):
        store.load(spark, "0" * 32)
    assert len([p for p in (tmp_path / "store").iterdir() if len(p.name) == 32]) == 2
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        first.V().count()
