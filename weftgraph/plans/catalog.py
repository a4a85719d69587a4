"""Registered graph queries over the star schema, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import paths
from ..operators.traversal import Traversal
from ..sources.export import simple_edges
from ..sources.files import edge_list
from ..sources.star import LINES, STEP, Star
from ..storage import fresh_path, numbered
from .commands import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1"
_VIEWS = {
    "region_n": f"SELECT {1 * STEP} + r_regionkey AS id, r_name AS name FROM region",
    "nation_n": f"SELECT {2 * STEP} + n_nationkey AS id, n_name AS name FROM nation",
    "cust": f"SELECT {3 * STEP} + c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer",
    "supp": f"SELECT {4 * STEP} + s_suppkey AS id, s_name AS name, s_acctbal AS acctbal FROM supplier",
    "prt": f"SELECT {5 * STEP} + p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS retailprice FROM part",
    "ord": f"SELECT {6 * STEP} + o_orderkey AS id, o_orderstatus AS status, o_totalprice AS totalprice, o_orderpriority AS priority FROM orders",
    "in_region": f"SELECT {1 * STEP} + n_nationkey AS id, {2 * STEP} + n_nationkey AS src, {1 * STEP} + n_regionkey AS dst FROM nation",
    "cust_nation": f"SELECT {2 * STEP} + c_custkey AS id, {3 * STEP} + c_custkey AS src, {2 * STEP} + c_nationkey AS dst FROM customer",
    "placed": f"SELECT {4 * STEP} + o_orderkey AS id, {3 * STEP} + o_custkey AS src, {6 * STEP} + o_orderkey AS dst, o_totalprice AS totalprice FROM orders",
    "contains": f"SELECT {5 * STEP} + l_orderkey * {LINES} + {_LINE} AS id, {6 * STEP} + l_orderkey AS src, {5 * STEP} + l_partkey AS dst, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_returnflag AS returnflag, l_linenumber AS linenumber FROM lineitem",
    "supplied": f"SELECT {6 * STEP} + l_orderkey * {LINES} + {_LINE} AS id, {4 * STEP} + l_suppkey AS src, {5 * STEP} + l_partkey AS dst, l_quantity AS quantity FROM lineitem",
    "ring": f"SELECT {8 * STEP} + n_nationkey * 2 + p AS id, {2 * STEP} + n_nationkey AS src, {2 * STEP} + (n_nationkey + d) % 25 AS dst, 1 + n_nationkey % 5 AS weight FROM nation, (VALUES (0, 1), (1, 7)) v(p, d)",
}


def _with(sql: str, recursive: bool = False) -> str:
    """The views that a query names, before it."""
    used = [n for n in _VIEWS if f" {n} " in f" {sql.replace('(', ' ').replace(')', ' ').replace(',', ' ')} "]
    head = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body[5:]}" if head else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if head else body


def query(sql: str | None, nodes: str = "", edges: str = "", name: str | None = None, recursive: bool = False):
    """Register a function of a graph with the kinds it needs."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            star = Star(spark, sf_dir)
            return f(star.graph(tuple(nodes.split()) or ("nation",), tuple(edges.split()) or ("ring",)))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = _with(sql, recursive)
        return f

    return register


def ids(t: Traversal) -> DataFrame:
    return t.frame().select(F.col("_id").alias("id"))


def counted(t: Traversal) -> DataFrame:
    """Each entity with its number of paths."""
    return t.counts().select(F.col("_id").alias("id"), F.col("_m").cast("long").alias("paths"))


def fields(t: Traversal, *names: str) -> DataFrame:
    return t.data_frame(*names).select(F.col("_id").alias("id"), *names)


def ranked(t: Traversal, k: int) -> DataFrame:
    """The first k rows with their rank; the ranking runs over k rows."""
    first = t.frame().orderBy("_ord").limit(k)
    return first.select(F.col("_id").alias("id"), F.row_number().over(Window.orderBy("_ord")).cast("long").alias("rank"))


def top(agg, k: int) -> DataFrame:
    """The first k pairs of an aggregate with their rank."""
    first = agg._sorted().limit(k).select("_id", "_v", "_ord")
    order = F.col("_v").asc() if agg._asc else F.col("_v").desc()
    return first.select(F.col("_id").alias("id"), F.col("_v").alias("value"), F.row_number().over(Window.orderBy(order, "_ord")).cast("long").alias("rank"))


def ranked_all(df: DataFrame) -> DataFrame:
    """A sorted frame with the rank of each row; no task sees all rows."""
    return numbered(df, "rank", 1)


def one(g: PropertyGraph, **values: object) -> DataFrame:
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}
    return g.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in values.items()))


ALL_N, P, C, O, PC = "region nation customer supplier part order", "part", "customer", "order", "placed contains"  # noqa: E741
A = 5 * STEP  # part ids begin here

# scans and point reads
query("SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders", "customer part order", name="scan_v")(lambda g: g.V().data_frame("kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("SELECT 'placed' AS rel, count(*) AS n FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem", "order", PC, name="scan_e")(lambda g: g.E().data_frame("rel").groupBy("rel").agg(F.count(F.lit(1)).alias("n")))
query(f"SELECT id, name FROM prt WHERE id = {A + 7}", P, name="point_v")(lambda g: fields(g.V(_id=A + 7), "name"))
query(f"SELECT id FROM prt WHERE id IN ({A + 1}, {A + 5}, {A + 999999})", P, name="id_in")(lambda g: ids(g.V(_id__in=[A + 1, A + 5, A + 999999])))
query(f"SELECT id FROM prt WHERE id > {A + 40} AND id <= {A + 90}", P, name="id_range")(lambda g: ids(g.V(_id__gt=A + 40, _id__lte=A + 90)))
query("SELECT id, name, brand FROM prt", P, name="data_fields")(lambda g: fields(g.V(), "name", "brand"))
query("SELECT id, concat_ws('|', brand, type) AS flat FROM prt", P, name="data_flat")(lambda g: fields(g.V(), "brand", "type").select("id", F.concat_ws("|", "brand", "type").alias("flat")))
query("SELECT dst AS id FROM placed JOIN cust ON src = cust.id WHERE mktsegment = 'BUILDING'", "customer order", "placed", name="ids")(lambda g: ids(g.V(mktsegment="BUILDING").outV()))
query("SELECT id FROM nation_n", "nation", name="all_nodes")(lambda g: ids(g.V()))
query("SELECT (SELECT id FROM nation_n ORDER BY id LIMIT 1) AS first, (SELECT id FROM nation_n ORDER BY id LIMIT 1 OFFSET 1) AS second, (SELECT name FROM nation_n ORDER BY id LIMIT 1 OFFSET 1) AS name", "nation", name="next_node")(lambda g: (lambda t: one(g, first=t.next().get_id(), **(lambda n: {"second": n.get_id(), "name": n.name})(t.next())))(g.V()))

# lookups
for _name, _filters, _where in (
    ("lk_exact", {"brand": "Brand#11"}, "brand = 'Brand#11'"),
    ("lk_iexact", {"brand__iexact": "bRaNd#12"}, "lower(brand) = 'brand#12'"),
    ("lk_contains", {"type__contains": "A"}, "contains(type, 'A')"),
    ("lk_icontains", {"type__icontains": "a"}, "contains(lower(type), 'a')"),
    ("lk_in", {"size__in": [1, 5, 7.0, "x", True]}, "size IN (1, 5, 7)"),
    ("lk_in_string", {"brand__in": "Brand#11,Brand#13"}, "contains('Brand#11,Brand#13', brand)"),
    ("lk_gt", {"size__gt": 40}, "size > 40"),
    ("lk_gte", {"size__gte": 40}, "size >= 40"),
    ("lk_lt", {"retailprice__lt": 1000}, "retailprice < 1000"),
    ("lk_lte", {"retailprice__lte": 1000.5}, "retailprice <= 1000.5"),
    ("lk_startswith", {"name__startswith": "red"}, "starts_with(name, 'red')"),
    ("lk_istartswith", {"name__istartswith": "BLUE"}, "starts_with(lower(name), 'blue')"),
    ("lk_endswith", {"name__endswith": "ring"}, "ends_with(name, 'ring')"),
    ("lk_iendswith", {"type__iendswith": "l"}, "ends_with(lower(type), 'l')"),
    ("lk_and", {"size__gt": 10, "size__lt": 20, "brand__contains": "1"}, "size > 10 AND size < 20 AND contains(brand, '1')"),
    ("lk_type_mismatch", {"name__gt": 1}, "false"),
    ("lk_none", {"name": None}, "false"),
):
    query(f"SELECT id FROM prt WHERE {_where}", P, name=_name)(lambda g, f=_filters: ids(g.V(**f)))
query("SELECT id FROM prt", "customer part", name="lk_isnull")(lambda g: ids(g.V(mktsegment__isnull=True)))
query("SELECT id FROM cust", "customer part", name="lk_notnull")(lambda g: ids(g.V(mktsegment__isnull=False)))
query("SELECT id FROM contains WHERE returnflag = 'R' AND quantity >= 20 AND quantity < 30", "order", "contains", name="lk_edge")(lambda g: ids(g.E(returnflag="R", quantity__gte=20, quantity__lt=30)))

# traversals
query("SELECT dst AS id FROM placed JOIN cust ON src = cust.id WHERE acctbal < 500", "customer order", "placed", name="outv")(lambda g: ids(g.V(acctbal__lt=500).outV()))
query("SELECT dst AS id FROM nation_n JOIN ring ON src = nation_n.id UNION ALL SELECT src FROM nation_n JOIN ring ON dst = nation_n.id", name="bothv")(lambda g: ids(g.V().bothV()))
query("SELECT dst AS id FROM contains UNION ALL SELECT src FROM placed", "customer order part", PC, name="bothv_orders")(lambda g: ids(g.V(kind="order").bothV()))
query("SELECT id FROM contains UNION ALL SELECT id FROM placed", "customer order part", PC, name="bothe_orders")(lambda g: ids(g.V(kind="order").bothE()))
query("SELECT dst AS id, count(*) AS paths FROM contains WHERE quantity > 10 GROUP BY dst", "customer order part", PC, name="both_orders")(lambda g: counted(g.V(kind="order").both_(quantity__gt=10)))
query("SELECT placed.id FROM placed JOIN cust ON src = cust.id WHERE mktsegment = 'MACHINERY' AND totalprice > 1000", "customer order", "placed", name="oute")(lambda g: ids(g.V(mktsegment="MACHINERY").outE(totalprice__gt=1000)))
query("SELECT src AS id FROM contains", "part order", "contains", name="inv")(lambda g: ids(g.V(kind="part").inV()))
query("SELECT id FROM contains WHERE returnflag = 'A'", "part", "contains", name="ine")(lambda g: ids(g.V(kind="part").inE(returnflag="A")))
query("SELECT r.id FROM ring r UNION ALL SELECT r.id FROM ring r", name="bothe")(lambda g: ids(g.V().bothE()))
query("SELECT src AS id FROM placed WHERE totalprice > 300000", "customer order", "placed", name="edge_inv")(lambda g: ids(g.E(totalprice__gt=300000).inV()))
query("SELECT dst AS id FROM placed WHERE totalprice > 300000", "customer order", "placed", name="edge_outv")(lambda g: ids(g.E(totalprice__gt=300000).outV()))
query("SELECT src AS id FROM placed WHERE totalprice > 300000 UNION ALL SELECT dst FROM placed WHERE totalprice > 300000", "customer order", "placed", name="edge_bothv")(lambda g: ids(g.E(totalprice__gt=300000).bothV()))
query("SELECT c.dst AS id, count(*) AS paths FROM placed p JOIN cust ON p.src = cust.id JOIN contains c ON c.src = p.dst WHERE mktsegment = 'BUILDING' AND c.quantity > 45 GROUP BY c.dst", "customer order part", PC, name="out_")(lambda g: counted(g.V(mktsegment="BUILDING").outV().out_(quantity__gt=45)))
query("SELECT src AS id, count(*) AS paths FROM contains WHERE dst IN (SELECT id FROM prt WHERE brand = 'Brand#11') AND quantity <= 5 GROUP BY src", "part order", "contains", name="in_")(lambda g: counted(g.V(kind="part", brand="Brand#11").in_(quantity__lte=5)))
query("SELECT dst AS id FROM ring WHERE weight > 2 AND src <> dst UNION ALL SELECT src FROM ring WHERE weight > 2 AND src <> dst", name="both_")(lambda g: ids(g.V().both_(weight__gt=2)))
query("SELECT c.dst AS id, count(*) AS paths FROM placed p JOIN contains c ON c.src = p.dst GROUP BY c.dst", "customer order part", PC, name="outv_n2")(lambda g: counted(g.V(kind="customer").outV(2)))
query("SELECT c.dst AS id, count(*) AS paths FROM ring a JOIN ring b ON a.dst = b.src JOIN ring c ON b.dst = c.src GROUP BY c.dst", name="outv_n3")(lambda g: counted(g.V().outV(3)))
query("SELECT b.dst AS id, count(*) AS paths FROM ring a JOIN ring b ON a.dst = b.src WHERE a.weight < 4 AND b.weight < 4 GROUP BY b.dst", name="out_n2_filtered")(lambda g: counted(g.V().out_(2, weight__lt=4)))
_BOTH = "SELECT src AS a, dst AS b FROM ring WHERE src <> dst UNION ALL SELECT dst, src FROM ring WHERE src <> dst"
query(f"WITH h AS ({_BOTH}) SELECT y.b AS id, count(*) AS paths FROM h x JOIN h y ON x.b = y.a GROUP BY y.b", name="both_n2")(lambda g: counted(g.V().both_(2)))
query("SELECT src AS root, arg_min(dst, md5(concat(id, ':', src, ':', 7))) AS id FROM placed GROUP BY src", "customer order", "placed", name="random_outv")(lambda g: g.V(kind="customer").aka("r").random("outV", seed=7).frame().select(F.col("_a_r").alias("root"), F.col("_id").alias("id")))
query("SELECT dst AS root, arg_min(id, md5(concat(id, ':', dst, ':', 3))) AS id FROM contains GROUP BY dst", "part", "contains", name="random_ine")(lambda g: g.V(kind="part").aka("r").random("inE", seed=3).frame().select(F.col("_a_r").alias("root"), F.col("_id").alias("id")))


@query(f"SELECT EXISTS (SELECT 1 FROM contains WHERE dst = {A + 3}) AS hit, false AS miss", "order part", "contains")
def contains_entity(g):
    it = g.V(kind="order").outV()
    return one(g, hit=g.v(A + 3) in it, miss=g.e(A + 3) in it)


# aliases
query("SELECT DISTINCT dst AS id FROM contains", "order part", "contains", name="dedup")(lambda g: ids(g.V(kind="order").outV().dedup()))
query("SELECT p.dst AS o, x.dst AS a FROM placed p JOIN contains x ON x.src = p.dst", "customer order part", PC, name="aka_collect2")(lambda g: g.V(kind="customer").outV().aka("o").outV().aka("a").collect_frame("o", "a").drop("_ord"))
query("SELECT p.src AS c, p.dst AS o, x.dst AS a FROM placed p JOIN contains x ON x.src = p.dst", "customer order part", PC, name="aka_collect3")(lambda g: g.V(kind="customer").aka("c").outV().aka("o").outV().aka("a").collect_frame("c", "o", "a").drop("_ord"))
query("SELECT DISTINCT p.src AS c, x.dst AS id FROM placed p JOIN contains x ON x.src = p.dst", "customer order part", PC, name="dedup_alias")(lambda g: g.V(kind="customer").aka("c").outV(2).dedup("c").frame().select(F.col("_a_c").alias("c"), F.col("_id").alias("id")))
query("SELECT z.dst AS id, count(*) AS paths FROM placed p JOIN contains x ON x.src = p.dst JOIN contains y ON y.dst = x.dst JOIN contains z ON z.src = y.src WHERE z.dst <> x.dst GROUP BY z.dst", "customer order part", PC, name="without")(lambda g: counted(g.V(kind="customer").outV().outV().aka("a").inV().outV().without("a")))

# aggregates and the expression language
query("SELECT count(*) AS n FROM placed p JOIN contains c ON c.src = p.dst", "customer order part", PC, name="count_paths")(lambda g: one(g, n=g.V(kind="customer").outV(2).count()))


def _aggregate(name: str, sql_value: str, make: Callable, cast: str = "BIGINT") -> None:
    """Sums over order -> part edges, grouped by part; doubles are compared after rounding."""
    value = f"CAST({sql_value} AS BIGINT)" if cast == "BIGINT" else f"round({sql_value}, 4)"
    query(f"SELECT c.dst AS id, {value} AS value FROM contains c JOIN prt ON prt.id = c.dst JOIN ord ON ord.id = c.src GROUP BY c.dst", "order part", "contains", name=name)(lambda g: make(g).frame().select("id", F.col("value") if cast == "BIGINT" else F.round("value", 4).alias("value")))


_aggregate("sum_default", "count(*)", lambda g: g.V(kind="order").outV().sum())
_aggregate("sum_expr_prop", "sum(prt.size)", lambda g: g.V(kind="order").outV().sum("size"))
_aggregate("sum_expr_alias", "sum(c.quantity * c.linenumber)", lambda g: g.V(kind="order").outE().aka("l").outV().sum("_.l.quantity*_.l.linenumber"), "DOUBLE")
_aggregate("sum_expr_cond", "sum(CASE WHEN c.linenumber > 3 THEN 2 ELSE 1 END)", lambda g: g.V(kind="order").outE().aka("l").outV().sum("2 if _.l.linenumber > 3 else 1"))
_aggregate("sum_expr_arith", "sum((prt.size + 3) * 2 - prt.size / 4.0)", lambda g: g.V(kind="order").outV().sum("(size + 3) * 2 - size / 4"), "DOUBLE")
_aggregate("sum_floor_pow", "sum(floor((7 - prt.size) / 4.0) + prt.size ** 2)", lambda g: g.V(kind="order").outV().sum("(7 - size) // 4 + size ** 2"))
_aggregate("sum_chain_compare", "sum(CASE WHEN CAST(1 < prt.size AS INT) < 3 THEN 1 ELSE 0 END)", lambda g: g.V(kind="order").outV().sum("1 < size < 3"))
_aggregate("sum_missing_alias", "sum(prt.size + 0)", lambda g: g.V(kind="order").aka("o").outV().sum("size + _.o.nothing + _.nobody.x"))
query("WITH s AS (SELECT dst AS id, count(*) AS n FROM contains GROUP BY dst) SELECT id, round(n / sum(n) OVER (), 12) AS value FROM s", "order part", "contains", name="percent")(lambda g: g.V(kind="order").outV().percent().frame().select("id", F.round("value", 12).alias("value")))
query("WITH s AS (SELECT dst AS id, sum(size) AS n FROM contains JOIN prt ON prt.id = dst GROUP BY dst) SELECT id, round(n / sum(n) OVER (), 12) AS value FROM s", "order part", "contains", name="percent_expr")(lambda g: g.V(kind="order").outV().percent("size").frame().select("id", F.round("value", 12).alias("value")))
_TOP = "WITH s AS (SELECT o.dst AS id, CAST(count(*) AS BIGINT) AS value, min(cast(o.src AS HUGEINT) * 100000000000000000 + o.id) AS first FROM contains o GROUP BY o.dst) SELECT id, value, row_number() OVER (ORDER BY value {}, first) AS rank FROM s ORDER BY rank LIMIT 15"
query(_TOP.format("DESC"), "order part", "contains", name="sum_limit")(lambda g: top(g.V(kind="order").outV().sum(), 15))
query(_TOP.removesuffix(" ORDER BY rank LIMIT 15").format("ASC"), "order part", "contains", name="sum_asc")(lambda g: ranked_all(g.V(kind="order").outV().sum(asc=True)._sorted().select(F.col("_id").alias("id"), F.col("_v").alias("value"))))
query(f"WITH s AS (SELECT o.dst AS id, count(*) AS value, min(cast(o.src AS HUGEINT) * 100000000000000000 + o.id) AS first FROM contains o GROUP BY o.dst), t AS (SELECT id FROM s ORDER BY value DESC, first LIMIT 5) SELECT src AS id, count(*) AS paths FROM contains WHERE dst IN (SELECT id FROM t) GROUP BY src", "order part", "contains", name="sum_entities_next")(lambda g: counted(g.V(kind="order").outV().sum().limit(5).entities().inV()))

# order and limits
for _name, _clauses, _order in (("order_asc", ("name",), "name, id"), ("order_desc", ("-retailprice",), "retailprice DESC, id"), ("order_mix", ("brand", "-size"), "brand, size DESC, id")):
    query(f"SELECT id, row_number() OVER (ORDER BY {_order}) AS rank FROM prt", P, name=_name)(lambda g, c=_clauses: ranked_all(g.V().order_by(*c).frame().select(F.col("_id").alias("id"))))
for _name, _clause, _order in (("order_nulls_asc", "mktsegment", "mktsegment ASC NULLS FIRST, id"), ("order_nulls_desc", "-mktsegment", "mktsegment DESC NULLS LAST, id")):
    query(f"SELECT id, row_number() OVER (ORDER BY {_order}) AS rank FROM (SELECT id, mktsegment FROM cust UNION ALL SELECT id, NULL FROM prt)", "customer part", name=_name)(lambda g, c=_clause: ranked_all(g.V().order_by(c).frame().select(F.col("_id").alias("id"))))
query("SELECT id, row_number() OVER (ORDER BY size DESC, name, id) AS rank FROM prt ORDER BY rank LIMIT 50", P, name="order_limit")(lambda g: ranked(g.V().order_by("-size", "+name"), 50))
query("SELECT dst AS id, row_number() OVER (ORDER BY src, id) AS rank FROM contains ORDER BY rank LIMIT 40", "order part", "contains", name="limit_ordered")(lambda g: ranked(g.V(kind="order").outV().limit(40), 40))

# set algebra
_SETS = {"a": ("size < 20", {"size__lt": 20}), "b": ("brand = 'Brand#11' OR brand = 'Brand#12'", {"brand__in": ["Brand#11", "Brand#12"]}), "c": ("retailprice > 1200", {"retailprice__gt": 1200})}
_A, _B, _C = (f"SELECT id FROM prt WHERE {w}" for w, _ in _SETS.values())


def _sets(g):
    return [g.V(**f) for _, f in _SETS.values()]


query(f"{_A} UNION {_B}", P, name="union")(lambda g: ids(_sets(g)[0] | _sets(g)[1]))
query(f"{_A} INTERSECT {_B}", P, name="intersection")(lambda g: ids(_sets(g)[0] & _sets(g)[1]))
query(f"{_A} EXCEPT {_B}", P, name="difference")(lambda g: ids(_sets(g)[0] - _sets(g)[1]))
query(f"SELECT id FROM ({_A} UNION ALL {_B}) GROUP BY id HAVING count(*) = 1", P, name="symdiff")(lambda g: ids(_sets(g)[0] ^ _sets(g)[1]))
query(f"SELECT id FROM ({_A} UNION ALL {_B} UNION ALL {_C}) GROUP BY id HAVING count(*) % 2 = 1", P, name="symdiff3")(lambda g: ids(g.symmetric_difference(*_sets(g))))
query("SELECT true AS narrow, NOT EXISTS (SELECT 1 FROM prt WHERE size < 20 AND size >= 10) AS wide", P, name="issubset")(lambda g: one(g, narrow=g.V(size__lt=10) <= g.V(size__lt=20), wide=g.V(size__lt=20) <= g.V(size__lt=10)))
query("SELECT true AS wide, NOT EXISTS (SELECT 1 FROM prt WHERE size < 20 AND size >= 10) AS narrow", P, name="issuperset")(lambda g: one(g, wide=g.V(size__lt=20) >= g.V(size__lt=10), narrow=g.V(size__lt=10) >= g.V(size__lt=20)))


# mutation
@query("WITH gone AS (SELECT id FROM cust WHERE mktsegment = 'BUILDING') SELECT 'node' AS part, id FROM cust WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', id FROM cust_nation WHERE src NOT IN (SELECT id FROM gone)", "customer", "cust_nation")
def remove_nodes(g):
    g.V(mktsegment="BUILDING").remove()
    return ids(g.V()).select(F.lit("node").alias("part"), "id").union(ids(g.E()).select(F.lit("edge"), "id"))


@query("SELECT id FROM ring WHERE weight <> 3")
def remove_edges(g):
    g.E(weight=3).remove()
    return ids(g.E())


@query("SELECT id, name, CASE WHEN size > 25 THEN 'large' END AS class, CASE WHEN size > 25 THEN 0 ELSE size END AS size FROM prt", "part")
def update_merge(g):
    g.V(size__gt=25).update(**{"class": "large", "size": 0})
    return fields(g.V(), "name", "class", "size").withColumn("size", F.col("size").cast("int"))


@query(f"SELECT id, name FROM nation_n UNION ALL VALUES ({2 * STEP + 25}, 'Atlantis'), ({2 * STEP + 26}, NULL)")
def bulk_add_nodes(g):
    g.bulk_add_node([{"name": "Atlantis", "depth": 9}, {"depth": 3}])
    return fields(g.V(), "name")


@query(f"SELECT id, name FROM nation_n UNION ALL SELECT {2 * STEP + 25} + i, 'new ' || i FROM range(300) r(i)")
def add_nodes(g):
    """One by one: they wait in a buffer until the next read."""
    for i in range(300):
        g.add_node(name=f"new {i}")
    return fields(g.V(), "name")


@query(f"SELECT src, dst FROM ring UNION ALL SELECT {2 * STEP} + i % 25, {2 * STEP} + (i * 3) % 25 FROM range(100) r(i)")
def add_edges(g):
    for i in range(100):
        g.add_edge(g.v(2 * STEP + i % 25), g.v(2 * STEP + (i * 3) % 25), no=i)
    return g.edges.select("src", "dst")


@query(f"SELECT 'node' AS part, id, CASE WHEN id = {2 * STEP + 3} THEN 'Third' ELSE name END AS name FROM nation_n WHERE id <> {2 * STEP + 1} UNION ALL SELECT 'node', {2 * STEP + 25}, 'Atlantis' UNION ALL SELECT 'edge', dst, NULL FROM ring WHERE {2 * STEP + 1} NOT IN (src, dst) UNION ALL SELECT 'edge', {2 * STEP + 25}, NULL")
def change_set(g):
    with g.batch() as b:
        made = b.add_node(name="Atlantis")
        b.add_edge(g.v(2 * STEP), made)
        b.add_edge(g.v(2 * STEP + 1), made)
        b.update(g.v(2 * STEP + 3), name="Third")
        b.remove(g.v(2 * STEP + 1))
    edges = g.edges.select(F.lit("edge").alias("part"), F.col("dst").alias("id"), F.lit(None).cast("string").alias("name"))
    return fields(g.V(), "name").select(F.lit("node").alias("part"), "id", "name").union(edges)


@query(f"SELECT id, src, dst FROM ring UNION ALL VALUES ({8 * STEP + 50}, {2 * STEP}, {2 * STEP + 2}), ({8 * STEP + 51}, {2 * STEP}, {2 * STEP})")
def bulk_add_edges(g):
    g.bulk_add_edge([(g.v(2 * STEP), g.v(2 * STEP + 2), {"note": "new"}), (g.v(2 * STEP), g.v(2 * STEP), {})])
    return g.edges.select("id", "src", "dst")


@query("SELECT a.src, b.dst FROM ring a JOIN ring b ON a.dst = b.src")
def script_add_edge(g):
    g.V(kind="nation").aka("x").outV(2).aka("y").call("add_edge", "x", "y", made=1)
    return g.E(made=1)._s.matching("e", {"made": 1}).select("src", "dst")


@query("SELECT id FROM prt WHERE brand = 'Brand#11' AND size > 5", "part")
def index_transparency(g):
    g.add_node_index("brand", "size")
    path = fresh_path(g.spark, "store")
    g.save(path)
    return ids(PropertyGraph.load(g.spark, path).V(brand="Brand#11", size__gt=5))


# files
@query("SELECT name, kind, outgoing FROM (SELECT nation_n.name, 'nation' AS kind, count(*) AS outgoing FROM nation_n JOIN ring ON ring.src = nation_n.id GROUP BY nation_n.name)")
def json_roundtrip(g):
    path = fresh_path(g.spark, "dump")
    g.write(path)
    copy = PropertyGraph.empty(g.spark)
    copy.read(path)
    out = copy.edges.groupBy("src").agg(F.count(F.lit(1)).alias("outgoing"))
    return copy.nodes.join(out, copy.nodes["id"] == out["src"]).select("name", "kind", "outgoing")


@query("SELECT c.name, c.acctbal, c.mktsegment, n.name AS nation FROM cust c JOIN cust_nation e ON e.src = c.id JOIN nation_n n ON n.id = e.dst", "customer nation", "cust_nation")
def json_customers(g):
    path = fresh_path(g.spark, "dump")
    g.write(path)
    copy = PropertyGraph.empty(g.spark)
    copy.read(path)
    nations = copy.nodes.filter("kind = 'nation'").select(F.col("id").alias("dst"), F.col("name").alias("nation"))
    return copy.nodes.join(copy.edges.select("src", "dst"), F.expr("id = src")).join(nations, "dst").select("name", "acctbal", "mktsegment", "nation")


@query("WITH n AS (SELECT id, name FROM nation_n ORDER BY id LIMIT 10) SELECT ring.src, ring.dst, a.name AS label FROM ring JOIN n a ON a.id = ring.src JOIN n b ON b.id = ring.dst")
def dot_lines(g):
    nodes, edges = g.V().dot(node_label="name", limit=10).frames()
    return edges.drop("label").join(nodes.withColumnRenamed("id", "src"), "src").select("src", "dst", "label")


_DOT = ("SELECT 'digraph G {' AS line", "SELECT '}'", r"""SELECT '  ' || id || ' [label="' || regexp_replace(name, '[^0-9a-zA-Z_\s]', '', 'g') || '"];' FROM nation_n """, """SELECT '  ' || src || ' -> ' || dst || ' [label="' || weight || '"];' FROM ring """)


@query(" UNION ALL ".join(_DOT))
def dot_text(g):
    text = g.V().dot(node_label="name", edge_label="weight").to_dot()
    return g.spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


query("SELECT src, dst, max(id) AS id FROM contains GROUP BY src, dst", "order", "contains", name="nx_edges")(lambda g: simple_edges(g).select("src", "dst", "id"))


@query("SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target FROM ring")
def edge_list_load(g):
    path = fresh_path(g.spark, "edges")
    lines = g.edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
    lines.union(g.spark.createDataFrame([("# source target",)], "value string")).write.text(path)
    loaded = edge_list(g.spark, path)
    name = lambda c: loaded.nodes.select(F.col("id").alias(c), F.col("gid"))
    return loaded.edges.join(name("src"), "src").withColumnRenamed("gid", "source").join(name("dst"), "dst").select("source", F.col("gid").alias("target"))


# paths: every simple extension up to 24 hops can't be listed, so the SQL keeps the least cost per node and round
N0 = 2 * STEP


def _rounds(weight: str, cut: str = "") -> str:
    return f"""WITH e AS (SELECT src, dst, {weight} AS w FROM ring),
    r(k, id, dist) AS (SELECT 0, {N0}::BIGINT, 0::BIGINT UNION ALL
      SELECT k + 1, id, min(dist) FROM (SELECT r.k, e.dst AS id, r.dist + e.w AS dist FROM r JOIN e ON e.src = r.id WHERE r.k < 24 {cut}) GROUP BY k, id)
    SELECT id, CAST(min(dist) AS BIGINT) AS dist FROM r GROUP BY id"""


query(_rounds("weight"), recursive=True, name="dijkstra_dist")(lambda g: paths.distances(g, N0, weight="weight").select("id", F.col("dist").cast("long").alias("dist")))
query(_rounds("1"), recursive=True, name="dijkstra_unit")(lambda g: paths.distances(g, N0).select("id", F.col("dist").cast("long").alias("dist")))
query(_rounds("weight", "AND r.dist + e.w <= 9"), recursive=True, name="dijkstra_cutoff")(lambda g: paths.distances(g, N0, cutoff=9, weight="weight").select("id", F.col("dist").cast("long").alias("dist")))




def _closed(g: PropertyGraph, path: list, cost: int) -> bool:
    """Whether the least edges along a path add up to its cost."""
    steps = [(a.get_id(), b.get_id()) for a, b in zip(path, path[1:], strict=False)]
    on = g.spark.createDataFrame(steps, "src long, dst long")
    return on.join(g.edges.groupBy("src", "dst").agg(F.min("weight").alias("w")), ["src", "dst"]).agg(F.sum("w")).first()[0] == cost


def _ahead(target: int) -> Column:
    """No edge of the ring spans more than seven nodes or costs less than 1."""
    return F.ceil(F.pmod(F.lit(target) - F.col("id"), F.lit(25)) / 7)


_recursive = lambda weight: _rounds(weight).replace("WITH e", "WITH RECURSIVE e", 1)


@query(f"WITH a AS ({_recursive('weight')}) SELECT dist AS cost, true AS closed FROM a WHERE id = {N0 + 20}")
def dijkstra_path(g):
    cost, path = paths.dijkstra_path(g, g.v(N0), g.v(N0 + 20), weight="weight")
    return one(g, cost=int(cost), closed=_closed(g, path, int(cost)))


query(f"WITH a AS ({_recursive('weight')}) SELECT dist AS cost FROM a WHERE id = {N0 + 13}", name="astar_length")(lambda g: one(g, cost=int(paths.astar_path_length(g, g.v(N0), g.v(N0 + 13), _ahead(N0 + 13), "weight"))))


@query(f"WITH a AS ({_recursive('weight')}) SELECT dist AS cost, true AS closed, {N0} AS first, {N0 + 19} AS last FROM a WHERE id = {N0 + 19}")
def astar_path(g):
    path = paths.astar_path(g, g.v(N0), g.v(N0 + 19), _ahead(N0 + 19), "weight")
    cost = int(paths.astar_path_length(g, g.v(N0), g.v(N0 + 19), lambda data, goal: 0, "weight"))
    return one(g, cost=cost, closed=_closed(g, path, cost), first=path[0].get_id(), last=path[-1].get_id())


# over the large relations: the orders and parts within reach of the customer of the first order
_ROOT = "(SELECT src FROM placed ORDER BY id LIMIT 1)"
_FAR = f"a AS (SELECT dst AS id, 1.0::DOUBLE AS dist FROM placed WHERE src = {_ROOT}), b AS (SELECT c.dst AS id, min(a.dist + {{}}) AS dist FROM a JOIN contains c ON c.src = a.id GROUP BY c.dst)"


def _reached(weight: str) -> str:
    return f"WITH {_FAR.format(weight)} SELECT {_ROOT} AS id, 0.0::DOUBLE AS dist UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b"


def _from_first(g: PropertyGraph, weight: str | None) -> DataFrame:
    root = g.edges.filter("rel = 'placed'").orderBy("id").first()["src"]
    rated = PropertyGraph(g.nodes, g.edges.withColumn("quantity", F.coalesce("quantity", F.lit(1.0))))
    return paths.distances(rated, root, weight=weight).select("id", F.col("dist").cast("double").alias("dist"))


query(_reached("1"), "customer order part", PC, name="dijkstra_orders")(lambda g: _from_first(g, None))
query(_reached("c.quantity"), "customer order part", PC, name="dijkstra_quantities")(lambda g: _from_first(g, "quantity"))

# tutorials
_REC = "WITH s AS (SELECT c.dst AS id, CAST(count(*) AS BIGINT) AS value FROM cust JOIN placed p ON p.src = cust.id JOIN contains c ON c.src = p.dst WHERE mktsegment = 'BUILDING' GROUP BY c.dst) SELECT id, value FROM s WHERE value >= (SELECT min(value) FROM (SELECT value FROM s ORDER BY value DESC LIMIT 10))"


@query(_REC, "customer order part", PC)
def recommend_parts(g):
    """The parts that customers of a segment order most, ties with the tenth included."""
    agg = g.V(kind="customer", mktsegment="BUILDING").out_(2).sum()
    least = agg.limit(10).frame().agg(F.min("value")).scalar()
    return agg.frame().withColumn("least", least).filter("value >= least").select("id", F.col("value").cast("long").alias("value"))


query("SELECT p.src AS id, r.dst AS grandparent FROM cust_nation p JOIN in_region r ON r.src = p.dst", "customer nation region", "cust_nation in_region", name="grandparent")(lambda g: g.V(kind="customer").aka("c").outV(2).frame().select(F.col("_a_c").alias("id"), F.col("_id").alias("grandparent")))
query("SELECT a.src AS id, b.src AS sibling FROM in_region a JOIN in_region b ON a.dst = b.dst WHERE a.src <> b.src", "nation region", "in_region", name="siblings")(lambda g: g.V(kind="nation").aka("n").outV().inV().without("n").frame().select(F.col("_a_n").alias("id"), F.col("_id").alias("sibling")))


@query("SELECT a.src AS id, c.src AS nation, d.cousins FROM cust_nation a JOIN in_region b ON b.src = a.dst JOIN in_region c ON c.dst = b.dst JOIN (SELECT dst, count(*) AS cousins FROM cust_nation GROUP BY dst) d ON d.dst = c.src WHERE c.src <> a.dst", "customer nation region", "cust_nation in_region")
def cousins(g):
    """All customers with the number of their cousins in each nation; the pairs themselves grow with the square of the table."""
    near = g.V(kind="customer").aka("c").outV().aka("n").outV().inV().without("n").frame().select(F.col("_a_c").alias("id"), F.col("_id").alias("nation"))
    living = counted(g.V(kind="customer").outV()).select(F.col("id").alias("nation"), F.col("paths").alias("cousins"))
    return near.join(living, "nation").select("id", "nation", "cousins")


# command lists and scripts
query("SELECT c.dst AS id, count(*) AS paths FROM placed p JOIN cust ON p.src = cust.id JOIN contains c ON c.src = p.dst WHERE mktsegment = 'BUILDING' AND c.quantity > 45 GROUP BY c.dst", "customer order part", PC, name="commands_replay")(lambda g: counted(replay(g, [["V", [], {"mktsegment": "BUILDING"}], ["outV", [], {}], ["out_", [], {"quantity__gt": 45}]])))
query("SELECT 'x' AS arg, 1::BIGINT AS k FROM ring a JOIN ring b ON a.dst = b.src", name="requests_echo")(lambda g: g.spark.createDataFrame([(r["args"][0], r["kwargs"]["k"]) for r in g.V().aka("x").outV(2).request("echo", "x", k=1)], "arg string, k long"))
