"""The star-schema tables as one property graph.

Node ids are ``type * STEP + key``, edge ids likewise, so that ids need no shuffle; only line items, whose
key isn't unique, are numbered by a ranking of whole rows. Keys of orders have room up to ``STEP / LINES`` and all ids
are below 2^53, so that they survive as JSON numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

STEP, LINES = 10**15, 1024
NODE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "user": 7, "event_type": 8}
EDGE = {"in_region": 1, "cust_nation": 2, "supp_nation": 3, "placed": 4, "contains": 5, "supplied": 6, "did": 7, "ring": 8}


def _id(kind: str, key: str | Column, table: dict = NODE) -> Column:
    return (F.lit(table[kind] * STEP) + (F.col(key) if isinstance(key, str) else key).cast("long")).cast("long")


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Star:
    """Lazy access to the tables; ``graph`` with only the kinds that a query needs reads only their tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self, kind: str) -> DataFrame:
        k = F.lit(kind).alias("kind")
        if kind == "region":
            return self.table("region").select(_id(kind, "r_regionkey").alias("id"), k, F.col("r_name").alias("name"))
        if kind == "nation":
            return self.table("nation").select(_id(kind, "n_nationkey").alias("id"), k, F.col("n_name").alias("name"))
        if kind == "customer":
            return self.table("customer").select(_id(kind, "c_custkey").alias("id"), k, F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
        if kind == "supplier":
            return self.table("supplier").select(_id(kind, "s_suppkey").alias("id"), k, F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
        if kind == "part":
            return self.table("part").select(_id(kind, "p_partkey").alias("id"), k, F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"))
        if kind == "order":
            return self.table("orders").select(_id(kind, "o_orderkey").alias("id"), k, F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderpriority").alias("priority"))
        if kind == "user":
            return self.table("events").select("user_id").distinct().select(_id(kind, "user_id").alias("id"), k)
        return self._types().select(_id("event_type", "rank").alias("id"), F.lit("event_type").alias("kind"), F.col("event_type").alias("name"))

    def _types(self) -> DataFrame:
        """Event types by dense rank; the ranking runs over distinct names only."""
        names = self.table("events").select("event_type").distinct()
        return names.withColumn("rank", F.row_number().over(Window.orderBy("event_type")) - 1)

    def edges(self, rel: str) -> DataFrame:
        r = F.lit(rel).alias("rel")
        if rel == "in_region":
            return self.table("nation").select(_id(rel, "n_nationkey", EDGE).alias("id"), _id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst"), r)
        if rel == "cust_nation":
            return self.table("customer").select(_id(rel, "c_custkey", EDGE).alias("id"), _id("customer", "c_custkey").alias("src"), _id("nation", "c_nationkey").alias("dst"), r)
        if rel == "supp_nation":
            return self.table("supplier").select(_id(rel, "s_suppkey", EDGE).alias("id"), _id("supplier", "s_suppkey").alias("src"), _id("nation", "s_nationkey").alias("dst"), r)
        if rel == "placed":
            return self.table("orders").select(_id(rel, "o_orderkey", EDGE).alias("id"), _id("customer", "o_custkey").alias("src"), _id("order", "o_orderkey").alias("dst"), r, F.col("o_totalprice").alias("totalprice"))
        if rel in ("contains", "supplied"):
            return self._lines(rel)
        if rel == "did":
            types = self._types()
            e = self.table("events").join(F.broadcast(types), "event_type")  # one row an event type
            return e.select(_id(rel, "event_id", EDGE).alias("id"), _id("user", "user_id").alias("src"), _id("event_type", "rank").alias("dst"), r, "value")
        n = self.table("nation").select(F.col("n_nationkey").cast("long").alias("k")).select("k", F.posexplode(F.array(F.lit(1), F.lit(7))).alias("p", "d"))
        return n.select(_id("ring", F.col("k") * 2 + F.col("p"), EDGE).alias("id"), _id("nation", "k").alias("src"), _id("nation", (F.col("k") + F.col("d")) % 25).alias("dst"), F.lit("ring").alias("rel"), (1 + F.col("k") % 5).alias("weight"))

    def _lines(self, rel: str) -> DataFrame:
        """Numbered in two steps: by order key in even ranges, then within an order, so no task sees all rows.

        The id is ``order key * LINES + rank within the order``: unique, stable, and free of a global ranking. An order of
        more lines is an error.
        """
        l = self.table("lineitem")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
        key = F.when(rank < LINES, F.col("l_orderkey") * LINES + rank).otherwise(F.raise_error(F.lit(f"an order of more than {LINES} lines")).cast("long"))
        if rel == "contains":
            return l.select(_id(rel, key, EDGE).alias("id"), _id("order", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), F.lit(rel).alias("rel"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"), F.col("l_linenumber").alias("linenumber"))
        return l.select(_id(rel, key, EDGE).alias("id"), _id("supplier", "l_suppkey").alias("src"), _id("part", "l_partkey").alias("dst"), F.lit(rel).alias("rel"), F.col("l_quantity").alias("quantity"))

    def graph(self, nodes: tuple[str, ...] = tuple(NODE), edges: tuple[str, ...] = tuple(EDGE)) -> PropertyGraph:
        return PropertyGraph(_stacked([self.nodes(k) for k in nodes]), _stacked([self.edges(r) for r in edges]))
