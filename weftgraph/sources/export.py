"""Graphviz text and networkx graphs."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validate import column_of
from ..functions.variant import data_of

if TYPE_CHECKING:
    from ..graph import PropertyGraph
    from ..operators.traversal import Traversal

_KEEP = r"[^0-9a-zA-Z_\s]"


class Dot:
    """A bag of nodes: its first distinct nodes and the edges with both ends among them. A bag of edges: its first
    distinct edges and their ends."""

    def __init__(self, t: Traversal, node_label: str | None, edge_label: str | None, limit: int):
        assert limit > 0, "the limit must be positive"
        self._t, self._node, self._edge, self._limit = t, node_label, edge_label, limit

    def frames(self) -> tuple[DataFrame, DataFrame]:
        """(id, label) of nodes, (id, src, dst, label) of edges."""
        s = self._t._s
        first = self._t.counts().orderBy("_ord").limit(self._limit).select(F.col("_id").alias("_k"))
        if self._t.kind == "v":
            nodes = s.nodes.join(first, F.col("id") == F.col("_k"), "left_semi")
            edges = s.edges.join(first, F.col("src") == F.col("_k"), "left_semi").join(first, F.col("dst") == F.col("_k"), "left_semi")
        else:
            edges = s.edges.join(first, F.col("id") == F.col("_k"), "left_semi")
            ends = edges.select(F.explode(F.array("src", "dst")).alias("_k"))
            nodes = s.nodes.join(ends, F.col("id") == F.col("_k"), "left_semi")

        def label(df: DataFrame, field: str | None, default):
            column = column_of(field) if field else None
            own = F.regexp_replace(F.col(column).cast("string"), _KEEP, "") if column in df.columns else F.lit(None).cast("string")
            return F.coalesce(own, default).alias("label")

        return nodes.select("id", label(nodes, self._node, F.col("id").cast("string"))), edges.select("id", "src", "dst", label(edges, self._edge, F.lit("")))

    def to_dot(self) -> str:
        nodes, edges = self.frames()
        lines = ["digraph G {"]
        lines += [f'  {r["id"]} [label="{r["label"]}"];' for r in nodes.orderBy("id").collect()]
        lines += [f'  {r["src"]} -> {r["dst"]} [label="{r["label"]}"];' for r in edges.orderBy("id").collect()]
        return "\n".join([*lines, "}"])

    __str__ = to_dot


def simple_edges(g: PropertyGraph) -> DataFrame:
    """Parallel edges collapse; the one of the largest id stays."""
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    return g.edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "id").alias("e")).select("src", "dst", "e.*")


def to_networkx(g: PropertyGraph):
    """A DiGraph, where networkx is installed."""
    try:
        import networkx
    except ImportError as e:
        raise RuntimeError("networkx isn't installed") from e
    out = networkx.DiGraph()
    out.add_nodes_from((r["id"], data_of(r, {"id"})) for r in g.nodes.toLocalIterator())
    out.add_edges_from((r["src"], r["dst"], data_of(r, {"id", "src", "dst"})) for r in simple_edges(g).toLocalIterator())
    return out


