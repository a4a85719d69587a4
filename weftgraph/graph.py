"""Property graphs: directed multigraphs held as a node and an edge DataFrame.

``nodes`` has ``id`` and property columns, ``edges`` has ``id``, ``src``, ``dst`` and property columns; an absent
property is null. The handle points at an immutable snapshot; a mutation makes a new snapshot, and
traversals keep the one that they began with.

Nodes and edges that are added one by one wait in a buffer; the next read puts all of them into the snapshot at
once, and every ``COMPACT`` such deltas the frames are checkpointed, so plans don't grow with the number of calls.
``batch`` gathers changes of any kind and applies them together or not at all.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors
from .functions import lookups, variant
from .functions.validate import check_data, check_name, check_value, column_of, solid, type_of, widen
from .operators.changes import ChangeSet
from .operators.entity import Edge, Entity, Node
from .operators.traversal import Traversal
from .storage import durable, numbered

COMPACT, BUFFER, KNOWN = 16, 100_000, 1_000_000
RESERVED = {"v": frozenset(("id",)), "e": frozenset(("id", "src", "dst"))}
_NODES = T.StructType([T.StructField("id", T.LongType())])
_EDGES = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "src", "dst")])


@dataclass(frozen=True)
class Index:
    """A stored index: the ids of the entities that ``where`` holds for, with the indexed fields, sorted by them."""

    fields: tuple[str, ...]
    where: Mapping[str, object]
    rows: DataFrame

    def left(self, filters: Mapping) -> dict | None:
        """The filters that the index's rows must still pass; None if it can't answer them alone: then a field isn't
        asked for by value, or a filter names something that the index doesn't hold."""
        parsed = {key: lookups.parse(key) for key in filters}
        by_value = {f for k, (f, how) in parsed.items() if how == "exact" or (how == "in" and isinstance(filters[k], (list, tuple, set, frozenset)))}
        fixed = {k for k, (f, how) in parsed.items() if k in self.where and type(self.where[k]) is type(filters[k]) and self.where[k] == filters[k]}
        rest = {k: v for k, v in filters.items() if k not in fixed}
        whole = fixed == set(self.where) and {parsed[k][0] for k in rest} == set(self.fields) and {parsed[k][0] for k in rest} <= by_value
        return rest if whole and all(column_of(f) in self.rows.columns for f in self.fields) else None

    def ids(self, filters: Mapping) -> DataFrame:
        rest = self.left(filters)
        if rest is None:
            raise errors.IncompetentIndex(f"an index on {', '.join(self.fields)} can't answer {', '.join(filters)}")
        cond = lookups.condition(self.rows.schema, rest)
        return (self.rows if cond is None else self.rows.filter(cond)).select("id")


class Snapshot:
    """The frames that a traversal reads. Stored indexes belong to the snapshot that was loaded with them."""

    def __init__(self, graph: PropertyGraph, nodes: DataFrame, edges: DataFrame, indexes: Mapping[str, Sequence[Index]] | None = None):
        self.graph, self.nodes, self.edges, self.indexes = graph, nodes, edges, indexes or {}

    def of(self, kind: str) -> DataFrame:
        return self.nodes if kind == "v" else self.edges

    @staticmethod
    def reserved(kind: str) -> frozenset[str]:
        return RESERVED[kind]

    def check(self, kind: str, filters: Mapping) -> None:
        """Errors in lookups surface when the plan is built."""
        lookups.condition(self.of(kind).schema, filters, RESERVED[kind])

    def matching(self, kind: str, filters: Mapping) -> DataFrame:
        df, cond = self.of(kind), lookups.condition(self.of(kind).schema, filters, RESERVED[kind])
        return df if cond is None else df.filter(cond)

    def scan(self, kind: str, filters: Mapping) -> Traversal:
        self.check(kind, filters)
        able = [x for x in self.indexes.get(kind, ()) if filters and x.left(filters) is not None]
        df = max(able, key=lambda x: len(x.where)).ids(filters) if able else self.matching(kind, filters)
        return Traversal(self, df.select(F.col("id").alias("_id"), F.array("id").alias("_ord")), kind)

    def entity(self, kind: str, i: int) -> Entity:
        return (Node if kind == "v" else Edge)(self.graph, i)


class PropertyGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, node_indexes: Iterable = (), edge_indexes: Iterable = (), stored: Mapping[str, Sequence[Index]] | None = None):
        self.spark: SparkSession = nodes.sparkSession
        self._current = Snapshot(self, nodes, edges, stored)
        self._added: dict[str, list[tuple[dict, dict]]] = {"v": [], "e": []}
        self._deltas = {"v": 0, "e": 0}
        self._known: set[int] = set()  # ids of nodes that are there for sure
        self._indexes = {"v": [(tuple(f), dict(w)) for f, w in node_indexes], "e": [(tuple(f), dict(w)) for f, w in edge_indexes]}
        self._next: dict[str, int | None] = {"v": None, "e": None}  # None: after the largest id of the frame
        self._floor = {"v": 0, "e": 0}
        self._scripts: dict[str, Callable] = {}
        self._open = True

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], _NODES), spark.createDataFrame([], _EDGES))

    @property
    def _now(self) -> Snapshot:
        """The snapshot, with all that was added before."""
        if self._added["v"] or self._added["e"]:
            self._flush()
        return self._current

    @property
    def nodes(self) -> DataFrame:
        return self._now.nodes

    @property
    def edges(self) -> DataFrame:
        return self._now.edges

    def _check_open(self) -> None:
        if not self._open:
            raise errors.DataError("the graph is closed")

    def _snapshot(self) -> Snapshot:
        self._check_open()
        return self._now

    def close(self) -> None:
        self._open = False

    # ------------------------------------------------------------------ reads

    def V(self, **filters: object) -> Traversal:  # noqa: N802
        return self._snapshot().scan("v", filters)

    def E(self, **filters: object) -> Traversal:  # noqa: N802
        return self._snapshot().scan("e", filters)

    def v(self, i: int) -> Node:
        """A handle; whether the node exists isn't checked."""
        self._check_open()
        return Node(self, i)

    def e(self, i: int) -> Edge:
        self._check_open()
        return Edge(self, i)

    # ------------------------------------------------------------------ set algebra over distinct ids

    @staticmethod
    def _kind(its: Sequence[Traversal]) -> str:
        if not its or len({t.kind for t in its}) != 1:
            raise errors.MixedKind("operands of one kind are needed")
        return its[0].kind

    @staticmethod
    def _distinct(t: Traversal) -> DataFrame:
        return t.counts().select("_id", "_ord")

    def _made(self, its: Sequence[Traversal], df: DataFrame) -> Traversal:
        return Traversal(self._snapshot(), df, its[0].kind)

    def union(self, *its: Traversal) -> Traversal:
        self._kind(its)
        each = [self._distinct(t).select("_id", F.concat(F.array(F.lit(i).cast("long")), "_ord").alias("_ord")) for i, t in enumerate(its)]
        return self._made(its, reduce(DataFrame.unionByName, each).groupBy("_id").agg(F.min("_ord").alias("_ord")))

    def intersection(self, *its: Traversal) -> Traversal:
        self._kind(its)
        fold = lambda a, t: a.join(t.counts().select(F.col("_id").alias("_k")), F.col("_id") == F.col("_k"), "left_semi")
        return self._made(its, reduce(fold, its[1:], self._distinct(its[0])))

    def difference(self, *its: Traversal) -> Traversal:
        self._kind(its)
        fold = lambda a, t: a.join(t.counts().select(F.col("_id").alias("_k")), F.col("_id") == F.col("_k"), "left_anti")
        return self._made(its, reduce(fold, its[1:], self._distinct(its[0])))

    def symmetric_difference(self, *its: Traversal) -> Traversal:
        """Ids in an odd number of operands."""
        self._kind(its)
        each = [self._distinct(t).select("_id", F.concat(F.array(F.lit(i).cast("long")), "_ord").alias("_ord")) for i, t in enumerate(its)]
        df = reduce(DataFrame.unionByName, each).groupBy("_id").agg(F.min("_ord").alias("_ord"), F.count(F.lit(1)).alias("c"))
        return self._made(its, df.filter("c % 2 = 1").drop("c"))

    def issubset(self, a: Traversal, b: Traversal) -> bool:
        self._kind((a, b))
        return self.difference(a, b).frame().isEmpty()

    def issuperset(self, a: Traversal, b: Traversal) -> bool:
        return self.issubset(b, a)

    # ------------------------------------------------------------------ mutation

    def _fresh(self, kind: str, n: int) -> int:
        """The first of n new ids; ids never return, even when their entities go."""
        if self._next[kind] is None:
            top = self._now.of(kind).agg(F.max("id")).first()[0]
            self._next[kind] = max(self._floor[kind], 0 if top is None else top + 1)
        first = self._next[kind]
        self._next[kind] = first + n
        return first

    def _set(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        now, new = self._now, {"v": nodes, "e": edges}
        frames = {k: now.of(k) if new[k] is None else self._compacted(k, new[k]) for k in "ve"}
        self._current = Snapshot(self, frames["v"], frames["e"])

    def _compacted(self, kind: str, df: DataFrame) -> DataFrame:
        """The frame after one more delta: checkpointed each ``COMPACT`` deltas."""
        self._deltas[kind] = (self._deltas[kind] + 1) % COMPACT
        return df if self._deltas[kind] else durable(df)

    def _flush(self) -> None:
        frames = {}
        for kind in "ve":
            added, frames[kind] = self._added[kind], self._current.of(kind)
            if not added:
                continue
            rows = self._rows([k for k, _ in added], [d for _, d in added])
            frames[kind] = self._compacted(kind, self._appended(frames[kind], rows))
        self._current = Snapshot(self, frames["v"], frames["e"])
        self._added = {"v": [], "e": []}

    def _add(self, kind: str, rows: list[tuple[dict, dict]]) -> None:
        self._added[kind] += rows
        if len(self._added[kind]) >= BUFFER:
            self._flush()

    def _state(self) -> tuple:
        return self._current, {k: list(v) for k, v in self._added.items()}, dict(self._deltas)

    def _restore(self, state: tuple) -> None:
        self._current, self._added, self._deltas = state

    def _check_nodes(self, ids: set[int]) -> None:
        """An error unless all ids are nodes; those that are known from before need no look."""
        unknown = ids - self._known
        if not unknown:
            return
        asked = self.spark.createDataFrame([(i,) for i in unknown], "id long")
        if not asked.join(self.nodes.select("id"), "id", "left_anti").isEmpty():
            raise errors.DataError("an edge needs nodes that exist")
        self._learn(unknown)

    def _learn(self, ids: Iterable[int]) -> None:
        if len(self._known) > KNOWN:
            self._known.clear()
        self._known.update(ids)

    @staticmethod
    def _appended(have: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` below the frame, with types that hold both."""
        names = list(dict.fromkeys([*have.columns, *rows.columns]))
        of = lambda df, n: df.schema[n].dataType if n in df.columns else T.NullType()
        kinds = {n: solid(widen(of(have, n), of(rows, n))) for n in names}
        both = [df.select(*(variant.put(F.col(n) if n in df.columns else F.lit(None), of(df, n), kinds[n]).alias(n) for n in names)) for df in (have, rows)]
        return both[0].unionAll(both[1])

    def _rows(self, keys: list[dict], data: list[dict]) -> DataFrame:
        data = [{column_of(k): v for k, v in d.items()} for d in data]
        names = list(dict.fromkeys(k for d in data for k in d))
        types = {n: solid(type_of([d.get(n) for d in data])) for n in names}
        mixed = [n for n in names if isinstance(types[n], T.VariantType)]
        shape = [T.StructField(n, T.LongType()) for n in keys[0]] + [T.StructField(n, T.StringType() if n in mixed else types[n]) for n in names]
        rows = [tuple(k.values()) + tuple(fit(d.get(n), types[n]) for n in names) for k, d in zip(keys, data, strict=True)]
        return self.spark.createDataFrame(rows, T.StructType(shape)).withColumns({n: F.parse_json(n) for n in mixed})

    def add_node(self, **data: object) -> Node:
        return self.bulk_add_node([data])[0]

    def bulk_add_node(self, data: Sequence[Mapping], silent: bool = False) -> list[Node] | None:
        """Contiguous ids in input order."""
        self._check_open()
        for d in data:
            check_data(d)
        if not data:
            return None if silent else []
        first = self._fresh("v", len(data))
        self._add("v", [({"id": first + i}, dict(d)) for i, d in enumerate(data)])
        self._learn(range(first, first + len(data)))
        return None if silent else [Node(self, first + i) for i in range(len(data))]

    def add_edge(self, source: Node, target: Node, **data: object) -> Edge:
        return self.bulk_add_edge([(source, target, data)])[0]

    def bulk_add_edge(self, edges: Sequence[tuple[Node, Node, Mapping]], silent: bool = False) -> list[Edge] | None:
        rows = []
        for item in edges:
            if not isinstance(item, (tuple, list)) or len(item) != 3:
                raise errors.DataError("an edge is (source, target, data)")
            s, t, d = item
            if not isinstance(s, Node) or not isinstance(t, Node):
                raise errors.InvalidDataType("an edge joins nodes")
            if not isinstance(d, Mapping):
                raise errors.DataError("edge data must be a dict")
            rows.append((s.get_id(), t.get_id(), d))
        return self.bulk_add_edge_by_ids(rows, silent)

    def add_edge_by_ids(self, source: int, target: int, **data: object) -> Edge:
        return self.bulk_add_edge_by_ids([(source, target, data)])[0]

    def bulk_add_edge_by_ids(self, edges: Sequence[tuple[int, int, Mapping]], silent: bool = False) -> list[Edge] | None:
        self._check_open()
        for _, _, d in edges:
            check_data(d)
        if not edges:
            return None if silent else []
        self._check_nodes({i for s, t, _ in edges for i in (s, t)})
        first = self._fresh("e", len(edges))
        self._add("e", [({"id": first + i, "src": s, "dst": t}, dict(d)) for i, (s, t, d) in enumerate(edges)])
        return None if silent else [Edge(self, first + i) for i in range(len(edges))]

    def _append(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Rows that have their ids, from the next free one on."""
        self._set(self._appended(self.nodes, nodes), self._appended(self.edges, edges))
        self._grown("v")
        self._grown("e")

    def _grown(self, kind: str) -> None:
        self._floor[kind], self._next[kind] = self._next[kind] or self._floor[kind], None

    def append_nodes(self, rows: DataFrame) -> None:
        """Bulk load: ``rows`` has property columns only; ids follow the order of ``rows``."""
        for n in rows.columns:
            check_name(n)
        rows = rows.toDF(*map(column_of, rows.columns))
        self._set(nodes=self._appended(self.nodes, numbered(rows, "id", self._fresh("v", 0))))
        self._grown("v")

    def append_edges(self, rows: DataFrame) -> None:
        """Bulk load: ``rows`` has src, dst and property columns; every end must exist."""
        for n in rows.columns:
            if n not in ("src", "dst"):
                check_name(n)
        ends = rows.select("src").union(rows.select("dst")).withColumnRenamed("src", "id")
        if not ends.join(self.nodes.select("id"), "id", "left_anti").isEmpty():
            raise errors.DataError("an edge needs nodes that exist")
        rows = rows.toDF(*(n if n in ("src", "dst") else column_of(n) for n in rows.columns))
        self._set(edges=self._appended(self.edges, numbered(rows, "id", self._fresh("e", 0))))
        self._grown("e")

    def _update(self, kind: str, ids: DataFrame, data: Mapping) -> None:
        check_data(data)
        data = {column_of(k): v for k, v in data.items()}
        have = self._snapshot().of(kind)
        marked = have.join(ids.select(F.col("id").alias("_k")).distinct(), F.col("id") == F.col("_k"), "left")
        out = []
        for n in dict.fromkeys([*have.columns, *data]):
            old = F.col(n) if n in have.columns else F.lit(None)
            if n in data:
                t = solid(widen(have.schema[n].dataType if n in have.columns else T.NullType(), type_of([data[n]])))
                was = have.schema[n].dataType if n in have.columns else T.NullType()
                old = F.when(F.col("_k").isNotNull(), literal(data[n], t)).otherwise(variant.put(old, was, t))
            out.append(old.alias(n))
        new = marked.select(*out)
        self._set(**{"nodes" if kind == "v" else "edges": new})

    def _update_each(self, kind: str, updates: Mapping[int, Mapping]) -> None:
        """Fields of many entities at once, by one join."""
        have = self._snapshot().of(kind)
        ids, data = list(updates), [{column_of(k): v for k, v in d.items()} for d in updates.values()]
        named = self.spark.createDataFrame([(i, list(d)) for i, d in zip(ids, data, strict=True)], "id long, _set array<string>")
        rows = self._rows([{"id": i} for i in ids], list(updates.values()))
        new = rows.select(F.col("id").alias("_k"), *(F.col(c).alias(f"_n_{c}") for c in rows.columns if c != "id"))
        marked = have.join(named.select(F.col("id").alias("_j"), "_set"), F.col("id") == F.col("_j"), "left").join(new, F.col("id") == F.col("_k"), "left")
        out = []
        for n in dict.fromkeys([*have.columns, *rows.columns]):
            was = have.schema[n].dataType if n in have.columns else T.NullType()
            old = F.col(n) if n in have.columns else F.lit(None)
            if n != "id" and n in rows.columns:
                t = solid(widen(was, rows.schema[n].dataType))
                change = F.coalesce(F.array_contains("_set", n), F.lit(False))
                old = F.when(change, variant.put(F.col(f"_n_{n}"), rows.schema[n].dataType, t)).otherwise(variant.put(old, was, t))
            out.append(old.alias(n))
        self._set(**{"nodes" if kind == "v" else "edges": marked.select(*out)})

    def batch(self) -> ChangeSet:
        """Changes that are applied together when the ``with`` block ends well, or not at all."""
        self._check_open()
        return ChangeSet(self)

    def update_data(self, kind: str, i: int, field: str, value: object) -> None:
        check_value(value)
        check_data({field: value})
        self._update_each(kind, {i: {field: value}})

    def _remove(self, kind: str, ids: DataFrame) -> None:
        """Nodes take their incident edges with them, self-loops too."""
        self._snapshot()
        self._fresh(kind, 0)
        if kind == "v":
            self._known.clear()
        gone = ids.select(F.col("id").alias("_k")).distinct()
        if kind == "e":
            self._set(edges=self.edges.join(gone, F.col("id") == F.col("_k"), "left_anti"))
            return
        edges = self.edges.join(gone, F.col("src") == F.col("_k"), "left_anti").join(gone, F.col("dst") == F.col("_k"), "left_anti")
        self._fresh("e", 0)
        self._set(self.nodes.join(gone, F.col("id") == F.col("_k"), "left_anti"), edges)

    # ------------------------------------------------------------------ index catalog

    def _add_index(self, kind: str, fields: tuple, filters: dict) -> None:
        if not fields:
            raise errors.IndexCreationFailed("an index needs fields")
        for f in fields:
            check_name(f)
        self._snapshot().check(kind, filters)
        if (fields, filters) in self._indexes[kind]:
            raise errors.IndexAlreadyExists(fields)
        self._indexes[kind].append((fields, filters))

    def _drop_index(self, kind: str, fields: tuple, filters: dict) -> None:
        if (fields, filters) not in self._indexes[kind]:
            raise errors.IndexRemovalFailed(fields)
        self._indexes[kind].remove((fields, filters))

    def add_node_index(self, *fields: str, **filters: object) -> None:
        """Catalog entry; ``save`` writes a sorted table for it, which a loaded graph reads where it answers a scan alone."""
        self._add_index("v", fields, filters)

    def add_edge_index(self, *fields: str, **filters: object) -> None:
        self._add_index("e", fields, filters)

    def remove_node_index(self, *fields: str, **filters: object) -> None:
        self._drop_index("v", fields, filters)

    def remove_edge_index(self, *fields: str, **filters: object) -> None:
        self._drop_index("e", fields, filters)

    def get_node_indexes(self) -> list[list]:
        return [[list(f), dict(w)] for f, w in self._indexes["v"]]

    def get_edge_indexes(self) -> list[list]:
        return [[list(f), dict(w)] for f, w in self._indexes["e"]]

    # ------------------------------------------------------------------ files, scripts

    def write(self, path: str) -> None:
        from .sources.files import dump_json

        dump_json(self, path)

    def read(self, path: str, id_map: dict | None = None) -> dict:
        from .sources.files import load_json

        return load_json(self, path, id_map)

    def save(self, store) -> None:
        """A new version in a store, or in the Parquet store at a path."""
        from .sources.files import save

        save(self, store)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        from .sources.files import load

        return load(spark, path)

    def nx_graph(self):
        from .sources.export import to_networkx

        return to_networkx(self)

    def setup_server_scripts(self, *modules: str) -> None:
        """Register the public functions of modules; built-in scripts come last."""
        for m in modules:
            found = importlib.import_module(m)
            for name, f in vars(found).items():
                if callable(f) and not name.startswith("_") and getattr(f, "__module__", None) == found.__name__:
                    self._scripts.setdefault(name, f)

    def script(self, name: str) -> Callable:
        from .plans import scripts

        found = self._scripts.get(name) or scripts.BUILT_IN.get(name)
        if found is None:
            raise errors.UnknownScript(name)
        return found


def literal(v: object, t: T.DataType):
    """A Column of a checked value in the given type."""
    if v is None:
        return F.lit(None).cast(t)
    if isinstance(t, T.VariantType):
        return variant.constant(v)
    if isinstance(t, T.ArrayType):
        return F.array(*(literal(x, t.elementType) for x in v)).cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*(literal(v.get(f.name), f.dataType).alias(f.name) for f in t.fields))
    return F.lit(v).cast(t)


def fit(v: object, t: T.DataType) -> object:
    """A checked value as ``createDataFrame`` takes it for the type."""
    if v is None:
        return None
    if isinstance(t, T.VariantType):
        return variant.text_of(v)
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.LongType):
        return int(v)
    if isinstance(t, T.ArrayType):
        return [fit(x, t.elementType) for x in v]
    return {f.name: fit(v.get(f.name), f.dataType) for f in t.fields} if isinstance(t, T.StructType) else v
