"""Graph files: a Parquet store, the JSON dump, and edge lists.

The store replaces the key/value back ends: a folder with ``nodes`` and ``edges`` in Parquet, a narrow sorted table for
each index, and ``catalog`` in JSON. A save stages a new version beside the old ones and then commits it by naming
it in ``CURRENT``, so readers never see half of it; of older versions the last ``keep`` stay.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, DataPreparationFailed, IndexAlreadyExists, MissingKey
from ..functions import lookups
from ..functions.validate import check_name, column_of, field_of
from ..graph import RESERVED, Index, PropertyGraph
from ..storage import delete, durable, fresh_path, joined_text, listed, numbered


class GraphStore(Protocol):
    """What a back end offers. ``PropertyGraph.save`` stages a version and then commits it; until then nobody sees it."""

    def load(self, spark: SparkSession, version: str | None = None) -> PropertyGraph: ...

    def stage(self, graph: PropertyGraph) -> str: ...

    def commit(self, graph: PropertyGraph, version: str) -> None: ...


class ParquetStore:
    def __init__(self, path: str, keep: int | str = 1):
        self.path, self.keep = path.rstrip("/"), int(keep)

    def load(self, spark: SparkSession, version: str | None = None) -> PropertyGraph:
        """The committed version, or a named one."""
        try:
            at = version or spark.read.text(f"{self.path}/CURRENT").first()[0]
        except Exception as e:
            raise DataPreparationFailed(self.path) from e
        try:
            catalog = json.loads(spark.read.text(f"{self.path}/{at}/catalog").first()[0])
        except Exception as e:
            raise (MissingKey(at) if version else DataPreparationFailed(self.path)) from e
        nodes, edges = (spark.read.parquet(f"{self.path}/{at}/{n}") for n in ("nodes", "edges"))
        found = {k: [Index(tuple(fields), dict(where), spark.read.parquet(f"{self.path}/{at}/index-{k}-{i}")) for i, (fields, where) in enumerate(catalog[k])] for k in "ve"}
        return PropertyGraph(nodes, edges, catalog["v"], catalog["e"], found)

    def stage(self, graph: PropertyGraph) -> str:
        at = uuid.uuid4().hex
        for kind, name, df, indexes in (("v", "nodes", graph.nodes, graph.get_node_indexes()), ("e", "edges", graph.edges, graph.get_edge_indexes())):
            sorted_by = _columns(df, indexes[0][0]) if indexes else []
            laid = df.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by) if sorted_by else df
            laid.write.parquet(f"{self.path}/{at}/{name}")
            for i, (fields, where) in enumerate(indexes):
                _index_rows(df, kind, fields, where).write.parquet(f"{self.path}/{at}/index-{kind}-{i}")
        catalog = json.dumps({"v": graph.get_node_indexes(), "e": graph.get_edge_indexes()})
        graph.spark.createDataFrame([(catalog,)], "value string").coalesce(1).write.text(f"{self.path}/{at}/catalog")
        return at

    def commit(self, graph: PropertyGraph, version: str) -> None:
        """Name the version in ``CURRENT``, then drop what is older than the last ``keep`` before it; frames that
        were read from the version before this one stay readable."""
        spark = graph.spark
        old = [n for n in listed(spark, self.path) if re.fullmatch("[0-9a-f]{32}", n) and n != version]
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/CURRENT")
        for n in old[self.keep :]:
            delete(spark, f"{self.path}/{n}")


def _columns(df: DataFrame, fields: Iterable[str]) -> list[str]:
    """The fields' columns that can be sorted by."""
    return [c for c in map(column_of, fields) if c in df.columns and not isinstance(df.schema[c].dataType, (T.VariantType, T.MapType))]


def _index_rows(df: DataFrame, kind: str, fields: list[str], where: dict) -> DataFrame:
    """The indexed fields and the id of the entities that a (partial) index holds, sorted by the fields."""
    cond = lookups.condition(df.schema, where, RESERVED[kind])
    own = [c for c in map(column_of, fields) if c in df.columns]
    rows = (df if cond is None else df.filter(cond)).select("id", *own)
    keys = _columns(df, fields)
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows


def save(graph: PropertyGraph, store: str | GraphStore) -> None:
    store = ParquetStore(store) if isinstance(store, str) else store
    store.commit(graph, store.stage(graph))


def load(spark: SparkSession, path: str) -> PropertyGraph:
    return ParquetStore(path).load(spark)


def dump_frame(graph: PropertyGraph) -> DataFrame:
    """part, id, line: each entity as JSON text, nodes with ``_id``, edges with ``_src`` and ``_tgt``."""
    v = F.struct(*(F.col(c).alias(field_of(c)) for c in graph.nodes.columns if c != "id"), F.col("id").alias("_id"))
    e = F.struct(*(F.col(c).alias(field_of(c)) for c in graph.edges.columns if c not in ("id", "src", "dst")), F.col("src").alias("_src"), F.col("dst").alias("_tgt"))
    nodes = graph.nodes.select(F.lit("nodes").alias("part"), "id", F.to_json(v).alias("line"))
    return nodes.unionAll(graph.edges.select(F.lit("edges").alias("part"), "id", F.to_json(e).alias("line")))


def dump_json(graph: PropertyGraph, path: str) -> None:
    """One JSON object in one file of any store, entities in id order.

    The tasks write sorted parts; the parts' bytes are then copied one after the other into the file that the format asks
    for, so no row passes through Python.
    """
    spark, lines, pieces = graph.spark, durable(dump_frame(graph)), []
    for part, head in (("nodes", '{"nodes": ['), ("edges", '], "edges": [')):
        own, folder = lines.filter(F.col("part") == part), fresh_path(spark, "dump-part")
        first = own.agg(F.min("id")).first()[0]
        comma = F.when(F.col("id") == first, F.lit("")).otherwise(F.lit(", ")) if first is not None else F.lit("")
        own.orderBy("id").select(F.concat(comma, "line").alias("value")).write.text(folder)
        pieces += [head, (folder,)]
    tail = f'], "node_indexes": {json.dumps(graph.get_node_indexes())}, "edge_indexes": {json.dumps(graph.get_edge_indexes())}}}'
    joined_text(spark, path, [*pieces, tail])


def _typed(entities: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """A column for each key of the VARIANT objects in ``x``, of the type that all its values have, else VARIANT."""
    shape = entities.agg(F.schema_of_variant_agg("x")).first()[0]
    if shape is None or not shape.startswith("OBJECT<") or shape == "OBJECT<>":
        return entities.select(*(F.variant_get("x", f"$.{h}", "long").alias(h) for h in hidden))
    out = []
    for key, t in _keys(shape):
        cell, simple = F.variant_get("x", f"$.{key}", "variant"), _SIMPLE.get(t.partition("(")[0])
        if key in hidden:
            out.append(F.variant_get("x", f"$.{key}", "long").alias(key))
            continue
        check_name(key)
        out.append((F.variant_get("x", f"$.{key}", simple) if simple else F.when(~F.is_variant_null(cell), cell)).alias(column_of(key)))
    return entities.select(*out)


_SIMPLE = {"BIGINT": "long", "DOUBLE": "double", "DECIMAL": "double", "STRING": "string", "BOOLEAN": "boolean", "VOID": "string"}


def _keys(shape: str) -> list[tuple[str, str]]:
    """(key, type) of the outermost OBJECT<key: type, ...>."""
    out, depth, start, body = [], 0, 0, shape[len("OBJECT<") : -1]
    for i, c in enumerate(f"{body},"):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            key, _, t = body[start:i].partition(": ")
            out.append((key.strip().strip("`"), t.strip()))
            start = i + 1
    return out


def load_json(graph: PropertyGraph, path: str, id_map: dict | None = None) -> dict:
    """Append a dump under new ids; the map from old to new node ids comes back. Indexes keep their filters.

    One task parses the file, as it is one object; entities are typed, numbered and joined to their ends as rows. Only the
    map, which is the call's result, comes to the driver.
    """
    shape = "nodes array<variant>, edges array<variant>, node_indexes string, edge_indexes string"
    whole = durable(graph.spark.read.schema(shape).option("multiLine", True).json(path))
    id_map = {} if id_map is None else id_map
    part = lambda n: whole.select(F.posexplode(n).alias("_at", "x"))
    nodes = durable(numbered(_typed(part("nodes").orderBy("_at").select("x"), ("_id",)), "id", graph._fresh("v", 0)))
    ids = nodes.select("_id", "id")
    at = lambda old, new: ids.select(F.col("_id").alias(old), F.col("id").alias(new))
    edges = numbered(_typed(part("edges").orderBy("_at").select("x"), ("_src", "_tgt")), "id", graph._fresh("e", 0))
    edges = durable(edges.join(at("_src", "src"), "_src", "left").join(at("_tgt", "dst"), "_tgt", "left"))
    if not edges.filter("src IS NULL OR dst IS NULL").isEmpty():
        raise DataError("an edge needs nodes that exist")
    graph._append(nodes.drop("_id"), edges.drop("_src", "_tgt"))
    id_map.update({r["_id"]: r["id"] for r in ids.toLocalIterator()})
    found = whole.select("node_indexes", "edge_indexes").first()
    for add, text in ((graph.add_node_index, found[0]), (graph.add_edge_index, found[1])):
        for fields, filters in json.loads(text or "[]"):
            try:
                add(*fields, **filters)
            except IndexAlreadyExists:
                continue
    return id_map


def edge_list(spark: SparkSession, path: str, field: str = "gid") -> PropertyGraph:
    """White-space separated ``source target`` lines, ``#`` comments skipped. Distinct names are nodes."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    pairs = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.col("p")[0].alias("s"), F.col("p")[1].alias("t"))
    name = column_of(field)
    names = pairs.select("s").union(pairs.select("t")).distinct().withColumnRenamed("s", name)
    ordered = numbered(names.orderBy(name), "id").select("id", name)
    at = lambda n, c: ordered.select(F.col(name).alias(n), F.col("id").alias(c))
    edges = pairs.join(at("s", "src"), "s").join(at("t", "dst"), "t").select("src", "dst")
    return PropertyGraph(ordered, numbered(edges.orderBy("src", "dst"), "id").select("id", "src", "dst"), [((field,), {})])
