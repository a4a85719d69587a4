"""Shortest paths as frontier rounds over the edge frame.

Every round joins the frontier with its outgoing edges and keeps what improves a node's distance; the search ends when
nothing does. Only improvements are written, in checkpoints of their own, and merged into one table every ``MERGE``
rounds, so a round of a small frontier moves no settled node. Predecessors are chosen after convergence: among
edges that give a node its distance, the one from the predecessor of the least (distance, id); zero-weight
edges count only where they lie on the path of fewest hops, so that the tree has no cycle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnreachableNode
from ..functions.validate import column_of, field_of
from ..graph import PropertyGraph
from ..storage import durable
from .entity import Node

MERGE = 8
Heuristic = Callable[[dict, dict], float] | Column


def _weighted(g: PropertyGraph, weight: str | None) -> DataFrame:
    if weight is None:
        w = F.lit(1)
    elif column_of(weight) in g.edges.columns:
        w = F.col(column_of(weight))
    else:
        raise KeyError(weight)
    return g.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_t"), w.alias("_w"))


def _check(step: DataFrame, weight: str) -> None:
    """An error where an edge that the search comes by has no weight or a negative one."""
    bad = step.agg(F.min("_w").alias("low"), F.count(F.when(F.col("_w").isNull(), 1)).alias("gaps")).first()
    if bad["gaps"]:
        raise KeyError(weight)
    if bad["low"] is not None and bad["low"] < 0:
        raise ValueError("contradictory paths: a reachable edge has a negative weight")


def _least(frames: list[DataFrame], among: DataFrame | None = None) -> DataFrame:
    """The least (dist, hops) of each node in any of the frames; with ``among`` (_k) only of those nodes."""
    rows = reduce(DataFrame.unionByName, frames)
    rows = rows if among is None else rows.join(among, F.col("id") == F.col("_k"), "left_semi")
    return rows.groupBy("id").agg(F.min(F.struct("dist", "hops")).alias("b")).select("id", "b.dist", "b.hops")


def distances(g: PropertyGraph, source: int, target: int | None = None, cutoff: float | None = None, weight: str | None = None, estimates: DataFrame | None = None) -> DataFrame:
    """(id, dist, hops) of every node within reach, or, with a target, of those that are settled no later.

    ``estimates``: (_n, _h), a lower bound of what is left from each node to the target; nodes that can't beat
    the best path so far are left out.
    """
    e = _weighted(g, weight)
    # only edges of sound weight are left to most searches; the rest is looked at round by round, as it may be out of reach
    sound = weight is None or e.filter("_w IS NULL OR _w < 0").isEmpty()
    front = g.spark.createDataFrame([(source, 0, 0)], "id long, dist long, hops long").select("id", F.col("dist").cast(e.schema["_w"].dataType).alias("dist"), "hops")
    found, goal = [front], None
    while True:
        if target is not None and (end := front.filter(F.col("id") == target).first()) is not None:
            goal = end["dist"] if goal is None else min(goal, end["dist"])
        step = front.join(e, front["id"] == e["_s"])
        if not sound:
            _check(step, weight)
        step = step.select(F.col("_t").alias("id"), (F.col("dist") + F.col("_w")).alias("dist"), (F.col("hops") + 1).alias("hops"))
        if cutoff is not None:
            step = step.filter(F.col("dist") <= cutoff)
        if goal is not None:
            ahead = F.col("dist")
            if estimates is not None:
                step = step.join(estimates, step["id"] == estimates["_n"], "left")
                ahead = ahead + F.coalesce("_h", F.lit(0.0))
            step = step.filter(ahead <= goal)
        step = step.groupBy("id").agg(F.min(F.struct("dist", "hops")).alias("n"))
        old = _least(found, step.select(F.col("id").alias("_k"))).select(F.col("id").alias("_k"), F.struct("dist", "hops").alias("o"))
        fresh = step.join(old, F.col("id") == F.col("_k"), "left").filter(F.col("o").isNull() | (F.col("n") < F.col("o")))
        front = durable(fresh.select("id", "n.dist", "n.hops"))
        if front.isEmpty():
            break
        found.append(front)
        if len(found) > MERGE:
            found = [durable(_least(found))]
    best = durable(_least(found))
    if goal is not None:
        best = best.filter((F.col("dist") < goal) | ((F.col("dist") == goal) & (F.col("id") <= target)))
    return best


def predecessors(g: PropertyGraph, dist: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, dist, pred), pred null for the source."""
    e = _weighted(g, weight)
    a = dist.select(F.col("id").alias("pred"), F.col("dist").alias("pd"), F.col("hops").alias("ph"))
    hop = a.join(e, a["pred"] == e["_s"]).join(dist, F.col("_t") == dist["id"])
    hop = hop.filter("pd + _w = dist AND (pd < dist OR ph < hops) AND hops > 0")
    best = hop.groupBy("id").agg(F.min_by("pred", F.struct("pd", "pred")).alias("pred"))
    return dist.join(best, "id", "left").select("id", "dist", "pred")


def _walk(tree: DataFrame, target: int) -> list[int]:
    """Ids from the source to the target. Ancestors 1, 2, 4, ... steps up come from joining the tree with itself; the path
    is put together from the longest steps down, so a path of n hops takes about 2 log2(n) joins."""
    jump = durable(tree.filter("pred IS NOT NULL").select("id", "pred"))
    jumps = []
    while not jump.filter(F.col("id") == target).isEmpty():
        jumps.append(jump)
        up = jump.select(F.col("id").alias("pred"), F.col("pred").alias("_up"))
        jump = durable(jump.join(up, "pred").select("id", F.col("_up").alias("pred")))
    path = tree.sparkSession.createDataFrame([(target, 0)], "id long, up long")
    for k, steps in reversed(list(enumerate(jumps))):
        path = durable(path.unionAll(path.join(steps, "id").select("pred", F.col("up") + 2**k)))
    rows = path.collect()  # a row for each node of one path
    return [r["id"] for r in sorted(rows, key=lambda r: -r["up"])]


def single_source_dijkstra(g: PropertyGraph, source: Node, target: Node | None = None, cutoff: float | None = None, weight: str | None = None) -> tuple[dict, dict]:
    """Distances and paths (lists of ids) by id. The result is for the driver; ``distances`` isn't."""
    s, t = source.get_id(), target.get_id() if target is not None else None
    if s == t:
        return {s: 0}, {s: [s]}
    rows = predecessors(g, distances(g, s, t, cutoff, weight), weight).collect()
    pred = {r["id"]: r["pred"] for r in rows}
    paths = {}
    for i in pred:
        path = [i]
        while pred.get(path[-1]) is not None:
            path.append(pred[path[-1]])
        paths[i] = path[::-1]
    return {r["id"]: r["dist"] for r in rows}, paths


def dijkstra_path(g: PropertyGraph, source: Node, target: Node, cutoff: float | None = None, weight: str | None = None) -> tuple[float, list[Node]]:
    s, t = source.get_id(), target.get_id()
    if s == t:
        return 0, [source]
    dist = distances(g, s, t, cutoff, weight)
    end = dist.filter(F.col("id") == t).first()
    if end is None:
        raise UnreachableNode(f"{t} from {s}")
    return end["dist"], [g.v(i) for i in _walk(predecessors(g, dist, weight), t)]


def _estimates(g: PropertyGraph, target: int, h: Heuristic) -> DataFrame:
    """(_n, _h): the estimate from each node to the target. A Column over node columns (``id`` and fields) stays in the JVM;
    a function of both nodes' data runs over Arrow batches."""
    if isinstance(h, Column):
        return g.nodes.select(F.col("id").alias("_n"), h.cast("double").alias("_h"))
    goal = g.v(target).data()
    own = [c for c in g.nodes.columns if c != "id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_n": b["_n"], "_h": [float(h(json.loads(x), goal)) for x in b["data"]]})

    data = F.to_json(F.struct(*(F.col(c).alias(field_of(c)) for c in own))) if own else F.lit("{}")
    return durable(g.nodes.select(F.col("id").alias("_n"), data.alias("data")).mapInPandas(run, "_n long, _h double"))


def _astar(g: PropertyGraph, source: Node, target: Node, h: Heuristic, weight: str | None) -> tuple[float, list[Node]]:
    s, t = source.get_id(), target.get_id()
    if s == t:
        return 0, [source]
    dist = distances(g, s, t, None, weight, _estimates(g, t, h))
    end = dist.filter(F.col("id") == t).first()
    if end is None:
        raise UnreachableNode(f"{t} from {s}")
    return end["dist"], [g.v(i) for i in _walk(predecessors(g, dist, weight), t)]


def astar_path(g: PropertyGraph, source: Node, target: Node, heuristic: Heuristic | None = None, weight: str | None = None) -> list[Node]:
    """A cheapest path; an admissible heuristic prunes nodes that can't lie on a better one."""
    return dijkstra_path(g, source, target, None, weight)[1] if heuristic is None else _astar(g, source, target, heuristic, weight)[1]


def astar_path_length(g: PropertyGraph, source: Node, target: Node, heuristic: Heuristic | None = None, weight: str | None = None) -> float:
    """The least cost, over parallel edges too."""
    return dijkstra_path(g, source, target, None, weight)[0] if heuristic is None else _astar(g, source, target, heuristic, weight)[0]
