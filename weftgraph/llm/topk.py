"""Exact top-k inner-product search by a dual-tree over cover trees.

Rows are dealt into blocks of bounded size; every block of queries meets every block of data. In each
pair of blocks queries and data enter one tree: a node's children are centres that are more than the
child radius apart and cover its points within that radius (a cover tree's separation and covering
rules), and radii shrink by a fixed factor. A node stays a leaf where centres gather fewer than ``GATHER`` points
each: children of single points would bound nothing that their products don't tell as cheaply. The search walks
pairs of nodes from the best bound down. A pair is dropped when no data
point below it can reach the worst k-th score of any query below it:
``<c_q, c_d> + |c_q| r_d + |c_d| r_q + r_q r_d`` bounds every product, by Cauchy-Schwarz. Leaf pairs are
one matrix product. A first pass over a bounded sample of the data gives every query a k-th score to begin with, so
the bounds of all blocks bite from the start. The k best of each block are merged by a ranking per query.

Components become ``floor(256 * x)`` with x as double; scores are exact integers: products run in
double while they can't pass 2^53, in 64-bit integers while they can't pass those, and in Python integers beyond.

Defined cases: vectors that are null, or hold null or non-finite components (times 256 too), take no part as query or
candidate; vectors of different length aren't compared; equal scores go to the smaller id; of rows that repeat an id the
smallest vector counts, once; a query without candidates has no row; null ids take no part; a score beyond 64 bits is
the nearest long, and equal to others of that kind; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

K, EVERY, BLOCK, SAMPLE, SHRINK, LEAF, GATHER = 5, 50, 4096, 2048, 1.3, 64, 3
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Node:
    __slots__ = ("at", "centre", "kids", "norm", "radius", "worst")

    def __init__(self, at: np.ndarray, x: np.ndarray):
        self.at, self.kids, self.worst = at, [], -np.inf
        self.centre = x[at[0]]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.radius = float(np.sqrt(((x[at] - self.centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)


def cover_tree(x: np.ndarray, at: np.ndarray, leaf: int = LEAF) -> Node:
    """Split while points gather round the centres of the next smaller radius."""
    root = Node(at, x)
    todo = [(root, root.radius / SHRINK)]
    while todo:
        node, radius = todo.pop()
        if len(node.at) <= leaf or node.radius == 0:
            continue
        radius = min(radius, node.radius / SHRINK)
        rest, groups, most = node.at, [], 16
        while len(rest):
            near = ((x[rest] - x[rest[0]]) ** 2).sum(axis=1) <= radius * radius
            near[0] = True
            groups.append(rest[near])
            rest = rest[~near]
            if len(groups) == most:
                if len(node.at) - len(rest) < GATHER * len(groups):
                    break
                most *= 2
        if len(rest) or len(groups) < 2 or len(node.at) < GATHER * len(groups):
            continue
        node.kids = [Node(g, x) for g in groups]
        todo += [(kid, radius / SHRINK) for kid in node.kids]
    return root


def _split(node: Node, is_query: np.ndarray, x: np.ndarray) -> tuple[Node | None, Node | None]:
    """The query side and the data side of the joint tree; nodes without points of a side vanish."""
    sides = []
    for flag in (True, False):
        def narrow(n: Node) -> Node | None:
            own = n.at[is_query[n.at] == flag]
            if not len(own):
                return None
            kids = [m for k in n.kids if (m := narrow(k))]
            if len(kids) == 1:
                return kids[0]
            out = Node(own, x)
            out.kids = kids
            return out
        sides.append(narrow(node))
    return sides[0], sides[1]


def _clamped(s: np.ndarray) -> np.ndarray:
    return s.astype(np.int64) if s.dtype != object else np.array([min(max(v, int(_LOW) + 1), int(_HIGH)) for v in s], np.int64)


def dual_search(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int = K, floor: np.ndarray | None = None, work: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best candidates with another id; ties to the smaller id.

    ``floor``: a score for each query that k candidates reach somewhere; lower ones aren't searched for.
    ``work``: gets the number of products done, for measuring what the bounds save.
    """
    nq, top = len(q), float(max(np.abs(q).max(initial=0), np.abs(d).max(initial=0)))
    exact = top * top * q.shape[1] < 2.0**53
    joint = np.concatenate([q, d])
    ints = None if exact else joint.astype(np.int64) if top * top * q.shape[1] < 2.0**62 else np.array([[int(v) for v in row] for row in joint], object)
    unit = max(1.0, top) / 2.0**40 if ints is not None and ints.dtype == object else 1.0
    queries, data = _split(cover_tree(joint / unit, np.arange(len(joint))), np.arange(len(joint)) < nq, joint / unit)
    if unit > 1:  # bounds of such sizes aren't worth the care; every pair is a product
        for node in (queries, data):
            if node is not None:
                node.kids = []
    low, none = _LOW, _HIGH
    best, who = np.full((nq, k), low), np.full((nq, k), none)  # scores, best first, and their ids
    floor = np.full(nq, low) if floor is None else floor

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-6

    def base(a: Node, b: Node) -> None:
        other = d_ids[b.at - nq]
        for i in range(0, len(a.at), 256):
            own = a.at[i : i + 256]
            s = joint[own] @ joint[b.at].T if exact else ints[own] @ ints[b.at].T
            if s.dtype == object:
                s = _clamped(s.ravel()).reshape(s.shape)
            if work is not None:
                work["products"] = work.get("products", 0) + s.size
            mask = other[None, :] != q_ids[own][:, None]
            if s.shape[1] > k:
                mask &= s >= np.partition(np.where(mask, s, low), -k, axis=1)[:, -k][:, None]
            r, c = np.nonzero(mask & (s >= np.maximum(best[own, -1], floor[own])[:, None]))
            have = np.nonzero(who[own].ravel() != none)[0]
            r, sc, ids = np.concatenate([r, have // k]), np.concatenate([s[r, c].astype(np.int64), best[own].ravel()[have]]), np.concatenate([other[c], who[own].ravel()[have]])
            order = np.lexsort((ids, -sc, r))
            r, sc, ids = r[order], sc[order], ids[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            ok = rank < k
            nb, nw = np.full((len(own), k), low), np.full((len(own), k), none)
            nb[r[ok], rank[ok]], nw[r[ok], rank[ok]] = sc[ok], ids[ok]
            best[own], who[own] = nb, nw
        a.worst = float(np.maximum(best[a.at, -1], floor[a.at]).min())

    def worst(a: Node) -> float:
        if a.worst == -np.inf:
            a.worst = float(floor[a.at].min())
        a.worst = max(a.worst, min(w.worst for w in a.kids)) if a.kids else a.worst
        return a.worst

    def walk(a: Node, b: Node) -> None:
        if unit == 1 and bound(a, b) < worst(a):
            return
        if not a.kids and not b.kids:
            base(a, b)
            return
        pairs = [(m, n) for m in (a.kids or [a]) for n in (b.kids or [b])]
        for m, n in sorted(pairs, key=lambda p: -bound(*p)):
            walk(m, n)

    if queries is not None and data is not None:
        walk(queries, data)
    r, c = np.nonzero(who != none)
    return q_ids[r], who[r, c], best[r, c]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _pair(k: int):
    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        floor = left["floor"].to_numpy(np.int64) if "floor" in left else None
        a, b, s = dual_search(left["vec_id"].to_numpy(), _matrix(left["v"]), right["own_id"].to_numpy(), _matrix(right["own_v"]), k, floor)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return search


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(256 x) of each component as double); only usable rows, one for each id."""
    times = lambda x: F.lit(256.0) * x.cast("double")
    # from 2^53 on a double is whole; floor() itself ends at the range of a long
    v = F.transform("embedding", lambda x: F.when(F.abs(times(x)) < 2.0**53, F.floor(times(x)).cast("double")).otherwise(times(x)))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(times(x)) < float("inf")))
    own = vectors.filter("vec_id IS NOT NULL").filter(F.coalesce(usable, F.lit(False)))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _searched(queries: DataFrame, data: DataFrame, n_query: int, n_data: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each pair of blocks."""
    data = data.select(F.col("vec_id").alias("own_id"), F.col("v").alias("own_v"))  # names of its own: both sides may come from one frame
    data = data.withColumn("dblock", F.pmod(F.xxhash64("own_id", F.lit(1)), F.lit(n_data)).cast("int")).withColumn("dim", F.size("own_v"))
    data = data.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    queries = queries.withColumn("qblock", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_query)).cast("int")).withColumn("dim", F.size("v"))
    queries = queries.withColumn("dblock", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))))
    keys = ["qblock", "dblock", "dim"]
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_pair(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k best other rows.

    With more than two blocks of data, about ``sample`` rows chosen by a hash of their ids first give the queries a
    k-th score to begin with; it only ever leaves out what can't be among a query's k best.
    """
    ship(vectors.sparkSession)
    rows = materialize(quantized(vectors), "vectors")
    total = rows.count()
    n_data, n_query = max(1, -(-total // block)), max(1, -(-total // (every * block)))
    queries = rows.filter(f"vec_id % {every} = 0")
    if n_data > 2:
        few = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, total // sample))) == 0)
        seed = _searched(queries, few, n_query, 1, k).groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("c"))
        floor = F.when(F.col("c") >= k, F.col("low")).otherwise(int(_LOW))
        queries = queries.join(seed.select(F.col("query_id").alias("vec_id"), floor.alias("floor")), "vec_id", "left").fillna({"floor": int(_LOW)})
        queries = materialize(queries, "queries")
    part = _searched(queries, rows, n_query, n_data, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
