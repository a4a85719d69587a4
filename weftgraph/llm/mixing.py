"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network routes
each pattern's words to the sources that contain it: the first use of a pattern's words is free and every
repetition costs more than the one before (convex), so words are repeated only where a source's quota
can't be met otherwise. The network has one node a pattern and one a source, and is solved on the
driver; documents never leave the executors. A pattern's flow then becomes whole passes over its
documents plus part of one more pass in a seeded order, whose last document is taken in part, so that
sources meet their quotas to the word.

Targets: sources in code-point order, null last, take ``weights`` in turn and share ``factor`` times all
words; no target exceeds ``max_epochs`` times its source's words, and what is left over is shared among
the others by weight until none is above.

Prefix sums over a pattern are taken in two steps (buckets of the seeded order, then within a bucket), so
a source that holds a third of all rows is spread over as many tasks as any other.

Defined cases: a null or empty text has size 0 and nothing is taken from it; a null source is a source
of its own; rows that repeat an id are separate rows, whose order among themselves follows their size; a row
without an id goes by the md5 of its text; an empty table gives an empty result; extra columns pass through
``apply_mix`` unchanged.

The driver holds a row for each pattern. Patterns that share no source, not even through others, are solved apart,
so any number of sources without overlaps costs no more than a step each; the result is broadcast only while it has
``BROADCAST_ROWS`` rows at most and joined by a shuffle beyond.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

WEIGHTS, FACTOR, MAX_EPOCHS, SEED, BROADCAST_ROWS = (3, 1, 2), 1.5, 2, 17, 10_000
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_count(text: pa.Scalar) -> int:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes that aren't ASCII white space after one that is, or first."""
    if not text.is_valid:
        return 0
    space = _SPACE[np.frombuffer(text.as_buffer(), np.uint8)]
    return int(len(space) and not space[0]) + int(np.count_nonzero(space[:-1] & ~space[1:]))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([word_count(t) for t in b.column(b.num_columns - 1)], pa.int64())], names=[*b.schema.names[:-1], "size"])


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: float = MAX_EPOCHS) -> list[float]:
    """Shares of ``factor * sum(sizes)`` by weight (in turn), none above ``most`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / w[i], i))
    left, rest, out = factor * sum(sizes), sum(w), [0.0] * len(sizes)
    for k, i in enumerate(order):
        if left * w[i] / rest <= most * sizes[i]:  # from here on none is above
            for j in order[k:]:
                out[j] = left * w[j] / rest
            break
        out[i] = float(most * sizes[i])
        left, rest = left - out[i], rest - w[i]
    return out


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], epochs: int = MAX_EPOCHS) -> list[list[int]]:
    """flow[pattern][k]: words that the pattern gives to its k-th member source.

    Successive shortest paths with potentials. The e-th use of a pattern's words costs e * e.
    """
    n_p, n_s = len(capacity), len(quotas)
    source, sink = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, cap, cost = [], [], []

    def arc(u: int, v: int, c: int, w: int) -> int:
        graph[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        graph[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
        return len(to) - 2

    own = []
    for p, words in enumerate(capacity):
        for e in range(epochs):
            arc(source, p, words, e * e)
        own.append([arc(p, n_p + s, epochs * words, 0) for s in members[p]])
    for s, q in enumerate(quotas):
        arc(n_p + s, sink, q, 0)
    potential = [0] * (sink + 1)
    while True:
        dist, via = [math.inf] * (sink + 1), [-1] * (sink + 1)
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for a in graph[u]:
                if cap[a] and (nd := d + cost[a] + potential[u] - potential[to[a]]) < dist[to[a]]:
                    dist[to[a]], via[to[a]] = nd, a
                    heapq.heappush(heap, (nd, to[a]))
        if via[sink] < 0:
            return [[cap[a ^ 1] for a in arcs] for arcs in own]
        potential = [x + (d if d < math.inf else 0) for x, d in zip(potential, dist, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[a] for a in path)
        for a in path:
            cap[a] -= push
            cap[a ^ 1] += push


def route_apart(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], epochs: int = MAX_EPOCHS) -> list[list[int]]:
    """``route`` for each connected part of the network by itself."""
    parent = list(range(len(quotas)))

    def top(s: int) -> int:
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for own in members:
        for s in own[1:]:
            parent[top(s)] = top(own[0])
    parts: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        if own:
            parts.setdefault(top(own[0]), []).append(p)
    out: list[list[int]] = [[] for _ in members]
    for own in parts.values():
        if len(own) == 1 and len(members[own[0]]) == 1:
            out[own[0]] = [min(quotas[members[own[0]][0]], epochs * capacity[own[0]])]
            continue
        at = {s: i for i, s in enumerate(sorted({s for p in own for s in members[p]}))}
        flows = route([capacity[p] for p in own], [[at[s] for s in members[p]] for p in own], [quotas[s] for s in at], epochs)
        for p, f in zip(own, flows, strict=True):
            out[p] = f
    return out


def _sized(docs: DataFrame, membership: Column | None, seed: int) -> DataFrame:
    """doc_id, members, size, pattern, key (of the seeded order) of each row, without its text."""
    members = F.array("source") if membership is None else F.array_sort(F.array_distinct(membership))
    slim = docs.select("doc_id", members.alias("members"), _key(seed).alias("key"), F.col("text").cast("string").alias("text"))
    sized = slim.mapInArrow(_sizes, f"doc_id {slim.schema[0].dataType.simpleString()}, members {slim.schema[1].dataType.simpleString()}, key string, size long")
    return materialize(sized.withColumn("pattern", _pattern("members")), "mix-sized")


def _pattern(members: str | Column) -> Column:
    return F.to_json(F.struct(F.col(members).alias("members") if isinstance(members, str) else members.alias("members")))


def _key(seed: int) -> Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.md5(F.concat_ws(":", own, F.lit(str(seed))))


def _plan(sized: DataFrame, weights: Sequence[float], factor: float, max_epochs: int) -> tuple[DataFrame, int]:
    """pattern, base (whole passes), extra (words of one more), source_size, target; and the rows of the largest pattern."""
    found = sized.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    rows = sorted(found.collect(), key=lambda r: r["pattern"])
    sources = sorted({s for r in rows for s in r["members"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(sources)}
    members = [[index[s] for s in r["members"]] for r in rows]
    sizes = [0] * len(sources)
    for r, own in zip(rows, members, strict=True):
        for i in own:
            sizes[i] += r["words"]
    goal = targets(sizes, weights, factor * sum(r["words"] for r in rows) / max(1, sum(sizes)) if sum(sizes) else factor, max_epochs)
    flow = route_apart([r["words"] for r in rows], members, [math.floor(t + 0.5) for t in goal], max_epochs)
    plan = []
    for r, own, f in zip(rows, members, flow, strict=True):
        base, extra = divmod(sum(f), r["words"]) if r["words"] else (0, 0)
        plan.append((r["pattern"], base, extra, sizes[own[0]] if own else 0, goal[own[0]] if own else 0.0))
    made = sized.sparkSession.createDataFrame(plan, "pattern string, base long, extra long, source_size long, target double")
    made = F.broadcast(made) if len(plan) <= BROADCAST_ROWS else made
    return made, max((r["docs"] for r in rows), default=0)


def _cut(sized: DataFrame, most: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """``sized`` with the bucket of each row, and (pattern, bucket, before): the words of the buckets ahead."""
    digits = 2
    while 16**digits * bucket_rows < most and digits < 8:
        digits += 1
    cut = sized.withColumn("bucket", F.substring("key", 1, digits))
    ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    return cut, buckets.select("pattern", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))


def mix(
    docs: DataFrame, membership: Column | None = None, weights: Sequence[float] = WEIGHTS, factor: float = FACTOR,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_rows: int = 20_000,
) -> DataFrame:
    """doc_id, size, sources, source_size and target (of the first source), taken, copies.

    ``membership``: array of each document's sources; by default the one in ``source``.
    ``taken``: words that the mix takes, repeats counted. ``copies``: the nearest number of whole copies.
    """
    ship(docs.sparkSession)
    sized = _sized(docs, membership, seed)
    plan, most = _plan(sized, weights, factor, max_epochs)
    cut, buckets = _cut(sized, most, bucket_rows)
    inside = Window.partitionBy("pattern", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("upto", F.sum("size").over(inside)).join(buckets, ["pattern", "bucket"]).join(plan, "pattern")
    part = F.greatest(F.lit(0), F.least("size", F.expr("extra - (before + upto - size)")))
    taken = F.col("base") * F.col("size") + part
    copies = F.when(F.col("size") > 0, F.col("base") + (2 * part >= F.col("size")).cast("long")).otherwise(0)
    return placed.select("doc_id", "size", F.col("members").alias("sources"), "source_size", "target", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"))


def apply_mix(
    docs: DataFrame, membership: Column | None = None, weights: Sequence[float] = WEIGHTS, factor: float = FACTOR,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_rows: int = 20_000,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it whole; columns unchanged, texts whole.

    Texts aren't shuffled: in a pattern's seeded order, rows up to one cut are taken once more than the others, so
    each row tells its copies from the cut of its pattern. Rows of one id are one document here.
    """
    ship(docs.sparkSession)
    sized = _sized(docs, membership, seed)
    plan, most = _plan(sized, weights, factor, max_epochs)
    cut, buckets = _cut(sized, most, bucket_rows)
    units = cut.groupBy("pattern", "bucket", "key").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = units.withColumn("upto", F.sum("size").over(inside)).join(buckets, ["pattern", "bucket"]).join(plan, "pattern")
    start = F.expr("before + upto - size")
    edge = placed.filter((start <= F.col("extra")) & (F.col("extra") < start + F.col("size")))  # one unit of each pattern
    edge = materialize(edge.select("pattern", "base", F.col("key").alias("last"), (2 * (F.col("extra") - start) >= F.col("size")).alias("within")), "mix-cuts")
    cuts = edge.select(F.col("pattern").alias("__mix_pattern"), F.struct("base", "last", "within").alias("__mix_cut"))
    members = F.array("source") if membership is None else F.array_sort(F.array_distinct(membership))
    more = (_key(seed) < F.col("__mix_cut.last")) | ((_key(seed) == F.col("__mix_cut.last")) & F.col("__mix_cut.within"))
    held = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    copies = F.when(held, F.col("__mix_cut.base") + more.cast("long")).otherwise(0).cast("int")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts  # a row for each pattern
    joined = docs.withColumn("__mix_pattern", _pattern(members)).join(cuts, "__mix_pattern")
    many = joined.withColumn("__mix_copies", copies).filter("__mix_copies > 0")
    return many.withColumn("__mix_no", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))), ':17')) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2 * (sum(source_size) OVER (ORDER BY source_size / w, i ROWS UNBOUNDED PRECEDING) - source_size) AS remaining,
      sum(w) OVER (ORDER BY source_size / w DESC, i DESC ROWS UNBOUNDED PRECEDING) AS rest, row_number() OVER (ORDER BY source_size / w, i) AS k FROM w),
c AS (SELECT * FROM o WHERE remaining * w / rest <= 2 * source_size ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k >= c.k THEN c.remaining * o.w / c.rest ELSE CAST(2 * o.source_size AS DOUBLE) END AS target FROM o LEFT JOIN c ON true),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - before)) END AS BIGINT) AS taken
FROM r
"""
