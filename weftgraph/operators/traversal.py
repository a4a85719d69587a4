"""Traversals: immutable chains of steps over bags of node or edge ids.

A traversal compiles to one DataFrame when a result is asked for. In row mode each path is a row: ``_id``, its
ordinal ``_ord`` (root id, then one edge id for each expansion: lexicographic order is depth-first order) and a
column for each alias. In bag mode rows of equal ids are merged before every further hop into ``_m`` (number of
paths) with the smallest ordinal, so that counts and sums don't enumerate paths. An alias that a later step reads keeps
rows apart until then; the others are dropped.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..functions import ordering, variant
from ..functions.validate import column_of, field_of
from ..storage import durable

if TYPE_CHECKING:
    from ..graph import Snapshot

ROW = frozenset(("_id", "_ord"))
SPREAD, MOST_TASKS = 2 << 20, 1 << 16  # bytes of edges (sources and targets) for a task
METHODS = ("inV", "outV", "bothV", "inE", "outE", "bothE")


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    kind: str  # "v" or "e"
    bag: bool
    apart: bool = True  # no two rows have the same id and aliases, as far as merging goes
    here: frozenset[str] = frozenset()  # columns of the aliases bound since the last hop: they equal _id

    def carried(self) -> list[str]:
        return [c for c in self.df.columns if c not in ROW]

    def only(self, aliases: frozenset[str]) -> Frame:
        """In bag mode, without the columns of other aliases."""
        gone = [c for c in self.carried() if c.startswith("_a_") and c[3:] not in aliases] if self.bag else []
        return replace(self, df=self.df.drop(*gone), apart=self.apart and self.here.issuperset(gone), here=self.here.difference(gone))

    def merged(self, edges: DataFrame) -> Frame:
        """In bag mode, one row for each id and aliases, to hop from; columns that equal ``_id`` are no keys.

        Rows that leave different fresh aliases never merge again, so that hop gives a row for each pair of neighbours
        however few nodes it starts from: its tasks go by the size of the edges.
        """
        if not self.bag:
            return self
        df = self.df.drop(*self.here)
        if not self.apart:
            df = df.groupBy("_id", *(c for c in self.carried() if c != "_m" and c not in self.here)).agg(F.min("_ord").alias("_ord"), F.sum("_m").alias("_m"))
        if self.here:
            size = int(edges.select("src", "dst")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
            tasks = -(-size // SPREAD)
            df = df.repartition(tasks, "_id") if 1 < tasks <= MOST_TASKS else df  # beyond: of unknown size
            df = df.select("*", *(F.col("_id").alias(c) for c in sorted(self.here)))
        return replace(self, df=df, apart=True)


Run = Callable[[Frame], Frame]


@dataclass(frozen=True)
class Step:
    run: Run
    reads: frozenset[str] = frozenset()  # aliases
    binds: str | None = None


def hops(args: tuple) -> int:
    """At most one positional argument, a whole number of hops."""
    if len(args) > 1:
        raise AssertionError("one count at most")
    n = int(args[0]) if args else 1
    assert n >= 0, "the number of hops is negative"
    return n


def neighbours(s: Snapshot, direction: str, filters: dict) -> DataFrame:
    """(_s, _t, _e, _side) of the edges that match, as seen from ``_s``."""
    e = s.matching("e", filters)
    out = e.select(F.col("src").alias("_s"), F.col("dst").alias("_t"), F.col("id").alias("_e"), F.lit(0).cast("long").alias("_side"))
    back = e.select(F.col("dst").alias("_s"), F.col("src").alias("_t"), F.col("id").alias("_e"), F.lit(1).cast("long").alias("_side"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionAll(back)


def _step(f: Frame, near: DataFrame, to: str, ordinal: Column) -> DataFrame:
    joined = f.df.join(near, f.df["_id"] == near["_s"])
    return joined.select(F.col(to).alias("_id"), ordinal.alias("_ord"), *f.carried())


def _moved(f: Frame, df: DataFrame, kind: str) -> Frame:
    return Frame(df, kind, f.bag, apart=False)


def _only(df: DataFrame, s: Snapshot, kind: str, filters: dict) -> DataFrame:
    if not filters:
        return df
    keep = s.matching(kind, filters).select(F.col("id").alias("_k"))
    return df.join(keep, df["_id"] == keep["_k"], "left_semi")


def vertex_hop(s: Snapshot, direction: str, filters: dict) -> Run:
    def run(f: Frame) -> Frame:
        f = f.merged(s.edges)
        if f.kind == "e":
            e = s.edges.select(F.col("id").alias("_s"), "src", "dst")
            if direction == "both":
                ends = e.select("_s", F.posexplode(F.array("src", "dst")).alias("_p", "_t"))
                df = _step(f, ends, "_t", F.concat("_ord", F.array(F.col("_p").cast("long"))))
            else:
                df = _step(f, e, "src" if direction == "in" else "dst", F.col("_ord"))
        else:
            tail = F.array("_e", "_side") if direction == "both" else F.array("_e")
            df = _step(f, neighbours(s, direction, {}), "_t", F.concat("_ord", tail))
        return _moved(f, _only(df, s, "v", filters), "v")

    return run


def edge_hop(s: Snapshot, direction: str, filters: dict) -> Run:
    def run(f: Frame) -> Frame:
        f = f.merged(s.edges)
        tail = F.array("_e", "_side") if direction == "both" else F.array("_e")
        return _moved(f, _step(f, neighbours(s, direction, filters), "_e", F.concat("_ord", tail)), "e")

    return run


def along_hop(s: Snapshot, direction: str, filters: dict) -> Run:
    """An edge step and the vertex beyond it, fused into one join."""

    def run(f: Frame) -> Frame:
        f = f.merged(s.edges)
        if direction != "both":
            return _moved(f, _step(f, neighbours(s, direction, filters), "_t", F.concat("_ord", F.array("_e"))), "v")
        near = neighbours(s, "both", filters).filter("_s <> _t")
        return _moved(f, _step(f, near, "_t", F.concat(F.array("_side"), "_ord", F.array("_e"))), "v")

    return run


class Traversal:
    """A bag of entities of one kind; each method returns a new one."""

    def __init__(self, snapshot: Snapshot, source: DataFrame, kind: str, steps: tuple = (), kinds: tuple = (), aliases: dict | None = None, rows: int = 0):
        """The first ``rows`` steps need each path as a row of its own."""
        self._s, self._source, self._steps, self._aliases, self._rows = snapshot, source, steps, aliases or {}, rows
        self._kinds = kinds or (kind,)

    # ------------------------------------------------------------------ building

    @property
    def kind(self) -> str:
        return self._kinds[-1]

    def _then(self, run: Run, kind: str | None = None, by_rows: bool = False, reads: Iterable[str] = (), binds: str | None = None) -> Traversal:
        steps = (*self._steps, Step(run, frozenset(reads), binds))
        aliases = self._aliases if binds is None else self._aliases | {binds: self.kind}
        return Traversal(self._s, self._source, self._kinds[0], steps, (*self._kinds, kind or self.kind), aliases, len(steps) if by_rows else self._rows)

    def _frame(self, bag: bool = False) -> Frame:
        f = Frame(self._source, self._kinds[0], bag=False)
        if not bag:
            return reduce(lambda f, step: step.run(f), self._steps, f)
        live = [frozenset()]  # aliases read after each step, from the last one back
        for step in reversed(self._steps):
            live.append((live[-1] - {step.binds}) | step.reads)
        live.reverse()
        f = reduce(lambda f, step: step.run(f), self._steps[: self._rows], f)
        f = replace(f, df=f.df.withColumn("_m", F.lit(1).cast("long")), bag=True, apart=not self._rows).only(live[self._rows])
        for step, after in zip(self._steps[self._rows :], live[self._rows + 1 :]):
            f = step.run(f).only(after)
        return f

    def frame(self) -> DataFrame:
        """One row a path: ``_id``, ``_ord`` and a struct for each alias."""
        return self._frame().df

    def counts(self) -> DataFrame:
        """(_id, _ord, _m): each entity once, with its number of paths and its first ordinal."""
        df = self._frame(bag=True).df
        return df.groupBy("_id").agg(F.min("_ord").alias("_ord"), F.sum("_m").alias("_m"))

    def _vertices(self, direction: str, args: tuple, filters: dict) -> Traversal:
        self._s.check("v", filters)
        out = self
        for _ in range(hops(args)):
            out = out._then(vertex_hop(self._s, direction, filters), "v")
        return out

    def inV(self, *args: int, **filters: object) -> Traversal:  # noqa: N802
        return self._vertices("in", args, filters)

    def outV(self, *args: int, **filters: object) -> Traversal:  # noqa: N802
        return self._vertices("out", args, filters)

    def bothV(self, *args: int, **filters: object) -> Traversal:  # noqa: N802
        return self._vertices("both", args, filters)

    def _edges(self, direction: str, filters: dict) -> Traversal:
        if self.kind == "e":
            raise errors.NoSuchTraversal(f"{direction}E from edges")
        self._s.check("e", filters)
        return self._then(edge_hop(self._s, direction, filters), "e")

    def inE(self, *_: object, **filters: object) -> Traversal:  # noqa: N802
        return self._edges("in", filters)

    def outE(self, *_: object, **filters: object) -> Traversal:  # noqa: N802
        return self._edges("out", filters)

    def bothE(self, *_: object, **filters: object) -> Traversal:  # noqa: N802
        return self._edges("both", filters)

    def _along(self, direction: str, args: tuple, filters: dict) -> Traversal:
        n = hops(args)
        assert self.kind == "v", "only from nodes"
        assert n > 0, "at least one hop"
        self._s.check("e", filters)
        out = self
        for _ in range(n):
            out = out._then(along_hop(self._s, direction, filters), "v")
        return out

    def in_(self, *args: int, **filters: object) -> Traversal:
        return self._along("in", args, filters)

    def out_(self, *args: int, **filters: object) -> Traversal:
        return self._along("out", args, filters)

    def both_(self, *args: int, **filters: object) -> Traversal:
        return self._along("both", args, filters)

    def random(self, method: str, *_: object, seed: int | None = None, **filters: object) -> Traversal:
        """One neighbour or incident edge for each row, drawn before the filters apply; rows without any vanish.

        Each row draws for itself, by a hash of its ordinal, the edge and the seed, so a task that runs again draws the
        same. Without a seed every call makes its own.
        """
        seed = secrets.randbits(62) if seed is None else seed
        if method not in METHODS:
            raise errors.UnknownMethod(method)
        moved = getattr(self._then(_numbered, by_rows=True), method)()
        kind = moved.kind
        self._s.check(kind, filters)

        def pick(f: Frame) -> Frame:
            last = [F.element_at("_ord", i).cast("string") for i in ((-1,) if not method.startswith("both") else (-2, -1) if self.kind == "e" else (-2,))]
            drawn = F.md5(F.concat_ws(":", *last, F.array_join(F.col("_row").cast("array<string>"), ":"), F.lit(str(seed))))
            rest = F.struct("_id", "_ord", *(c for c in f.carried() if c != "_row"))
            df = f.df.groupBy("_row").agg(F.min_by(rest, F.struct(drawn, "_ord")).alias("r")).select("r.*")
            return Frame(_only(df, self._s, kind, filters), kind, f.bag)

        return moved._then(pick, kind, by_rows=True)

    def filter(self, **filters: object) -> Traversal:
        self._s.check(self.kind, filters)
        return self._then(lambda f: replace(f, df=_only(f.df, self._s, f.kind, filters)))

    def aka(self, alias: str) -> Traversal:
        """Bind each row's entity to a name; binding again overwrites."""
        col = f"_a_{alias}"
        return self._then(lambda f: replace(f, df=f.df.withColumn(col, F.col("_id")), here=f.here | {col}), binds=alias)

    def dedup(self, *aliases: str) -> Traversal:
        """The first row of each entity, or of each combination of alias entities and entity."""
        for a in aliases:
            if a not in self._aliases:
                raise errors.UnknownAlias(a)

        def run(f: Frame) -> Frame:
            rest = [c for c in f.carried()]
            keys = ["_id", *(f"_a_{a}" for a in aliases)]
            df = f.df.groupBy(*keys).agg(F.min("_ord").alias("_ord"), *(F.min_by(c, "_ord").alias(c) for c in rest if c not in keys))
            return replace(f, df=df.withColumn("_m", F.lit(1).cast("long")) if f.bag else df, apart=True)

        return self._then(run, reads=aliases)

    def without(self, *aliases: str) -> Traversal:
        """Drop rows whose entity is what any of the aliases is bound to."""
        for a in aliases:
            if a not in self._aliases:
                raise errors.UnknownAlias(a)
        same = [a for a in aliases if self._aliases[a] == self.kind]
        return self._then(lambda f: replace(f, df=reduce(lambda d, a: d.filter(F.col("_id") != F.col(f"_a_{a}")), same, f.df)), reads=same)

    def limit(self, n: int) -> Traversal:
        """The first n rows in traversal order."""
        return self._then(lambda f: Frame(f.df.orderBy("_ord").limit(n), f.kind, f.bag), by_rows=True)

    def order_by(self, *clauses: str) -> Traversal:
        """Stable sort on own fields; nulls are smallest. Later ordinals grow along a range-partitioned sort."""
        parsed = [(column_of(n), up) for n, up in map(ordering.parse, clauses)]
        kind = self.kind

        def run(f: Frame) -> Frame:
            have = self._s.of(kind)
            used = [n for n, _ in parsed if n in have.columns and n not in self._s.reserved(kind)]
            props = have.select(F.col("id").alias("_k"), *(F.col(n).alias(f"_p_{n}") for n in used))
            keys = []
            for n, up in parsed:
                if n in used:
                    own = variant.sort_keys(F.col(f"_p_{n}")) if isinstance(have.schema[n].dataType, T.VariantType) else [F.col(f"_p_{n}")]
                    keys += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in own]
            df = f.df.join(props, f.df["_id"] == props["_k"]).orderBy(*keys, "_ord").select("_id", F.array(F.monotonically_increasing_id()).alias("_ord"), *f.carried())
            return Frame(df, kind, f.bag)

        return self._then(run, by_rows=True)

    # ------------------------------------------------------------------ results

    def count(self) -> int:
        return self._frame(bag=True).df.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0]

    def ids(self) -> list[int]:
        return [r[0] for r in self.frame().orderBy("_ord").select("_id").collect()]

    def _entity(self, i: int):
        return self._s.entity(self.kind, i)

    def all(self) -> list:
        return [self._entity(i) for i in self.ids()]

    def __iter__(self) -> Iterator:
        for r in self.frame().orderBy("_ord").select("_id").toLocalIterator():
            yield self._entity(r[0])

    def next(self):
        """The next entity; the position persists, and starts again after the last."""
        it = self.__dict__.setdefault("_cursor", iter(self))
        try:
            return next(it)
        except StopIteration:
            del self.__dict__["_cursor"]
            raise

    __next__ = next

    def data_frame(self, *fields: str) -> DataFrame:
        """_id, _ord and the fields (all of them by default) of each row's entity."""
        have = self._s.of(self.kind)
        own = {field_of(c): c for c in have.columns if c not in self._s.reserved(self.kind)}
        df = self.frame().select("_id", "_ord")
        props = have.select(F.col("id").alias("_k"), *((F.col(own[f]) if f in own else F.lit(None).cast("string")).alias(f) for f in fields or own))
        return df.join(props, df["_id"] == props["_k"]).drop("_k")

    def idata(self, *fields: str, flat: bool = False) -> Iterator:
        for r in self.data_frame(*fields).orderBy("_ord").toLocalIterator():
            d = variant.data_of(r, ROW)
            if flat and fields:
                yield [d[f] for f in fields]
            else:
                yield d

    def data(self, *fields: str, flat: bool = False) -> list:
        return list(self.idata(*fields, flat=flat))

    def collect_frame(self, *aliases: str) -> DataFrame:
        """_ord and, for each alias, the id that it is bound to (null if nothing binds it)."""
        return self.frame().select("_ord", *((F.col(f"_a_{a}") if a in self._aliases else F.lit(None).cast("long")).alias(a) for a in aliases))

    def collect(self, *aliases: str) -> list[list]:
        rows = self.collect_frame(*aliases).orderBy("_ord").collect()
        return [[None if r[a] is None else self._s.entity(self._aliases[a], r[a]) for a in aliases] for r in rows]

    def contexts(self) -> Contexts:
        return Contexts(self)

    def sum(self, expr: str | None = None, asc: bool = False):
        from .aggregate import EntityAggregate

        return EntityAggregate.of(self, expr, asc, percent=False)

    def percent(self, expr: str | None = None, asc: bool = False):
        from .aggregate import EntityAggregate

        return EntityAggregate.of(self, expr, asc, percent=True)

    def __contains__(self, entity: object) -> bool:
        if getattr(entity, "kind", None) != self.kind:
            return False
        return not self.counts().filter(F.col("_id") == entity.get_id()).isEmpty()

    # ------------------------------------------------------------------ set algebra

    def __or__(self, other: Traversal) -> Traversal:
        return self._s.graph.union(self, other)

    def __and__(self, other: Traversal) -> Traversal:
        return self._s.graph.intersection(self, other)

    def __sub__(self, other: Traversal) -> Traversal:
        return self._s.graph.difference(self, other)

    def __xor__(self, other: Traversal) -> Traversal:
        return self._s.graph.symmetric_difference(self, other)

    def __le__(self, other: Traversal) -> bool:
        return self._s.graph.issubset(self, other)

    def __ge__(self, other: Traversal) -> bool:
        return self._s.graph.issuperset(self, other)

    # ------------------------------------------------------------------ effects

    def _own_ids(self) -> DataFrame:
        """Checkpointed: a change joins the frames with ids that come from them, and would double its plan otherwise."""
        return durable(self.counts().select(F.col("_id").alias("id")))

    def update(self, **data: object) -> None:
        self._s.graph._update(self.kind, self._own_ids(), data)

    def remove(self) -> None:
        self._s.graph._remove(self.kind, self._own_ids())

    def request(self, name: str, *aliases: str, **params: object):
        return self._s.graph.script(name)(self._s.graph, self.contexts(), *aliases, **params)

    def call(self, name: str, *aliases: str, **params: object) -> None:
        self.request(name, *aliases, **params)

    def dot(self, node_label: str | None = None, edge_label: str | None = None, limit: int = 100):
        from ..sources.export import Dot

        return Dot(self, node_label, edge_label, limit)


class Contexts:
    """What a script sees of a traversal: its rows' aliases, as a frame, or one dict of entities after the other."""

    def __init__(self, t: Traversal):
        self._t, self.kinds = t, dict(t._aliases)

    def frame(self, *aliases: str) -> DataFrame:
        """_ord and the ids of the aliases (all by default)."""
        return self._t.collect_frame(*(aliases or self.kinds))

    def count(self) -> int:
        return self._t.count()

    def __iter__(self) -> Iterator[dict]:
        for r in self.frame().orderBy("_ord").toLocalIterator():
            yield {a: self._t._s.entity(kind, r[a]) for a, kind in self.kinds.items()}


def _numbered(f: Frame) -> Frame:
    """Each row's own ordinal, as the key to draw by."""
    return replace(f, df=f.df.withColumn("_row", F.col("_ord")))


