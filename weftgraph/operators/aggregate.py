"""Occurrence sums and percentages by entity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as language
from ..functions.validate import column_of

if TYPE_CHECKING:
    from .traversal import Traversal


class EntityAggregate:
    """(entity, number) pairs ordered by number (descending by default), ties in first-seen order."""

    def __init__(self, snapshot, kind: str, df: DataFrame, asc: bool, top: int | None = None):
        self._s, self._kind, self._df, self._asc, self._top = snapshot, kind, df, asc, top

    @classmethod
    def of(cls, t: Traversal, text: str | None, asc: bool, percent: bool) -> EntityAggregate:
        s, kind = t._s, t.kind
        if text is None:
            df = t.counts().select("_id", "_ord", F.col("_m").alias("_v"))
        else:
            node = language.parse(text)
            fields, pairs = language.names(node)
            types: dict = {}

            def attach(df: DataFrame, key: str, of_kind: str, names: set[str], tag: str) -> DataFrame:
                have = s.of(of_kind)
                own = sorted(n for n in names if column_of(n) in have.columns)
                types.update({(tag, n): have.schema[column_of(n)].dataType for n in own})
                if not own:
                    return df
                props = have.select(F.col("id").alias("_k"), *(F.col(column_of(n)).alias(f"{tag}{n}") for n in own))
                return df.join(props, df[key] == props["_k"], "left").drop("_k")

            by_rows = bool(pairs)
            df = attach(t.frame() if by_rows else t.counts(), "_id", kind, fields, "_p_")
            for a in sorted({a for a, _ in pairs}):
                if a in t._aliases:
                    df = attach(df, f"_a_{a}", t._aliases[a], {f for x, f in pairs if x == a}, f"_q_{a}_")

            def look(tag: str, n: str):
                return (F.col(f"{tag}{n}"), types[tag, n]) if (tag, n) in types else None

            value, number = language.build(node, lambda n: look("_p_", n), lambda a, n: look(f"_q_{a}_", n))
            value = value if by_rows else value * F.col("_m")
            df = df.groupBy("_id").agg(F.min("_ord").alias("_ord"), F.sum(value).cast("long" if number == "int" else "double").alias("_v"))
        if percent:
            total = df.agg(F.sum("_v").cast("double")).scalar()
            df = df.withColumn("_total", total).select("_id", "_ord", F.when(F.col("_total") == 0, F.col("_v").cast("double")).otherwise(F.expr("try_divide(cast(_v AS double), _total)")).alias("_v"))
        return cls(s, kind, df, asc)

    def _sorted(self) -> DataFrame:
        df = self._df.orderBy(F.col("_v").asc() if self._asc else F.col("_v").desc(), "_ord")
        return df if self._top is None else df.limit(self._top)

    def frame(self) -> DataFrame:
        """id, value; in order where a limit is set."""
        return (self._df if self._top is None else self._sorted()).select(F.col("_id").alias("id"), F.col("_v").alias("value"))

    def limit(self, n: int) -> EntityAggregate:
        """The first n pairs: a top-k that no full sort precedes."""
        return EntityAggregate(self._s, self._kind, self._df, self._asc, n if self._top is None else min(n, self._top))

    def entities(self) -> Traversal:
        """A traversal over the entities in the aggregate's order."""
        from .traversal import Traversal

        ranked = self._sorted().select("_id", F.array(F.monotonically_increasing_id()).alias("_ord"))
        return Traversal(self._s, ranked, self._kind)

    def __iter__(self) -> Iterator[tuple]:
        for r in self._sorted().select("_id", "_v").collect():
            yield self._s.entity(self._kind, r[0]), r[1]

    def pairs(self) -> list[tuple[int, float]]:
        return [(r[0], r[1]) for r in self._sorted().select("_id", "_v").collect()]

    def next(self):
        it = self.__dict__.setdefault("_cursor", iter(self))
        try:
            return next(it)
        except StopIteration:
            del self.__dict__["_cursor"]
            raise

    __next__ = next
