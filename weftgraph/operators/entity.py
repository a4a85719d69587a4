"""Handles on single nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import variant
from ..functions.validate import check_data
from .traversal import Traversal


class Entity:
    kind = ""

    def __init__(self, graph, i: int):
        object.__setattr__(self, "_g", graph)
        object.__setattr__(self, "_i", i)

    def get_id(self) -> int:
        return self._i

    def _now(self):
        """The graph's current snapshot, so that updates show."""
        return self._g._snapshot()

    def _row(self):
        return self._now().of(self.kind).filter(F.col("id") == self._i).first()

    def _lift(self) -> Traversal:
        """A one-row traversal."""
        return self._now().scan(self.kind, {"_id": self._i})

    def data(self) -> dict:
        row = self._row()
        return {} if row is None else variant.data_of(row, self._now().reserved(self.kind))

    def get(self, field: str, default: object = None) -> object:
        return self.data().get(field, default)

    def __getattr__(self, field: str) -> object:
        if field.startswith("_"):
            raise AttributeError(field)
        data = self.data()
        if field not in data:
            raise AttributeError(field)
        return data[field]

    def __setattr__(self, field: str, value: object) -> None:
        self._g.update_data(self.kind, self._i, field, value)

    def update(self, **data: object) -> None:
        check_data(data)
        self._g._update_each(self.kind, {self._i: data})

    def remove(self) -> None:
        self._g._remove(self.kind, self._g.spark.createDataFrame([(self._i,)], "id long"))

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self._i == other._i and self._g is other._g

    def __hash__(self) -> int:
        return hash((self.kind, self._i))

    def __repr__(self) -> str:
        return f"<{type(self).__name__} id:{self._i} data:{self.data()}>"

    def aka(self, alias: str) -> Traversal:
        return self._lift().aka(alias)

    def random(self, method: str, *args: object, seed: int | None = None, **filters: object):
        """One neighbour or edge; None where the filters refuse it. IndexError at a dead end."""
        from .. import errors

        if method not in (("inV", "outV", "bothV") if self.kind == "e" else ("inV", "outV", "bothV", "inE", "outE", "bothE")):
            raise errors.UnknownMethod(method)
        now = self._now()
        kind = "e" if method.endswith("E") else "v"
        now.check(kind, filters)
        drawn = self._lift().random(method, seed=seed).ids()
        if not drawn:
            raise IndexError("a dead end")
        if filters and now.scan(kind, {"_id": drawn[0]}).filter(**filters).count() == 0:
            return None
        return now.entity(kind, drawn[0])


def _lifted(name: str):
    def run(self: Entity, *args: object, **filters: object) -> Traversal:
        return getattr(self._lift(), name)(*args, **filters)

    run.__name__ = name
    return run


class Node(Entity):
    kind = "v"


class Edge(Entity):
    kind = "e"


for _name in ("inV", "outV", "bothV", "inE", "outE", "bothE", "in_", "out_", "both_"):
    setattr(Node, _name, _lifted(_name))
for _name in ("inV", "outV", "bothV"):
    setattr(Edge, _name, _lifted(_name))
