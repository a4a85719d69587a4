"""Change sets: additions, updates and removals that are applied together or not at all."""

from __future__ import annotations

from typing import TYPE_CHECKING

from .. import errors
from ..functions.validate import check_data
from .entity import Edge, Entity, Node

if TYPE_CHECKING:
    from ..graph import PropertyGraph


class ChangeSet:
    """Gathers changes to a graph; ``apply`` makes one new snapshot of them. New ids are reserved at once.

    Additions come first, then updates, then removals, which take the incident edges of nodes along, new ones too.
    Of several updates of one field the last counts. A set is applied once; where it fails the graph stays as it was.
    """

    def __init__(self, graph: PropertyGraph):
        self._g, self._applied = graph, False
        self._added: dict[str, list[tuple[dict, dict]]] = {"v": [], "e": []}
        self._updated: dict[str, dict[int, dict]] = {"v": {}, "e": {}}
        self._removed: dict[str, set[int]] = {"v": set(), "e": set()}

    def add_node(self, **data: object) -> Node:
        check_data(data)
        i = self._g._fresh("v", 1)
        self._added["v"].append(({"id": i}, data))
        return Node(self._g, i)

    def add_edge(self, source: Node, target: Node, **data: object) -> Edge:
        if not isinstance(source, Node) or not isinstance(target, Node):
            raise errors.InvalidDataType("an edge joins nodes")
        check_data(data)
        i = self._g._fresh("e", 1)
        self._added["e"].append(({"id": i, "src": source.get_id(), "dst": target.get_id()}, data))
        return Edge(self._g, i)

    def update(self, entity: Entity, **data: object) -> None:
        check_data(data)
        self._updated[entity.kind].setdefault(entity.get_id(), {}).update(data)

    def remove(self, entity: Entity) -> None:
        self._removed[entity.kind].add(entity.get_id())

    def merge(self, other: ChangeSet) -> None:
        """The changes of another set of the same graph, after those of this one."""
        if other._g is not self._g:
            raise errors.DataError("sets of different graphs")
        for kind in "ve":
            self._added[kind] += other._added[kind]
            for i, data in other._updated[kind].items():
                self._updated[kind].setdefault(i, {}).update(data)
            self._removed[kind] |= other._removed[kind]

    def apply(self) -> None:
        if self._applied:
            raise errors.DataError("a change set is applied once")
        g, before = self._g, self._g._state()
        try:
            own = {k["id"] for k, _ in self._added["v"]}
            g._check_nodes({k[end] for k, _ in self._added["e"] for end in ("src", "dst")} - own)
            for kind in "ve":
                g._add(kind, self._added[kind])
            for kind in "ve":
                if self._updated[kind]:
                    g._update_each(kind, self._updated[kind])
            for kind in "ev":
                if self._removed[kind]:
                    g._remove(kind, g.spark.createDataFrame([(i,) for i in self._removed[kind]], "id long"))
        except BaseException:
            g._restore(before)
            raise
        self._applied = True

    def __enter__(self) -> ChangeSet:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.apply()
