"""Scripts: functions over a graph and the contexts of a traversal's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..errors import InvalidDataType, UnknownAlias
from ..functions.validate import check_data, solid, type_of
from ..graph import literal
from ..operators.traversal import Contexts


def add_edge(g, contexts: Contexts, source: str, target: str, **data: object) -> None:
    """One edge a row between the entities of two aliases; the rows stay in the cluster."""
    check_data(data)
    for a in (source, target):
        if a not in contexts.kinds:
            raise UnknownAlias(a)
        if contexts.kinds[a] != "v":
            raise InvalidDataType("an edge joins nodes")
    ends = contexts.frame(source, target).orderBy("_ord").select(F.col(source).alias("src"), F.col(target).alias("dst"))
    g.append_edges(ends.select("src", "dst", *(literal(v, solid(type_of([v]))).alias(k) for k, v in data.items())))


def echo(g, contexts: Contexts, *args: object, **params: object) -> list[dict]:
    """The arguments, once a row."""
    return [{"args": list(args), "kwargs": dict(params)} for _ in range(contexts.count())]


BUILT_IN: dict[str, Callable] = {"add_edge": add_edge, "echo": echo}
