"""The command-list form of queries, a small server for it, and its client.

A query is a list of ``[method, args, kwargs]``, folded over the graph. Values travel as tagged JSON: entities
with kind, id and data, aggregates as pairs, traversals by their rows.
"""

from __future__ import annotations

import json
import logging
import socket
import socketserver
import threading
from collections.abc import Iterable, Iterator, Mapping, Sequence

from ..errors import GraphError, InvalidDataType, MarshallingError, NotInteger, NotIterable, UnmarshallingError
from ..graph import PropertyGraph
from ..operators.aggregate import EntityAggregate
from ..operators.entity import Entity
from ..operators.traversal import Traversal
from ..sources.export import Dot

Commands = Sequence[Sequence]
_LOG = logging.getLogger(__name__)
#: What commands may call, by what they call it on. Files, modules, frames and sessions stay out of reach.
_SETS = frozenset("union intersection difference symmetric_difference issubset issuperset".split())
_MAKE = frozenset("add_node bulk_add_node add_edge bulk_add_edge add_edge_by_ids bulk_add_edge_by_ids".split())
_INDEX = frozenset("add_node_index add_edge_index remove_node_index remove_edge_index get_node_indexes get_edge_indexes".split())
_HOPS = frozenset("inV outV bothV inE outE bothE in_ out_ both_ random aka".split())
_SHAPE = frozenset("filter dedup without limit order_by sum percent".split())
_TAKE = frozenset("count ids all data collect next dot update remove call request".split())
ALLOWED: Mapping[type, frozenset[str]] = {
    PropertyGraph: frozenset(("V", "E", "v", "e")) | _SETS | _MAKE | _INDEX,
    Traversal: _HOPS | _SHAPE | _TAKE,
    EntityAggregate: frozenset(("limit", "entities", "next", "pairs")),
    Entity: _HOPS | frozenset(("get_id", "data", "get", "update", "remove")),
    Dot: frozenset(("to_dot",)),
}


def _may(target: object, name: str) -> bool:
    return any(name in names for kind, names in ALLOWED.items() if isinstance(target, kind))


def replay(graph: PropertyGraph, commands: Commands) -> object:
    """Fold the commands over the graph; lists of command lists in the arguments are replayed first."""
    out: object = graph
    for name, args, kwargs in commands:
        if not _may(out, name):
            raise GraphError(f"{name} can't be called on {type(out).__name__}")
        out = getattr(out, name)(*(operand(graph, a) for a in args), **{k: operand(graph, v) for k, v in kwargs.items()})
    return out


def operand(graph: PropertyGraph, value: object) -> object:
    if isinstance(value, dict) and set(value) == {"_commands"}:
        return replay(graph, value["_commands"])
    if isinstance(value, dict) and set(value) == {"_", "id", "data"}:
        return graph.v(value["id"]) if value["_"] == "v" else graph.e(value["id"])
    if isinstance(value, (list, tuple)):
        return [operand(graph, v) for v in value]
    return value


def marshal(value: object) -> object:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, Entity):
        return {"_": value.kind, "id": value.get_id(), "data": value.data()}
    if isinstance(value, Dot):
        return str(value)
    if isinstance(value, EntityAggregate):
        return [[marshal(e), n] for e, n in value]
    if isinstance(value, Traversal):
        return [marshal(e) for e in value]
    if isinstance(value, dict):
        return {str(k): marshal(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [marshal(v) for v in value]
    raise MarshallingError(type(value).__name__)


def unmarshal(text: bytes | str) -> object:
    try:
        found = json.loads(text)
    except ValueError as e:
        raise UnmarshallingError(str(e)) from e
    if isinstance(found, dict) and "error" in found:
        raise GraphError(found["error"])
    return found["result"] if isinstance(found, dict) and "result" in found else found


def execute(graph: PropertyGraph, request: bytes | str) -> str:
    """One request to one reply; every error becomes a reply too."""
    try:
        return json.dumps({"result": marshal(replay(graph, json.loads(request)))})
    except Exception as e:
        _LOG.exception("a request failed")
        return json.dumps({"error": f"{type(e).__name__}: {e}"})


Address = str | tuple[str, int]


def place(address: Address) -> str | tuple[str, int]:
    """``tcp://host:port`` or ``host:port`` as a pair, ``ipc://path`` as the path of a Unix socket."""
    if not isinstance(address, str):
        return address[0], int(address[1])
    if address.startswith("ipc://"):
        return address.removeprefix("ipc://")
    host, _, port = address.removeprefix("tcp://").rpartition(":")
    return host, int(port)


def serve(graph: PropertyGraph, address: Address) -> socketserver.BaseServer:
    """A server of one thread, one JSON request a line; the caller runs ``serve_forever``. On a Unix socket the line
    ``stop`` ends it, for the process that started it."""
    at = place(address)
    local = isinstance(at, str)

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                if local and line.strip() == b"stop":
                    self.wfile.write(b"ok\n")
                    threading.Thread(target=self.server.shutdown, daemon=True).start()
                    return
                self.wfile.write(execute(graph, line).encode() + b"\n")

    kind = socketserver.UnixStreamServer if local else type("Server", (socketserver.TCPServer,), {"allow_reuse_address": True})
    return kind(at, Handler)


def connected(address: Address) -> socket.socket:
    at = place(address)
    if not isinstance(at, str):
        return socket.create_connection(at)
    s = socket.socket(socket.AF_UNIX)
    s.connect(at)
    return s


def stop(address: str) -> str:
    """Ends the server at an ``ipc://`` address."""
    with connected(address) as s:
        s.sendall(b"stop\n")
        return s.makefile("r").readline().strip()


_COUNTS = frozenset(("limit", "inV", "outV", "bothV", "in_", "out_", "both_"))


class Client:
    """Gathers commands; ``run`` sends them. ``Client(address).V(kind='part').outV().run('count')``."""

    def __init__(self, address: Address, commands: Iterable = ()):
        self._address, self._commands = address, list(commands)

    def __iter__(self) -> Iterator:
        found = self.run()
        if not isinstance(found, list):
            raise NotIterable(type(found).__name__)
        return iter(found)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)

        def add(*args: object, **kwargs: object) -> Client:
            if name in _COUNTS and any(type(a) is not int for a in args):
                raise NotInteger(f"{name}{args}")
            return Client(self._address, [*self._commands, self._command(name, args, kwargs)])

        return add

    @classmethod
    def _plain(cls, value: object) -> object:
        if isinstance(value, Client):
            return {"_commands": value._commands}
        if isinstance(value, (list, set, frozenset, tuple)):
            return [cls._plain(v) for v in value]
        if isinstance(value, dict):
            return {str(k): cls._plain(v) for k, v in value.items()}
        if not isinstance(value, (str, int, float, bool, type(None))):
            raise InvalidDataType(type(value).__name__)
        return value

    @classmethod
    def _command(cls, name: str, args: Iterable, kwargs: Mapping) -> list:
        return [name, [cls._plain(a) for a in args], {k: cls._plain(v) for k, v in kwargs.items()}]

    def run(self, name: str | None = None, *args: object, **kwargs: object) -> object:
        commands = [*self._commands, self._command(name, args, kwargs)] if name else self._commands
        with connected(self._address) as s:
            s.sendall(json.dumps(commands).encode() + b"\n")
            return unmarshal(s.makefile("rb").readline())
