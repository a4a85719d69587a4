"""``python -m weftgraph -a ADDRESS -b STORE -p NAME:VALUE -c FILE -s MODULE``: serve a stored graph.

An address is ``HOST:PORT``, ``tcp://HOST:PORT`` or ``ipc://PATH``. An INI file may give ``[server] address``, ``[backend]``
with ``path`` and the store's parameters, and ``[scripts] modules``; the command line wins.
"""

from __future__ import annotations

import argparse
import configparser

from pyspark.sql import SparkSession

from .plans.commands import serve
from .sources.files import ParquetStore


def settings(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("-a", "--address")
    p.add_argument("-b", "--backend")
    p.add_argument("-p", "--params", nargs="*", default=[], metavar="NAME:VALUE", help="parameters of the store, such as keep:3")
    p.add_argument("-c", "--config")
    p.add_argument("-s", "--scripts", nargs="*")
    own = p.parse_args(argv)
    ini = configparser.ConfigParser()
    if own.config:
        ini.read(own.config)
    stored = dict(ini["backend"]) if ini.has_section("backend") else {}
    own.address = own.address or ini.get("server", "address", fallback="127.0.0.1:5555")
    own.backend = own.backend or stored.get("path")
    own.params = {k: v for k, v in stored.items() if k != "path"} | dict(x.split(":", 1) for x in own.params)
    own.scripts = own.scripts if own.scripts is not None else ini.get("scripts", "modules", fallback="").split()
    return own


def main(argv: list[str] | None = None) -> None:
    own = settings(argv)
    store = ParquetStore(own.backend, **own.params)
    graph = store.load(SparkSession.builder.appName("weftgraph").getOrCreate())
    graph.setup_server_scripts(*own.scripts)
    with serve(graph, own.address) as server:
        server.serve_forever()


if __name__ == "__main__":
    main()
