"""Command lists, marshalling, the server with its client, scripts, settings and the stream of edges."""

import json
import threading

import pytest

from weftgraph import errors
from weftgraph.__main__ import settings
from weftgraph.plans import commands
from weftgraph.streaming.edges import degrees, enriched


def test_replay(trio):
    assert commands.replay(trio, [["V", [], {"name": "Ada"}], ["outV", [2], {}], ["ids", [], {}]]) == [2]
    for name in ("_now", "spark", "__class__", "write", "save", "setup_server_scripts", "nx_graph", "close", "append_nodes"):
        with pytest.raises(errors.GraphError):
            commands.replay(trio, [[name, [], {}]])
    for chain in (["frame", "count"], ["counts", "count"], ["dot", "frames"], ["ids", "append"]):
        with pytest.raises(errors.GraphError):
            commands.replay(trio, [["V", [], {}], *([name, [], {}] for name in chain)])


def test_marshal(trio):
    assert commands.marshal([trio.v(1), {"a": {1}}, None]) == [{"_": "v", "id": 1, "data": {"rank": 1, "age": 30, "name": "Bo"}}, {"a": [1]}, None]
    with pytest.raises(errors.MarshallingError):
        commands.marshal(object())
    with pytest.raises(errors.UnmarshallingError):
        commands.unmarshal(b"{")
    with pytest.raises(errors.GraphError):
        commands.unmarshal(json.dumps({"error": "x"}))


def test_execute_answers_errors(trio):
    assert "InvalidLookup" in json.loads(commands.execute(trio, json.dumps([["V", [], {"a__nope": 1}]])))["error"]
    assert "error" in json.loads(commands.execute(trio, "no json"))


def test_server_and_client(trio):
    with commands.serve(trio, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        far = commands.Client(server.server_address)
        try:
            assert far.V(rank=1).run("count") == 2
            assert far.V(name="Ada").outV().run("all")[0]["id"] == 1
            assert far.V(name="Bo").sum().run() == [[{"_": "v", "id": 1, "data": {"rank": 1, "age": 30, "name": "Bo"}}, 1]]
            assert far.union(far.V(name="Ada"), far.V(name="Cy")).run("ids") == [0, 2]
            assert far.V().dot(limit=1).run().startswith("digraph")
            made = far.add_node(name="New").run()
            assert made["data"] == {"name": "New"}
            assert far.add_edge(made, {"_": "v", "id": 0, "data": {}}).run()["_"] == "e"
            assert trio.V(name="New").outV().ids() == [0]
            with pytest.raises(errors.GraphError, match="MixedKind"):
                far.union(far.V(), far.E()).run("ids")
            with pytest.raises(errors.InvalidDataType):
                far.V(name=object()).run()
            with pytest.raises(errors.InvalidDataType):
                far.V(name__in=[{"deep": (object(),)}]).run()
            assert far.V(name__in={"Ada", "Cy"}).run("ids") == [0, 2]
            assert far.V().run("next")["id"] == 0
            with pytest.raises(errors.GraphError, match="can't be called") as refused:
                far.V().frame().run("count")
            assert "Traceback" not in str(refused.value)
        finally:
            server.shutdown()


def test_scripts(trio):
    t = trio.V(name="Ada").aka("x").outV(2).aka("y")
    assert t.request("echo", "x", k=1) == [{"args": ["x"], "kwargs": {"k": 1}}]
    assert t.call("add_edge", "x", "y", label="far") is None
    assert trio.E(label="far").bothV().ids() == [0, 2]
    with pytest.raises(errors.UnknownScript):
        t.request("nope")
    trio.setup_server_scripts("weftgraph.plans.scripts")
    assert len(t.request("echo")) == 1


def test_settings(tmp_path):
    ini = tmp_path / "own.ini"
    ini.write_text("[server]\naddress = 0.0.0.0:1\n[backend]\npath = /store\nkeep = 2\n[scripts]\nmodules = a b\n")
    own = settings(["-c", str(ini)])
    assert (own.address, own.backend, own.scripts, own.params) == ("0.0.0.0:1", "/store", ["a", "b"], {"keep": "2"})
    own = settings(["-c", str(ini), "-a", "h:2", "-b", "/x", "-s", "m", "-p", "keep:3"])
    assert own.params == {"keep": "3"}
    assert (own.address, own.backend, own.scripts) == ("h:2", "/x", ["m"])
    assert settings([]).address == "127.0.0.1:5555"


def test_stream_of_edges(trio, spark, tmp_path):
    shape = "src long, dst long, at timestamp"
    for i, line in enumerate(("0,1,2024-01-01 00:00:01", "0,2,2024-01-01 00:00:02", "1,2,2024-01-01 00:09:00")):
        (tmp_path / f"{i}.csv").write_text(line + "\n")
    stream = spark.readStream.schema(shape).csv(str(tmp_path))
    for name, df, mode in (("joined", enriched(stream, trio, "name"), "append"), ("counted", degrees(stream, "at"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted((r["src_name"], r["dst_name"]) for r in spark.table("joined").collect()) == [("Ada", "Bo"), ("Ada", "Cy"), ("Bo", "Cy")]
    assert sorted((r["src"], r["edges"]) for r in spark.table("counted").collect()) == [(0, 2), (1, 1)]


def test_local_socket_and_client_errors(trio, tmp_path):
    address = f"ipc://{tmp_path}/own.sock"
    with commands.serve(trio, address) as server:
        running = threading.Thread(target=server.serve_forever, daemon=True)
        running.start()
        far = commands.Client(address)
        assert [e["id"] for e in far.V(rank=1)] == [0, 1]
        with pytest.raises(errors.NotIterable):
            list(far.V().count())
        with pytest.raises(errors.NotInteger):
            far.V().limit("2")
        assert commands.stop(address) == "ok"
        running.join(20)
        assert not running.is_alive()


def test_scripts_check_their_aliases(trio):
    t = trio.V(name="Ada").aka("x").outE().aka("y")
    with pytest.raises(errors.InvalidDataType):
        t.call("add_edge", "x", "y")
    with pytest.raises(errors.UnknownAlias):
        t.call("add_edge", "x", "z")


def test_addresses():
    assert commands.place("tcp://h:1") == commands.place("h:1") == commands.place(("h", "1")) == ("h", 1)
    assert commands.place("ipc:///tmp/s") == "/tmp/s"
