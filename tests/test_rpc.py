import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.plans.rpc import Server, capabilities
from tessera.sources.graph import Graph


@pytest.fixture
def server(spark, tmp_path):
    return Server(Graph(spark, "/root/testdata/sf0.001"), (tmp_path / "queue").as_uri())


def call(server, capability, **args):
    result = server.handle({"id": 1, "method": "tools/call", "params": {"name": "execute", "arguments": {"capability": capability, "args": args}}})["result"]
    return result.get("isError", False), result["content"][0]["text"]


def test_protocol(server):
    assert server.handle({"method": "notifications/initialized"}) is None
    assert server.handle({"id": 2, "method": "ping"}) == {"jsonrpc": "2.0", "id": 2, "result": {}}
    assert server.handle({"id": 3, "method": "nope"})["error"]["code"] == -32601
    assert server.handle({"id": 4, "method": "tools/call", "params": {"name": "nope"}})["error"]["code"] == -32602
    assert len(capabilities()) == 9 and [c["name"] for c in capabilities("commitment")] == ["flagPromise"]


def test_reads_and_proposals(server, spark):
    failed, text = call(server, "findNodeByName", name="asia")
    assert not failed and "ASIA" in {n["display_name"] for n in json.loads(text)["nodes"]}
    failed, text = call(server, "getNodeDetails", node_id="N1")
    assert not failed and json.loads(text)["links"]
    assert call(server, "unknown")[0] and call(server, "proposeCreateNode", type="Person")[0]
    assert not call(server, "proposeCreateNode", type="Person", display_name="Ada")[0]
    row = spark.read.parquet(server.queue).first()
    assert (row.kind, row.status, json.loads(row.payload)["display_name"]) == ("proposeCreateNode", "pending", "Ada")


def test_recall_and_odd_arguments(server):
    failed, text = call(server, "recallNodes", query="customer#00000001", limit=2)
    assert not failed and len(json.loads(text)["nodes"]) == 2
    assert call(server, "recallNodes", query=7)[0] and not call(server, "recallNodes", query="asia", limit=[1])[0]
    assert server.handle({"id": 1, "method": 5, "params": "x"})["error"]["code"] == -32601
    assert "result" in server.handle({"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": ["x"]}}})
    assert server.handle({"id": 1, "method": "tools/call", "params": {"name": "execute", "arguments": [1]}})["result"]["isError"]


@pytest.mark.parametrize("a, b, want", [
    ("Ann Lee", "ann lee ", "exact"), ("Bill Ray", "William Ray", "variant"), ("W. Ray", "William Ray", "variant"), ("Bill R.", "William Ray", None),
    ("Ann", "Ann Lee", None), ("Ann Kim Lee", "Ann Lee", "variant"), ("Ann Kim Lee", "Ann Jo Lee", None), ("A. L.", "A. Lee", None), ("", "", None), (None, "Ann Lee", None),
])
def test_name_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(N.name_match(F.col("a"), F.col("b")).alias("m")).first().m == want
