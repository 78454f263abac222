"""JSON-RPC front of the graph: two tools, `search` over the capabilities and `execute` of one. Reads run Spark plans and
return rows; whatever writes becomes a row of the proposal queue, an append-only parquet table."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recall
from ..operators.structured import Store
from ..sources.graph import NOW, Graph

#: Capability -> (what it does, required arguments).
READS = {
    "findNodeByName": ("Nodes whose name holds a text, with the quality of the match", ["name"]),
    "recallNodes": ("Nodes that a question's words point to", ["query"]),
    "getNodeDetails": ("One node's attributes and links", ["node_id"]),
}
WRITES = {
    "proposeCreateNode": ("Propose a new node", ["type", "display_name"]),
    "proposeCreateLink": ("Propose a typed link between two nodes", ["link_type", "source", "target"]),
    "proposeAddDetail": ("Propose one more attribute value of a node", ["node_id", "detail_name", "value"]),
    "proposeAddLinkDetail": ("Propose the value of a link's detail", ["link_id", "detail_name", "value"]),
    "proposeEditNode": ("Propose a new name or another value for a node", ["node_id", "edits"]),
    "flagPromise": ("Propose a commitment to keep track of", ["direction", "description", "target"]),
}
#: Error codes of JSON-RPC.
NO_METHOD, BAD_PARAMS = -32601, -32602


def capabilities(query: str | None = None) -> list[dict]:
    """All capabilities, or those whose name or description holds one of the query's words."""
    words = query.lower().split() if isinstance(query, str) else []
    every = [{"name": n, "description": d, "required": r} for n, (d, r) in {**READS, **WRITES}.items()]
    return [c for c in every if not words or any(w in f"{c['name']} {c['description']}".lower() for w in words)]


@dataclass
class Server:
    graph: Graph
    queue: str  # path of the proposals, in a store that the executors share
    user: str = "user"

    def handle(self, message: dict) -> dict | None:
        """The answer to one message; None for a notification."""
        method, params = message.get("method"), message.get("params")
        method, params = method if isinstance(method, str) else "", params if isinstance(params, dict) else {}
        if method.startswith("notifications/"):
            return None
        reply = {"jsonrpc": "2.0", "id": message.get("id")}
        if method == "initialize":
            return reply | {"result": {"capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "tessera"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": "search"}, {"name": "execute"}]}}
        if method != "tools/call":
            return reply | {"error": {"code": NO_METHOD, "message": f"Method not found: {method or '(none)'}"}}
        given = params.get("arguments")
        given = given if isinstance(given, dict) else {}
        if params.get("name") == "search":
            return reply | {"result": self._text({"capabilities": capabilities(given.get("query"))})}
        if params.get("name") != "execute":
            return reply | {"error": {"code": BAD_PARAMS, "message": f"Unknown tool: {params.get('name')}"}}
        try:
            args = given.get("args")
            return reply | {"result": self._text(self.execute(given.get("capability"), args if isinstance(args, dict) else {}))}
        except (KeyError, ValueError) as e:
            return reply | {"result": self._text(str(e.args[0])) | {"isError": True}}

    @staticmethod
    def _text(payload) -> dict:
        return {"content": [{"type": "text", "text": payload if isinstance(payload, str) else json.dumps(payload, default=str)}]}

    def execute(self, name: str | None, args: dict) -> dict:
        known = {**READS, **WRITES}
        if not isinstance(name, str) or name not in known:
            raise KeyError(f"Unknown capability: {name}")
        bad = [a for a in ("query", "name", "type", "node_id") if name in READS and a in args and not isinstance(args[a], str)]
        if bad:
            raise ValueError(f"Not a text: {', '.join(bad)}")
        missing = [a for a in known[name][1] if args.get(a) in (None, "")]
        if missing:
            raise ValueError(f"Missing: {', '.join(missing)}")
        if name in WRITES:
            return self.propose(name, args)
        return {k: [r.asDict() for r in df.collect()] for k, df in self.read(name, args).items()}

    def read(self, name: str, args: dict) -> dict[str, DataFrame]:
        """Every frame is bounded: by its limit, by one node's attributes, or by the cap on links of a direction."""
        g = self.graph
        if name == "findNodeByName":
            nodes = g.nodes().where(F.col("type") == args["type"]) if args.get("type") else g.nodes()
            return {"nodes": recall.by_name(nodes, args["name"])}
        if name == "recallNodes":
            limit = args.get("limit", 8)
            store = Store(g.nodes(), g.links(), g.attributes(), g.entries())
            return {"nodes": recall.recall_nodes(store, args["query"], limit if isinstance(limit, (int, float)) else 8, "keyword", touches=g.interactions(), now=datetime.fromisoformat(NOW))}
        own = g.spark.createDataFrame([(args["node_id"],)], "id string")
        return {"details": g.attributes().where(F.col("node_id") == args["node_id"]), "links": recall.expand_links(g.links(), g.nodes(), own)}

    def propose(self, kind: str, payload: dict) -> dict:
        row = self.graph.spark.createDataFrame([(self.user, kind, json.dumps(payload), "pending")], "user_id string, kind string, payload string, status string")
        row.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.queue)
        return {"proposed": kind, "status": "pending"}
