"""Questions about one graph as text answers, served to the command line and over JSON-RPC lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import CHARS_A_TOKEN
from .operators import answers as an
from .operators import rank, traverse
from .schema import CodeGraph

# The protocol's error codes and version, and the longest answer in tokens.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602
PROTOCOL_VERSION = "2024-11-05"
MOST_TOKENS = 1500
NAME = "weftgraph"


class Unanswered(Exception):
    """A question that names nothing, or too much; the message says what to ask instead."""


def capped(text: str, tokens: int = MOST_TOKENS) -> str:
    """Whole lines within the token limit, with a notice where lines are left out."""
    if len(text) <= tokens * CHARS_A_TOKEN:
        return text
    return text[: int(tokens * CHARS_A_TOKEN)].rpartition("\n")[0] + "\n… truncated"


@dataclass
class Tool:
    run: Callable[..., str]
    about: str
    takes: dict[str, str]
    needs: tuple[str, ...] = field(default=())

    def schema(self) -> dict:
        return {"type": "object", "properties": {k: {"type": t} for k, t in self.takes.items()}, **({"required": list(self.needs)} if self.needs else {})}


class Service:
    """The tools over a graph whose tables are read once and kept by the session."""

    def __init__(self, graph: CodeGraph):
        self.graph = CodeGraph(graph.nodes.persist(), graph.edges.persist())
        symbol, depth = {"symbol": "string"}, {"depth": "number"}
        self.tools = {
            "repo_map": Tool(self.repo_map, "The symbols most depended on, by file, within a token budget.", {"budget": "number"}),
            "find_symbol": Tool(self.find_symbol, "Declarations whose name contains a text.", {"pattern": "string"}, ("pattern",)),
            "callers": Tool(self.callers, "What calls a symbol, over any number of steps or a given depth.", symbol | depth, ("symbol",)),
            "callees": Tool(self.callees, "What a symbol calls, over any number of steps or a given depth.", symbol | depth, ("symbol",)),
            "importers": Tool(self.importers, "Modules that import a module, over any number of steps.", {"module": "string"}, ("module",)),
            "slice": Tool(self.slice, "What surrounds a symbol, one step away unless a depth is given.", symbol | depth, ("symbol",)),
            "path": Tool(self.path, "The shortest way of calls and imports between two symbols.", {"from": "string", "to": "string"}, ("from", "to")),
            "impact": Tool(self.impact, "What a unified diff changes and what reaches it.", {"diff": "string"} | depth, ("diff",)),
        }

    def close(self) -> None:
        self.graph.nodes.unpersist()
        self.graph.edges.unpersist()

    def call(self, name: str, given: dict) -> str:
        tool = self.tools[name]
        kinds = {"string": str, "number": (int, float)}
        for k in tool.needs:
            if given.get(k) is None:
                raise Unanswered(f"{name} needs {k}")
        for k, v in given.items():
            if k in tool.takes and v is not None and (not isinstance(v, kinds[tool.takes[k]]) or isinstance(v, bool)):
                raise Unanswered(f"{k} must be a {tool.takes[k]}")
        return capped(tool.run(**{k + "_": v for k, v in given.items() if k in tool.takes and v is not None}))

    def _one(self, ref: str, find=an.resolve_symbol) -> str:
        rows = find(self.graph.nodes, ref).orderBy("id").limit(an.SUGGESTIONS + 1).collect()
        ids = [r["id"] for r in rows]
        if not rows or rows[0].asDict().get("status") == "suggestion":
            raise Unanswered(f"no symbol named {ref}" + (f"; did you mean {', '.join(ids)}" if ids else ""))
        if len(rows) > 1:
            raise Unanswered(f"{ref} is ambiguous: {', '.join(ids)}")
        return ids[0]

    def _module(self, ref: str) -> str:
        return self._one(ref, an.resolve_module)

    def _listed(self, nodes: DataFrame) -> str:
        """By file; only as many lines as an answer can hold are fetched."""
        rows = an.group_by_file(nodes).orderBy("file").limit(int(MOST_TOKENS * CHARS_A_TOKEN)).toLocalIterator()
        out, size = [], 0
        for r in rows:
            part = "\n".join([r["file"], *("  " + s for s in r["symbols"].split("\n"))])
            out.append(part)
            size += len(part)
            if size > MOST_TOKENS * CHARS_A_TOKEN:
                break
        return "\n".join(out) or "(none)"

    def _reached(self, start: str, hit: DataFrame, what: str) -> str:
        found = self.graph.nodes.join(hit.where(F.col("id") != start).select("id"), "id", "left_semi")
        return f"{found.count()} {what} of {start}\n{self._listed(found)}"

    def repo_map(self, budget_: float = 2000) -> str:
        rows = an.repo_map(self.graph, rank.pagerank(self.graph), int(budget_)).orderBy("pos").collect()
        files: dict[str, list[str]] = {}
        for r in rows:
            files.setdefault(r["file"], []).append(r["line"])
        total = an.listable(self.graph.nodes).count()
        return "\n".join([f"# repo map · {len(files)} files · {len(rows)}/{total} symbols", *("\n".join([f, *lines]) for f, lines in files.items())])

    def find_symbol(self, pattern_: str) -> str:
        found = an.definitions(self.graph.nodes, pattern_)
        n = found.count()
        if not n:
            raise Unanswered(f"no declaration matches {pattern_}")
        return f"{n} declarations match {pattern_}\n{self._listed(found)}"

    def callers(self, symbol_: str, depth_: float | None = None) -> str:
        at = self._one(symbol_)
        return self._reached(at, traverse.reach(self.graph, [at], ("calls",), None if depth_ is None else int(depth_), True), "callers")

    def callees(self, symbol_: str, depth_: float | None = None) -> str:
        at = self._one(symbol_)
        return self._reached(at, traverse.reach(self.graph, [at], ("calls",), None if depth_ is None else int(depth_)), "callees")

    def importers(self, module_: str) -> str:
        at = self._module(module_)
        return self._reached(at, an.importers(self.graph, at), "importers")

    def slice(self, symbol_: str, depth_: float = 1) -> str:
        at = self._one(symbol_)
        near = traverse.slice_around(self.graph, at, int(depth_))
        return f"{near.nodes.count()} nodes around {at}\n{self._listed(near.nodes)}"

    def path(self, from_: str, to_: str) -> str:
        a, b = self._one(from_), self._one(to_)
        return an.path_text(self.graph.nodes, traverse.shortest_path(self.graph, a, b)).first()["path"] or f"no path from {a} to {b}"

    def impact(self, diff_: str, depth_: float = 2) -> str:
        one = self.graph.nodes.sparkSession.createDataFrame([(1, diff_)], "diff_id int, text string")
        hit = an.impact(self.graph, an.parse_diff(one).select("file", "line"), int(depth_)).persist()
        try:
            parts = []
            for title, which in (("changed", "role = 'changed'"), ("reached", "role = 'reached' and not is_test"), ("tests", "role = 'reached' and is_test")):
                nodes = self.graph.nodes.join(hit.where(which).select("id"), "id", "left_semi")
                parts.append(f"{title}: {nodes.count()}\n{self._listed(nodes)}")
            return "no analyzable symbols changed" if parts[0].startswith("changed: 0") else "\n".join(parts)
        finally:
            hit.unpersist()


def respond(service: Service, message) -> dict | None:
    """The reply to one JSON-RPC message; notifications have none."""
    valid = isinstance(message, dict) and message.get("jsonrpc") == "2.0" and isinstance(message.get("method"), str)
    key = message.get("id") if isinstance(message, dict) else None
    key = key if isinstance(key, (str, int, float)) and not isinstance(key, bool) else None
    error = lambda code, text: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}
    result = lambda value: {"jsonrpc": "2.0", "id": key, "result": value}
    if not valid:
        return error(INVALID_REQUEST, "not a JSON-RPC 2.0 request")
    if "id" not in message:
        return None
    params = message.get("params") if isinstance(message.get("params"), dict) else {}
    if message["method"] == "initialize":
        return result({"protocolVersion": PROTOCOL_VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": "1"}})
    if message["method"] == "ping":
        return result({})
    if message["method"] == "tools/list":
        return result({"tools": [{"name": n, "description": t.about, "inputSchema": t.schema()} for n, t in service.tools.items()]})
    if message["method"] != "tools/call":
        return error(METHOD_NOT_FOUND, f"no method {message['method']}")
    name = params.get("name")
    if not isinstance(name, str) or name not in service.tools:
        return error(INVALID_PARAMS, f"no tool {name}")
    given = params.get("arguments")
    try:
        return result({"content": [{"type": "text", "text": service.call(name, given if isinstance(given, dict) else {})}]})
    except (Unanswered, KeyError, ValueError) as why:
        return result({"content": [{"type": "text", "text": str(why)}], "isError": True})


def serve(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """One reply a line for one message a line; blank lines are skipped."""
    for line in lines:
        if line.strip():
            try:
                reply = respond(service, json.loads(line))
            except (json.JSONDecodeError, RecursionError):
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}}
            if reply is not None:
                yield json.dumps(reply, ensure_ascii=False)
