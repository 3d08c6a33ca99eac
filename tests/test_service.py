"""Answers, JSON-RPC, the command line, layout and drawn exports, transcripts."""

import json
import xml.etree.ElementTree as ET

import pytest

from weftgraph.__main__ import main, options
from weftgraph.export import diagrams as dg
from weftgraph.export import text as ex
from weftgraph.frontends.python import analyze
from weftgraph.operators import evaluation as ev
from weftgraph.operators import layout as lo
from weftgraph.service import Service, Unanswered, capped, respond, serve

FILES = [("pkg/__init__.py", ""), ("pkg/a.py", "from .b import run\n\nclass A:\n    def go(self):\n        run()\n\ndef top():\n    run()\n"), ("pkg/b.py", "def run():\n    inner()\n\ndef inner():\n    pass\n")]


@pytest.fixture(scope="module")
def service(spark):
    s = Service(analyze(spark.createDataFrame(FILES, "path string, text string"))[0])
    yield s
    s.close()


def test_answers(service):
    assert service.call("repo_map", {}).startswith("# repo map · 2 files")
    assert "fn inner" in service.call("find_symbol", {"pattern": "INN"})
    assert service.call("callees", {"symbol": "run"}).startswith("1 callees of function:pkg/b.py#run")
    assert service.call("importers", {"module": "pkg/b.py"}).startswith("1 importers")
    assert service.call("path", {"from": "run", "to": "inner"}) == "run → inner"
    assert service.call("path", {"from": "inner", "to": "run"}).startswith("no path")
    assert "fn run" in service.call("slice", {"symbol": "inner"})
    diff = "--- a/pkg/b.py\n+++ b/pkg/b.py\n@@ -5 +5 @@\n-    pass\n+    return\n"
    assert service.call("impact", {"diff": diff}).startswith("changed: 1\npkg/b.py\n  fn inner")
    assert service.call("impact", {"diff": ""}) == "no analyzable symbols changed"
    for name, given in (("callers", {"symbol": "nope"}), ("callers", {}), ("callers", {"symbol": 3}), ("find_symbol", {"pattern": "zzz"})):
        with pytest.raises(Unanswered):
            service.call(name, given)


def test_long_answers_keep_whole_lines():
    out = capped("\n".join(["x" * 9] * 1000), 100)
    assert out.endswith("x\n… truncated") and len(out) < 390 and capped("short") == "short"


def test_protocol(service):
    ask = lambda **m: respond(service, {"jsonrpc": "2.0", **m})
    assert ask(id=1, method="initialize")["result"]["serverInfo"]["name"] == "weftgraph"
    assert len(ask(id=1, method="tools/list")["result"]["tools"]) == 8
    assert ask(method="ping") is None and ask(id="p", method="ping") == {"jsonrpc": "2.0", "id": "p", "result": {}}
    assert ask(id=1, method="nope")["error"]["code"] == -32601
    assert ask(id=1, method="tools/call", params={"name": "nope"})["error"]["code"] == -32602
    assert respond(service, [])["error"]["code"] == -32600
    assert ask(id=1, method="tools/call", params={"name": "callers", "arguments": {"symbol": "nope"}})["result"]["isError"]
    replies = [json.loads(x) for x in serve(service, ["", "{", '{"jsonrpc":"2.0","id":2,"method":"ping"}'])]
    assert replies[0]["error"]["code"] == -32700 and replies[1]["id"] == 2


def test_command_line(spark, tmp_path, capsys):
    for p, t in FILES:
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    with pytest.raises(SystemExit) as usage:
        main(["query", "path", "a"])
    assert usage.value.code == 2
    assert main(["--root", str(tmp_path), "query", "callers", "inner"]) == 0
    assert "1 callers of function:pkg/b.py#inner" in capsys.readouterr().out
    assert main(["--root", str(tmp_path), "query", "callers", "nope"]) == 1
    assert options().parse_args(["export", "svg"]).format == "svg"


def test_layout_layers_and_drawings(service):
    boxes = [lo.Box(i, i, "fn", lo.leaf_width(i)) for i in "abcd"]
    made = lo.place(boxes, [("calls:a->b", "calls", "a", "b"), ("calls:b->c", "calls", "b", "c"), ("calls:c->a", "calls", "c", "a"), ("calls:d->d", "calls", "d", "d")])
    assert made.boxes["a"].x < made.boxes["b"].x < made.boxes["c"].x and len(made.lines) == 3 and made.aspect_ratio > 0
    assert lo.leaf_width("") == 72 and lo.leaf_width("x" * 7) == 81
    spots = [(b.x, b.y) for b in made.boxes.values()]
    assert len(set(spots)) == len(spots)
    empty = lo.place([], [])
    assert empty.aspect_ratio == 0 and ET.fromstring(dg.svg(empty)) is not None
    for name in ("svg", "drawio"):
        ET.fromstring(ex.BUILTIN.by_id[name](service.graph))
    assert "class A" in dg.to_plantuml_class(service.graph).replace('"', "") and "+go" in dg.to_mermaid_class(service.graph)
    with pytest.raises(ValueError):
        lo.layout(service.graph, most=1)


def test_transcripts_never_guess(spark):
    rows = [
        (1, None), (2, "{"), (3, '"plain"'), (4, "[]"), (5, '{"usage":{"input_tokens":"7"},"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}'),
        (6, '[{"type":"tool_use","x":[{"type":"tool_use"}]},{"type":"result","result":"done","usage":{"inputTokens":2,"cache_read_input_tokens":5}},{"type":"other"}]'),
        (7, '{"result":{"usage":{"output_tokens":0}}}'), (8, "[" * 5000),
    ]
    got = {r["run"]: tuple(r)[1:] for r in ev.read_transcripts(spark.createDataFrame(rows, "run long, text string")).collect()}
    nothing = (None, None, None, 0, "")
    assert [got[k] for k in (1, 2, 4, 8)] == [nothing] * 4
    assert got[3] == (None, None, None, 0, "plain") and got[5] == (None, None, None, 0, "a\nb")
    assert got[6] == (2, None, 7, 2, "done") and got[7] == (None, 0, 0, 0, "")
