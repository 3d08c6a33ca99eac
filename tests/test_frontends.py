"""The Python front-end, exporters, discovery and the change stream on small programs."""

import json

import pytest

from weftgraph.export import text as ex
from weftgraph.frontends.python import analyze, facts
from weftgraph.operators import relational as rl
from weftgraph.sources.files import discover
from weftgraph.streaming import changes

FILES = [
    ("pkg/__init__.py", ""),
    ("pkg/a.py", "import os.path\nfrom . import b\nfrom .b import run\n\nclass A:\n    def go(self):\n        helper()\n        helper()\n\ndef helper():\n    helper()\n\ndef helper():\n    pass\n"),
    ("pkg/b.py", "import pkg.a\n\ndef run():\n    def inner():\n        pass\n    inner()\n"),
    ("bad.py", "def (:\n"),
]


@pytest.fixture(scope="module")
def analysed(spark):
    return analyze(spark.createDataFrame(FILES, "path string, text string"))


def test_python_graph(analysed):
    g, problems = analysed
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"class:pkg/a.py#A", "method:pkg/a.py#A.go", "function:pkg/a.py#helper", "function:pkg/a.py#helper~2", "function:pkg/b.py#run.inner", "module:external:os.path", "module:bad.py"} <= ids
    e = {r["id"]: r for r in g.edges.collect()}
    assert e["calls:method:pkg/a.py#A.go->function:pkg/a.py#helper"]["cnt"] == 2
    assert {"imports:module:pkg/a.py->module:pkg/b.py", "imports:module:pkg/b.py->module:pkg/a.py", "imports:module:pkg/a.py->module:pkg/__init__.py", "calls:function:pkg/b.py#run->function:pkg/b.py#run.inner"} <= set(e)
    assert "calls:function:pkg/a.py#helper->function:pkg/a.py#helper" not in e
    assert [r["file"] for r in problems.collect()] == ["bad.py"]
    assert rl.validate(g).count() == 0


def test_exports(analysed):
    g, _ = analysed
    data = json.loads(ex.to_json(g))
    assert data["schemaVersion"] == 1 and ex.to_json(g) == ex.to_json(g) and "null" not in ex.to_json(g)
    assert ex.to_mermaid(g).startswith("flowchart LR") and "-.->|imports|" in ex.to_mermaid(g)
    assert ex.to_dot(g).startswith("digraph") and ex.to_plantuml(g).endswith("@enduml\n")
    with pytest.raises(ValueError):
        ex.BUILTIN.register("json", ".other", ex.to_json)


def test_discover_skips_tests_and_vendored(spark, tmp_path):
    for p in ("src/a.py", "src/test_a.py", "node_modules/x.js", "src/b.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert [r["path"] for r in discover(spark, f"file://{tmp_path}").collect()] == ["src/a.py"]
    assert discover(spark, f"file://{tmp_path}", tests=True).count() == 2


def test_incremental_equals_cold(spark):
    old = spark.createDataFrame(FILES, "path string, text string")
    new = spark.createDataFrame([*FILES[:2], ("pkg/b.py", "def run():\n    pass\n")], "path string, text string")
    touched = changes.changed(old, new)
    merged = changes.merge_facts(facts(old), facts(new.join(touched, "path", "left_semi")), touched)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, facts(new).collect()), key=str)


def test_debounce_as_a_stream(spark, tmp_path):
    rows = spark.sql("select 'a' as path, timestamp_seconds(t) as ts from values (0.0), (0.1), (0.2), (5.0), (60.0) as v(t)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = changes.debounce(stream, "path", "ts").writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["saves"] for r in spark.table("bursts").collect())[-1] == 3
