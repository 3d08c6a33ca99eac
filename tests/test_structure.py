"""Containment, spans, unions, validation and incremental passes against plain Python or hand-made cases."""

import random

import pytest

from weftgraph.functions import text as tx
from weftgraph.operators import answers, hierarchy, relational, traverse
from weftgraph.schema import EDGES, NODES, CodeGraph
from weftgraph.streaming import changes


def graph(spark, nodes, edges):
    """Nodes ``(id, file, start, end)`` and edges ``(kind, src, dst)``."""
    n = [(i, i.split(":")[0], i, i, f, a, b, None, False, None, None) for i, f, a, b in nodes]
    e = [(f"{k}:{s}->{d}", k, s, d, None, None, None, None, None) for k, s, d in edges]
    return CodeGraph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def test_chase_follows_deep_chains_and_finds_cycles(spark):
    step = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(100)], "id string, parent string")
    start = spark.createDataFrame([("n0", "n0"), ("n100", "n100"), ("x", "n64")], "id string, to string")
    assert {tuple(r) for r in hierarchy.chase(start, step).select("id", "to").collect()} == {("n0", "n100"), ("n100", "n100"), ("x", "n100")}
    with pytest.raises(ValueError):
        hierarchy.chase(start, step.unionByName(spark.createDataFrame([("n100", "n0")], "id string, parent string"))).count()


def test_enclosing_against_all_spans(spark):
    rnd = random.Random(1)
    spans = [(f"class:{f}#{k}", f, a, a + rnd.choice([0, 3, 60, 64, 200, 5000, 400000])) for f in "ab" for k in range(60) for a in [rnd.randrange(1, 3000)]]
    lines = [(f, rnd.randrange(1, 6000)) for f in "abc" for _ in range(80)]
    got = {(r["file"], r["line"]): r["id"] for r in answers.enclosing(graph(spark, spans, []).nodes, spark.createDataFrame(lines, "file string, line int")).collect()}
    want = {}
    for f, at in lines:
        around = [(-a, b, i) for i, g, a, b in spans if g == f and a <= at <= b]
        if around:
            want[f, at] = min(around)[2]
    assert got == want


def test_common_ancestor_of_nested_nodes(spark):
    g = graph(spark, [(i, None, None, None) for i in ("folder:r", "module:a", "module:b", "class:x", "class:y")], [("contains", "folder:r", "module:a"), ("contains", "folder:r", "module:b"), ("contains", "module:a", "class:x"), ("contains", "module:a", "class:y")])
    pairs = [("class:x", "class:y"), ("class:x", "module:b"), ("class:x", "module:a"), ("class:x", "none")]
    got = {(r["a"], r["b"]): r["ancestor"] for r in traverse.common_ancestor(g, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == dict(zip(pairs, ["module:a", "folder:r", "module:a", None], strict=True))


def test_union_keeps_the_first_graphs_row(spark):
    a, b = graph(spark, [("class:x", "one", 1, 2)], []), graph(spark, [("class:x", "two", 1, 2), ("class:x", "three", 1, 2), ("class:y", "two", 1, 2)], [])
    assert {(r["id"], r["file"]) for r in relational.union_graphs(a, b).nodes.collect()} == {("class:x", "one"), ("class:y", "two")}
    assert {(r["id"], r["file"]) for r in relational.union_graphs(b, a).nodes.collect()} == {("class:x", "three"), ("class:y", "two")}


def test_validation_names_what_is_broken(spark):
    g = graph(spark, [("class:x", "f", 5, 4), ("class:x", "f", 1, 2), ("odd:y", None, None, None)], [("contains", "class:x", "class:x"), ("contains", "odd:y", "class:x"), ("calls", "class:x", "class:gone"), ("wants", "gone:a", "odd:y")])
    said = {r["message"].split(":")[0] for r in relational.validate(g).collect()}
    assert said == {"duplicate node", "edge without source", "edge without target", "several parents", "contains itself", "node kind", "edge kind", "span"}


def test_incremental_passes(spark):
    files = lambda **t: spark.createDataFrame(list(t.items()), "path string, text string")
    seen, told = [], []

    def extract(f):
        seen.append(sorted(r["path"] for r in f.collect()))
        return f.selectExpr("path", "upper(text) AS fact")

    index = lambda facts: spark.createDataFrame([("b", "a")], "file string, imports string")
    run = changes.Incremental(extract, index, lambda *x: told.append(x))
    facts = lambda f, o=None: ({r["path"]: r["fact"] for r in run.analyze(f, o).collect()}, run.last)
    assert facts(files(a="x", b="y", c="z")) == ({"a": "X", "b": "Y", "c": "Z"}, "cold")
    assert facts(files(a="x", b="y", c="z"))[1] == "cached"
    assert facts(files(a="xx", b="y", c="z")) == ({"a": "XX", "b": "Y", "c": "Z"}, "partial")
    assert facts(files(a="xx", b="y", c="z"), "other")[1] == "cold" and facts(files(a="xx", b="y"), "other")[1] == "cold"
    assert seen == [["a", "b", "c"], ["a", "b"], ["a", "b", "c"], ["a", "b"]] and told[0] == ("cold", 0, 1)


def test_what_is_a_test_file(spark):
    paths = ["src/test/a.ts", "src/tests/a.ts", "a/test_.py", "a/test_x.py", "a/_test.py", "a/x_test.py", "a.spec.ts"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(tx.is_test_file(tx.F.col("p")).alias("v")).collect()
    assert [r["v"] for r in got] == [False, True, False, True, False, True, True]


def test_nested_exports_of_any_containment():
    from weftgraph.export.text import _nested

    nodes = [{"id": i} for i in "abcdefg"]
    holds = lambda *pairs: [{"kind": "contains", "src": s, "dst": t} for s, t in pairs]
    got = lambda edges: " ".join(f"{len(pad) // 2}{n['id']}{step[0]}" for pad, n, step in _nested(nodes, edges))
    assert got([]) == "1al 1bl 1cl 1dl 1el 1fl 1gl"
    # b is held twice, c and d hold each other, e holds itself, x isn't a node
    assert got(holds(("a", "b"), ("f", "b"), ("c", "d"), ("d", "c"), ("e", "e"), ("x", "g"), ("b", "g"))) == "1ao 2bo 3gl 2bc 1ac 1el 1fl 1co 2dl 1cc"
