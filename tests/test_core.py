"""Graph operators on small graphs, against plain Python, and both ways of each walk."""

import random

import pytest

from weftgraph.functions import text as tx
from weftgraph.operators import answers as an
from weftgraph.operators import hierarchy as hi
from weftgraph.operators import rank as rk
from weftgraph.operators import relational as rl
from weftgraph.operators import traverse as tv
from weftgraph.schema import EDGES, NODES, CodeGraph, padded


def graph(spark, nodes, edges):
    n = padded(spark.createDataFrame(nodes, "id string, kind string, name string, qn string, file string, start_line int, end_line int"), NODES)
    e = padded(spark.createDataFrame([(f"{k}:{s}->{d}", k, s, d, c) for k, s, d, c in edges], "id string, kind string, src string, dst string, cnt long"), EDGES)
    return CodeGraph(n, e)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [(f"module:{p}", "module", p, p, p, 1, 99) for p in ("a/x.ts", "a/y.ts", "b/z.ts")] + [(f"function:{p}#{f}", "function", f, f, p, s, s + 9) for p, f, s in (("a/x.ts", "f", 10), ("a/y.ts", "g", 10), ("b/z.ts", "h", 30))]
    edges = [("contains", f"module:{p}", f"function:{p}#{f}", None) for p, f in (("a/x.ts", "f"), ("a/y.ts", "g"), ("b/z.ts", "h"))]
    edges += [("calls", "function:a/x.ts#f", "function:a/y.ts#g", 3), ("calls", "function:a/y.ts#g", "function:b/z.ts#h", None), ("imports", "module:a/x.ts", "module:a/y.ts", None), ("imports", "module:a/y.ts", "module:a/x.ts", None), ("imports", "module:a/y.ts", "module:b/z.ts", None)]
    return graph(spark, nodes, edges)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_collapse_is_idempotent_and_valid(small):
    once = hi.collapse_modules(small)
    twice = hi.collapse_modules(once)
    assert rows(once.edges, "id", "cnt") == rows(twice.edges, "id", "cnt")
    assert ("calls:module:a/x.ts->module:a/y.ts", 3) in rows(once.edges, "id", "cnt")
    assert rl.validate(once).count() == 0 and rl.validate(small).count() == 0


def test_folders_clamp_depth(small):
    assert rows(hi.collapse_folders(small, 0).edges, "id") == rows(hi.collapse_folders(small, 1).edges, "id")
    assert hi.best_folder_depth(small) == 1


def test_expand_matches_drill_down(small):
    g = hi.expand_nodes(small, ["module:a/x.ts"])
    assert rows(g.nodes, "id") == [("function:a/x.ts#f",), ("module:a/x.ts",), ("module:a/y.ts",), ("module:b/z.ts",)]


def test_walks_agree_on_random_graphs(spark):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)]
    e = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",)], "id string")
    assert rows(tv.bfs(e, seeds, 3), "id", "depth") == rows(tv.bfs(e, seeds, 3, few=0), "id", "depth")
    assert rows(rk.scc(e), "id", "scc") == rows(rk.scc(e, few=0), "id", "scc")


def test_pagerank_both_ways(small):
    a, b = rk.pagerank(small), rk.pagerank(small, few=0)
    got = [r[1] for r in rows(a, "id", "score")]
    assert [round(x, 9) for x in got] == [round(r[1], 9) for r in rows(b, "id", "score")]
    assert abs(sum(got) - 1) < 1e-9
    absent = rk.pagerank(small, seeds=["nobody"])
    assert [round(r[1], 9) for r in rows(absent, "id", "score")] == [round(x, 9) for x in got]


def test_shortest_path_takes_the_least_sequence(spark):
    ids = [f"function:m#{c}" for c in "abcde"]
    a, b, c, d, e = ids
    g = graph(spark, [(i, "function", i, i, "m", 1, 1) for i in ids], [("calls", a, c, None), ("calls", a, b, None), ("calls", b, e, None), ("calls", c, d, None), ("calls", b, d, None)])
    assert rows(tv.shortest_path(g, a, d), "pos", "id") == [(0, a), (1, b), (2, d)]
    assert rows(tv.shortest_path(g, a, a), "pos", "id") == [(0, a)]
    assert rows(tv.shortest_path(g, d, a), "pos", "id") == []
    with pytest.raises(KeyError):
        tv.shortest_path(g, a, "nobody")


def test_cycles_z1(spark):
    m = [f"module:{c}" for c in "abcde"]
    a, b, c, d, e = m
    g = graph(spark, [(i, "module", i, i, i, 1, 1) for i in m], [("imports", s, t, None) for s, t in ((a, b), (b, a), (b, c), (c, d), (d, c), (d, e))])
    loose = {r["id"]: r["in_cycle"] for r in rk.mark_import_cycles(g).collect()}
    strict = {r["id"]: r["in_cycle"] for r in rk.mark_import_cycles(g, strict=True).collect()}
    bridge = f"imports:{b}->{c}"
    assert loose[bridge] and not strict[bridge] and not loose[f"imports:{d}->{e}"]


def test_diff_z12_and_deletions(spark):
    text = "--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,3 @@\n keep\n+++ plus\n-- minus\n+new\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    got = rows(an.parse_diff(spark.createDataFrame([(1, text)], "diff_id long, text string")), "file", "line")
    assert got == [("x.ts", 2), ("x.ts", 3)]


def test_impact_depths(small, spark):
    lines = spark.createDataFrame([("b/z.ts", 31)], "file string, line int")
    assert rows(an.impact(small, lines, 1), "id", "role") == [("function:a/y.ts#g", "reached"), ("function:b/z.ts#h", "changed")]
    assert len(rows(an.impact(small, lines, 2), "id")) == 3


def test_enclosing_looks_up_a_line_of_every_customer(spark):
    from weftgraph.plans import registered

    d = "/root/testdata/sf0.001"
    t = {n: spark.read.parquet(f"{d}/{n}.parquet").collect() for n in ("region", "nation", "customer")}
    region = {r["r_regionkey"]: r["r_name"] for r in t["region"]}
    path = {r["n_nationkey"]: f"{region[r['n_regionkey']]}/{r['n_name']}" for r in t["nation"]}
    want = sorted((path[c["c_nationkey"]], c["c_custkey"] * 100 + 50, f"class:{path[c['c_nationkey']]}#{c['c_name']}") for c in t["customer"])
    assert rows(registered()[0]["enclosing"](spark, d), "file", "line", "id") == want and len(want) == 150


def test_map_budget_is_monotone_and_never_empty(small):
    ranks = rk.pagerank(small)
    counts = [an.repo_map(small, ranks, b).count() for b in (1, 10, 20, 1000)]
    assert counts[0] == 1 and counts == sorted(counts) and counts[-1] == 3


def test_rebase_and_union(small):
    moved = rl.rebase(small, "root")
    assert rl.validate(moved).count() == 0
    assert rl.rebase(small, "") is small
    assert rl.union_graphs(small, small).nodes.count() == small.nodes.count()


def test_globs(spark):
    df = spark.createDataFrame([("a/b/c.ts",), ("c.ts",), ("a/c.tsx",), ("c.ts\n",)], "p string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(tx.glob_column(F.col("p"), ["**/*.ts"])).collect()] == [True, True, False, False]
    assert tx.expand_braces("{a,b}/{c,d}") == ["a/c", "a/d", "b/c", "b/d"]
