"""Control-flow graphs of small functions."""

import pytest

from weftgraph.frontends.flow import FLOW, block_label, dead_blocks, flow, flow_of, parallel_edges, validate_flow

SHORT = {"normal": "n", "true": "t", "false": "f", "back": "b", "case": "c", "exception": "x", "finally": "y"}


def graph(body, head="function f(a, b) {\n"):
    rows = list(flow_of("m.ts", head + body + "\n}\n"))
    blocks = {r[4]: r[6] for r in rows if r[3] == "block" and r[5] == "basic"}
    return blocks, " ".join(f"{r[8]}>{r[9]}:{SHORT[r[5]]}" + (f"={r[10]}" if r[10] else "") for r in rows if r[3] == "edge"), [r[10] for r in rows if r[3] == "problem"]


@pytest.mark.parametrize(
    "body, blocks, edges",
    [
        ("", {}, "entry>exit:n"),
        ("a();\nif (b) return 1\nelse { c() }", {"b1": ["a();"], "b2": ["b"], "b3": ["return 1"], "b4": ["c()"]}, "entry>b1:n b1>b2:n b2>b3:t b2>b4:f b3>exit:n b4>exit:n"),
        ("for (let i = 0; i < a; i++) { if (i) continue; g(i); }", {"b1": ["let i = 0"], "b2": ["i < a"], "b3": ["i"], "b4": ["i++"], "b5": ["g(i);"], "b6": ["continue;"]}, "entry>b1:n b1>b2:n b2>b3:t b2>exit:f b3>b5:f b3>b6:t b4>b2:b b5>b4:n b6>b4:n"),
        ("do { a++ } while (a < b);\nreturn a", {"b1": ["a++"], "b2": ["a < b"], "b3": ["return a"]}, "entry>b1:n b1>b2:n b2>b1:b b2>b3:f b3>exit:n"),
        ("switch (a) {\n case 1: x();\n case 'y': break;\n}", {"b1": ["switch a"], "b2": ["x();"], "b3": ["break;"]}, "entry>b1:n b1>b2:c=1 b1>b3:c='y' b1>exit:c=no match b2>b3:n b3>exit:n"),
        ("try { return g(); } finally { h(); }", {"b1": ["return g();"], "b2": ["h();"]}, "entry>b1:n b1>b2:y b2>exit:n"),
        ("try { g(); } catch (e) { throw e; }", {"b1": ["g();"], "b2": ["catch (e)", "throw e;"]}, "entry>b1:n b1>b2:x b1>exit:n b2>exit:x"),
        ("return 1;\nlost();", {"b1": ["return 1;"], "b2": ["lost();"]}, "entry>b1:n b1>exit:n b2>exit:n"),
        ("out: for (const x of a) { while (true) { break out; } }\nz();", {"b1": ["const x of a"], "b2": ["z();"], "b3": ["true"], "b4": ["break out;"], "b5": []}, "entry>b1:n b1>b2:f b1>b3:t b2>exit:n b3>b4:t b3>b5:f b4>b2:n b5>b1:b"),
        ("const x = a\n  .map((y) => { if (y) { return 1; } })\ng(`}`, '{')", {"b1": ["const x = a", "g(`}`, '{')"]}, "entry>b1:n b1>exit:n"),
    ],
)
def test_statements(body, blocks, edges):
    assert graph(body) == (blocks, edges, [])


def test_problems_stay_with_their_function():
    rows = list(flow_of("m.ts", "function bad() { break; }\nfunction good() { g(); }\n"))
    assert [(r[2], r[3]) for r in rows if r[3] == "problem"] == [("bad", "problem")] and any(r[2] == "good" and r[3] == "edge" for r in rows)
    assert [r[3] for r in flow_of("m.ts", "function f( {")] == ["problem"]
    assert list(flow_of("m.ts", None)) == []


def test_rows_are_valid_and_grouped(spark):
    text = "class A { async m(a) { for (;;) { if (await a) break; } switch (a) { case 1: case 2: return 1; } } }\n"
    rows = flow(spark.createDataFrame([("a.ts", text), ("b.ts", None)], "path string, text string")).cache()
    assert validate_flow(rows).count() == 0
    assert validate_flow(rows.union(rows.limit(1))).count() > 0
    labels = [r[0] for r in rows.where("fact = 'block'").select(block_label(rows.kind, rows.statements, rows.awaits)).collect()]
    assert {"Start", "End", "⏳ await a"} <= set(labels)
    assert parallel_edges(rows).groupBy("src", "dst").count().where("count > 1").count() == 0


def test_dataflow():
    from weftgraph.frontends.dataflow import sites_of

    text = "let top = 1;\nfunction f(a, { b: c = 1 }) {\n  let x;\n  x = a + c;\n  { let x = 2; c += x; }\n  const g = () => { x++; return top; };\n  for (const i of a) { g({ a: i }); }\n}\n"
    got = {(r[2], r[3], r[4], r[6], r[7], r[8]) for r in sites_of("m.ts", text)}
    assert got == {
        ("f", "a", 2, False, "write", 2), ("f", "a", 2, False, "read", 4), ("f", "a", 2, False, "read", 7), ("f", "c", 2, False, "write", 2), ("f", "c", 2, False, "read", 4),
        ("f", "c", 2, False, "read", 5), ("f", "c", 2, False, "write", 5), ("f", "x", 3, False, "write", 4), ("f", "x", 5, False, "write", 5), ("f", "x", 5, False, "read", 5),
        ("f", "g", 6, False, "write", 6), ("f", "g", 6, False, "read", 7), ("g", "x", 3, True, "read", 6), ("g", "x", 3, True, "write", 6), ("f", "i", 7, False, "write", 7), ("f", "i", 7, False, "read", 7),
    }
    for bad in (None, "", "function f( {", "const", "for (let", "(a) =>", "let {a", "catch ("):
        list(sites_of("m.ts", bad))


def test_validation_reads_the_files_once(spark):
    files = spark.createDataFrame([("a.ts", "function f(a) { if (a) return 1; }\n")], "path string, text string")
    out = validate_flow(flow(files))
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Broadcast" not in plan and out.count() == 0


BLOCKS = {"entry": ("entry", [], []), "b1": ("basic", ["x = 1"], [(2, 2, 2, 8)]), "exit": ("exit", [], [])}
EDGES = [("entry", "b1", "normal", None), ("b1", "exit", "normal", None)]


def small(blocks=(), edges=(), ends=("entry", "exit"), instead=None, fn=1):
    """The rows of entry, b1 and exit, with blocks in place of theirs or more of them, and more edges."""
    held = [*({k: (k, *v) for k, v in BLOCKS.items()} | {b[0]: b for b in blocks[:1]}).values(), *blocks[1:]]
    out = [("a.ts", fn, "f", "block", i, k, t, False, None, None, None, None, None, at) for i, k, t, at in held if k != "none"]
    out += [("a.ts", fn, "f", "edge", None, k, None, None, a, b, x, None, None, None) for a, b, k, x in [*(EDGES if instead is None else instead), *edges]]
    return [*out, ("a.ts", fn, "f", "function", None, None, None, None, *ends, None, 1, 10, None)]


def test_validation_finds_each_problem(spark):
    b1, again = ("b1", "basic", ["x = 1"], [(2, 2, 2, 8)]), ("b1", "basic", [], [])
    cases = [
        (small(), []),
        (small([("b1", "basic", ["x"], [(2, 40, 3, 2)])], [("b1", "exit", "case", "1")]), []),
        (small([b1, again, again]), ["duplicate block id b1"] * 2),
        (small([("b1", "basic", ["x = 1", "y = 2"], [(2, 2, 2, 8)])]), ["block b1 has 2 statements but 1 spans"]),
        (small([("b1", "basic", ["x = 1"], None)]), ["block b1 has 1 statements but 0 spans"]),
        (small([("entry", "entry", ["x = 1"], [(2, 2, 2, 8)])]), ["entry block entry must be empty"]),
        (small([("b1", "basic", ["x"], [(2, 9, 2, 3)])]), ["block b1 has an inverted span (2:9)"]),
        (small([("b1", "basic", ["x"], [(5, 0, 3, 0)])]), ["block b1 has an inverted span (5:0)"]),
        (small([("b1", "basic", ["x", "y"], [(2, 0, 99, 0), (0, 1, 1, 1)])]), ["block b1 maps outside its function (0)", "block b1 maps outside its function (2)"]),
        (small([b1, ("entry2", "entry", [], []), ("exit2", "exit", [], [])]), ["expected exactly one entry block, found 2", "expected exactly one exit block, found 2"]),
        (small([("entry", "none", [], [])]), ["edge from unknown block entry", "entryId entry is not a block", "expected exactly one entry block, found 0"]),
        (small(ends=("entry", "nowhere")), ["exitId nowhere is not a block"]),
        (small(edges=[("ghost", "exit", "normal", None), ("b1", "ghost", "normal", None)]), ["edge from unknown block ghost", "edge to unknown block ghost"]),
        (small(edges=[("b1", "entry", "back", None), ("exit", "b1", "normal", None)]), ["entry block has an incoming edge", "exit block has an outgoing edge"]),
        (small(edges=[("entry", "b1", "normal", ""), ("entry", "b1", "true", None)]), ["duplicate edge entry→b1:normal:", "edge entry→b1:normal: carries a label but is not a case edge"]),
        (small(instead=[("entry", "b1", "normal", "yes"), EDGES[1]]), ["edge entry→b1:normal:yes carries a label but is not a case edge"]),
        (small()[:-1], ["expected exactly one function, found 0"]),
        (small()[-1:], ["entryId entry is not a block", "exitId exit is not a block", "expected exactly one entry block, found 0", "expected exactly one exit block, found 0"]),
    ]
    rows = [(r[0], k, *r[2:]) for k, (part, _) in enumerate(cases) for r in part]
    found = validate_flow(spark.createDataFrame(rows, FLOW)).collect()
    assert [sorted(r["problem"] for r in found if r["fn"] == k) for k in range(len(cases))] == [want for _, want in cases]


def test_each_statement_has_its_span():
    rows = list(flow_of("m.ts", "let z;\nfunction f(a) {\n  /* one */ g(a,\n    1); // two\n  if ( a ) return 1;\n}\n"))
    assert {r[4]: r[13] for r in rows if r[3] == "block"} == {"entry": [], "exit": [], "b1": [(3, 13, 4, 8)], "b2": [(5, 8, 5, 9)], "b3": [(5, 12, 5, 21)]}
    assert [r[8:10] + r[11:13] for r in rows if r[3] == "function"] == [("entry", "exit", 2, 6)]


def test_dead_blocks_of_a_deep_function(spark):
    """One pass, without a join for each level of the deepest function."""
    deep = "function f(a) {\n" + "  if (a) { g(); }\n" * 200 + "  return 1;\n  lost();\n}\nfunction whole() {}\n"
    files = spark.createDataFrame([("a.ts", deep), ("b.ts", "function h() { for (;;) { x(); } y(); }\n"), ("c.ts", None)], "path string, text string")
    out = dead_blocks(flow(files))
    assert "Join" not in out._jdf.queryExecution().toString() and {(r["path"], r["fn"]) for r in out.collect()} == {("a.ts", 1), ("b.ts", 1)}
