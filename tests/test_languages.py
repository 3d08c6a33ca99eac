"""The lexical front-ends and import resolution on small programs."""

import pyarrow as pa
import pytest

from weftgraph.frontends.lexical import LANGUAGES, arrow, facts, facts_of
from weftgraph.frontends.resolve import Cancelled, analyze
from weftgraph.operators import rank as rk
from weftgraph.operators import relational as rl


def decls(lang, text):
    return [(f[1], f[3]) for f in facts_of("f", text, LANGUAGES[lang]) if f[0] == "decl"][1:]


def called(lang, text):
    return [(f[1], f[2]) for f in facts_of("f", text, LANGUAGES[lang]) if f[0] == "call"]


@pytest.mark.parametrize(
    "lang, text, expected",
    [
        ("go", "type B struct {\n}\n// func C() {}\nfunc (b *B) Add(n int) int { return n }\n", [("class", "B"), ("function", "Add")]),
        ("java", "class S {\n S() {}\n public <T> List<T> go(int x) throws E { return new Foo(x); }\n}\ninterface I { void m(int a); }\n", [("class", "S"), ("method", "S.S"), ("method", "S.go"), ("class", "I"), ("method", "I.m")]),
        ("rust", "mod h;\nimpl<T> Show for W<T> { fn s<'a>(&'a self) {} }\nfn run() { let c = '{'; }\n", [("class", "h"), ("class", "W"), ("method", "W.s"), ("function", "run")]),
        ("ruby", "module A::O\n class I < B\n  def v(x)\n   y = if x\n    1\n   end\n   while x do\n   end\n  end\n  def self.h = 1\n end\nend\ndef run\nend\n", [("class", "O"), ("class", "O.I"), ("method", "O.I.v"), ("method", "O.I.h"), ("function", "run")]),
        ("csharp", "namespace N;\npublic class R {\n int A(int i) => B(i);\n int B(int i) { int L(int z) { return z; } return L(i); }\n}\n", [("namespace", "N"), ("class", "R"), ("method", "R.A"), ("method", "R.B"), ("function", "R.B.L")]),
        ("typescript", "export const a = 1, b = { x: 2 };\nexport function p(s: string): void;\nexport function p(s: any): void {}\nclass M { get v(): number { return 1; } }\nnamespace G { export const PI = 3; }\nconst h = (x: number): number => x;\n", [("variable", "a"), ("variable", "b"), ("function", "p"), ("class", "M"), ("method", "M.v"), ("namespace", "G"), ("variable", "G.PI"), ("function", "h")]),
    ],
)
def test_declarations(lang, text, expected):
    assert decls(lang, text) == expected


def test_calls_skip_strings_comments_and_declarations():
    text = 'class A { m() { run("f(1)"); /* g() */ new B(); this.m(); } }\nfunction run() {}\n'
    assert called("typescript", text) == [(None, "run"), ("new", "B"), ("this", "m")]
    assert (None, "helper") in called("ruby", "def a\n  helper z\nend\n")


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
@pytest.mark.parametrize("text", [None, "", "{{{((", "end end }", '"', "class", "\x00"])
def test_any_text_gives_a_module(lang, text):
    found = list(facts_of("a/f", text, LANGUAGES[lang]))
    assert found[0][:4] == ("decl", "module", "f", "a/f")
    assert ("problem" in [f[0] for f in found]) == (text in ("{{{((", "end end }") and (text == "end end }" or lang != "ruby") or (lang, text) == ("ruby", "class"))


def edges(spark, lang, files, **kw):
    g, problems = analyze(spark.createDataFrame(files, "path string, text string"), lang, **kw)
    assert rl.validate(g).count() == 0
    return {r["id"]: r for r in g.edges.where("kind <> 'contains'").collect()}, [r["message"] for r in problems.collect()]


def test_typescript_modules(spark):
    files = [
        ("a/m.ts", "import type { T } from '../t';\nimport { go as run } from './n.js';\nimport x from '@s/p/deep';\nimport './gone';\nimport { q } from '@app/q';\nexport function f() { run(); run(); ghost(); parseInt('1'); }\n"),
        ("a/n.ts", "export function go() {}\n"),
        ("t/index.ts", "export interface T {}\n"),
        ("src/q.ts", "export const q = 1;\n"),
    ]
    e, problems = edges(spark, "typescript", files, aliases={"@app/*": ["src/*"]})
    assert set(e) == {"imports:module:a/m.ts->module:t/index.ts", "imports:module:a/m.ts->module:a/n.ts", "imports:module:a/m.ts->module:external:@s/p", "imports:module:a/m.ts->module:external:./gone", "imports:module:a/m.ts->module:src/q.ts", "calls:function:a/m.ts#f->function:a/n.ts#go", "calls:function:a/m.ts#f->function:unresolved#ghost"}
    assert e["imports:module:a/m.ts->module:t/index.ts"]["type_only"] and e["calls:function:a/m.ts#f->function:a/n.ts#go"]["cnt"] == 2
    assert problems == ['unresolved import "./gone"']


def test_typescript_marks_value_import_cycles(spark):
    files = [
        ("a.ts", "import { b } from './b';\nimport type { T } from './t';\n"),
        ("b.ts", "import { c } from './c';\n"),
        ("c.ts", "import './a';\nimport './end';\nimport 'react';\n"),
        ("t.ts", "import { a } from './a';\n"),
        ("end.ts", "import './end';\n"),
        ("into.ts", "export * from './a';\n"),
    ]
    e, _ = edges(spark, "typescript", files)
    flags = {(r["src"][7:], r["dst"][7:]): r["in_cycle"] for r in e.values()}
    # c imports end, of another cycle: both ends are on one
    assert {k for k, v in flags.items() if v} == {("a.ts", "b.ts"), ("b.ts", "c.ts"), ("c.ts", "a.ts"), ("c.ts", "end.ts"), ("end.ts", "end.ts")}
    assert {k for k, v in flags.items() if v is None} == {("a.ts", "t.ts"), ("t.ts", "a.ts"), ("c.ts", "external:react"), ("into.ts", "a.ts")}


@pytest.mark.parametrize("pairs", [[], [(k, k + 1) for k in range(60)], [(k, (k + 1) % 60) for k in range(60)], [(k, k * 7 % 40) for k in range(40)] + [(k, k * 5 // 3) for k in range(40)]])
def test_cyclic_nodes_of_one_task_and_of_components(spark, pairs):
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    reach = {a: {a} for a, _ in pairs}
    for _ in pairs:
        for a in reach:
            reach[a] |= {y for x, y in pairs if x in reach[a]}
    want = {str(a) for a in reach if any(a in (y, *reach.get(y, ())) for x, y in pairs if x == a)}
    for few in (1000, -1):
        assert {r["id"] for r in rk.cyclic(e, few).collect()} == want


def test_typescript_callbacks_recursion_and_unknown_classes(spark):
    files = [
        ("a.ts", "import { far, Kind } from './b';\nfunction near() { near(); }\nclass Own {}\nfunction f(xs) { xs.map(near, far, Own, Kind, other); new Gone(near); g()(far); if (near) { xs[0]?.(near); } }\nfunction h(near) { return (near); }\nfunction k() { function part() {} run(part); }\nfunction m(part) { this.run(part); }\nfunction run() {}\n"),
        ("b.ts", "export function far() {}\nexport class Kind {}\n"),
    ]
    e, _ = edges(spark, "typescript", files)
    got = {(r["src"].split("#")[-1], r["dst"].split("#")[-1]): (r["cnt"], r["low"]) for r in e.values() if r["kind"] == "calls"}
    assert got == {("near", "near"): (None, None), ("f", "near"): (2, True), ("f", "far"): (2, True), ("f", "Gone"): (None, True), ("f", "g"): (None, True), ("k", "run"): (None, None), ("k", "k.part"): (None, True)}


def test_typescript_phases_and_cancellation(spark):
    files = spark.createDataFrame([("a.ts", "import './b';\n"), ("b.ts", "import './a';\nf();\n")], "path string, text string")
    said = []
    g, _ = analyze(files, "typescript", progress=lambda *x: said.append(x), cancelled=lambda: False)
    phases = ["structure", "heritage", "imports", "cycles", "calls"]
    assert said == [(p, n, 2) for p in phases for n in (0, 2)]
    assert g.edges.where("in_cycle").count() == 2 and {r["id"] for r in g.edges.collect()} == {r["id"] for r in analyze(files, "typescript")[0].edges.collect()}
    said.clear()
    with pytest.raises(Cancelled, match="imports"):
        analyze(files, "typescript", progress=lambda *x: said.append(x), cancelled=lambda: len(said) >= 4)
    assert [p for p, n, _ in said if n] == phases[:2]


def test_rust_paths(spark):
    files = [("src/lib.rs", "mod store;\nuse crate::store::disk::Disk;\nuse std::fmt;\n"), ("src/store/mod.rs", "pub mod disk;\nuse super::util::go;\n"), ("src/store/disk.rs", "use super::super::util;\nuse self::none::X;\n"), ("src/util.rs", "")]
    e, _ = edges(spark, "rust", files)
    assert set(e) == {f"imports:module:{a}->module:{b}" for a, b in [("src/lib.rs", "src/store/mod.rs"), ("src/lib.rs", "src/store/disk.rs"), ("src/lib.rs", "external:std::fmt"), ("src/store/mod.rs", "src/store/disk.rs"), ("src/store/mod.rs", "src/util.rs"), ("src/store/disk.rs", "src/util.rs"), ("src/store/disk.rs", "external:self::none::X")]}


def test_java_prefers_the_shortest_path(spark):
    e, _ = edges(spark, "java", [("x/A.java", "import p.B;\nimport java.util.*;\n"), ("long/src/p/B.java", ""), ("src/p/B.java", "")])
    assert set(e) == {"imports:module:x/A.java->module:src/p/B.java", "imports:module:x/A.java->module:external:java.util"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("function f(a, b = 2) {}\n", "(a, b = 2)"),
        ("export function g<T>(a: { x: T }): { y: T } { return a; }\n", "(a: { x: T }): { y: T }"),
        ("const h = async (x: number /* one */): Promise<void> => {};\n", "(x: number): Promise<void>"),
        ("const k = x => x;\n", "(x)"),
        ("function broken(\n", None),
    ],
)
def test_signatures_as_written(text, expected):
    assert [f[8] for f in facts_of("f", text, LANGUAGES["typescript"]) if f[0] == "decl"][1:] == [expected]


@pytest.mark.parametrize(
    "comment, expected",
    [("/** One.\n * Two. */\n", "One."), ("/**\n *\n * Late\n */\n", "Late"), ("/** @internal */\n", None), ("/* plain */\n", None), ("/***/\n", None), ("// line\n", None), ("/** far */\nlet x;\n", None)],
)
def test_doc_lines(comment, expected):
    assert [f[9] for f in facts_of("f", comment + "export class A {}\n", LANGUAGES["typescript"]) if f[1] == "class"] == [expected]


def test_heritage_clauses():
    text = "class A<T = B<C>> extends N.B<{}> {}\nclass D extends E<X, Y<Z>> implements F, G.H<I> {}\ninterface J extends K, L {}\nclass M {}\nconst extended = 1;\n"
    assert [f[1:3] for f in facts_of("f", text, LANGUAGES["typescript"]) if f[0] == "heritage"] == [("extends", "N.B"), ("extends", "E"), ("implements", "F"), ("implements", "G.H"), ("extends", "K"), ("extends", "L")]


def test_heritage_prefers_the_import_and_skips_unknown_names(spark):
    files = [
        ("a.ts", "import { Base as B, type Mark } from './b';\nclass A extends B implements Mark, Local, Gone {}\ninterface Local {}\nnamespace N { export class In {} }\nclass C extends N.In {}\nclass E extends Error {}\n"),
        ("b.ts", "export class Base {}\nexport interface Mark {}\n"),
    ]
    e, _ = edges(spark, "typescript", files)
    assert sorted((r["kind"], r["src"], r["dst"], r["line"]) for r in e.values() if r["kind"] != "imports") == [
        ("extends", "class:a.ts#A", "class:b.ts#Base", 2),
        ("extends", "class:a.ts#C", "class:a.ts#N.In", 5),
        ("implements", "class:a.ts#A", "interface:a.ts#Local", 2),
        ("implements", "class:a.ts#A", "interface:b.ts#Mark", 2),
    ]


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("lang, text", [("java", "class A {\n int f() { return g(); }\n int g() { return 1; }\n}\n"), ("csharp", "class A {\n int F() => G();\n int G() => 1;\n}\n"), ("rust", "struct A;\nimpl A { fn f() { g() } fn g() {} }\n"), ("typescript", "class B {}\nclass A extends B { f(): void { this.g(); } g(): void {} }\n")])
def test_files_are_read_by_one_pass_and_nothing_is_broadcast(spark, lang, text):
    """Facts outgrow the estimates of Spark, and a pass again for each use costs most of the time."""
    g, _ = analyze(spark.createDataFrame([(f"p/f{k}.x", text) for k in range(3)], "path string, text string"), lang)
    for df in (g.nodes, g.edges):
        assert "MapInArrow" not in _plan(df) and "Broadcast" not in _plan(df)
    assert g.edges.where("kind = 'calls'").count() == 3 and g.edges.where("kind = 'extends'").count() == 3 * (lang == "typescript")


def test_a_small_file_is_spread_and_rows_come_in_batches(spark):
    files = spark.createDataFrame([(f"f{k}.java", "class A {}") for k in range(5000)], "path string, text string").coalesce(1)
    assert facts(files, "java").rdd.getNumPartitions() == 4
    sizes = [b.num_rows for b in arrow(files.toArrow().to_batches(), lambda p, t: [(p, t)] * 2, "path string, text string", [pa.string()] * 2)]
    assert sum(sizes) == 10000 and min(sizes[:-1]) >= 4096 and len(sizes) == 3
