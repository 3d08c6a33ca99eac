"""Queries of the front-ends, flow graphs, workspaces and evaluation. Front-ends: one source file a customer, that imports the next customer's file.

The expected edges are stated once as templates, from which the SQL is built; ``@K@`` is the key and ``@P@`` the next.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..export.diagrams import flow_charts
from ..frontends.flow import block_label, flow, parallel_edges, validate_flow
from ..frontends.resolve import analyze
from ..operators import evaluation as ev
from ..sources.packages import package_aliases as aliases_of
from ..sources.packages import packages, root_prefixes
from .graphs import read, trade
from .queries import query

#: Language: path, text, edges within the file, the import's target if that file is there, and if it isn't.
PROGRAMS: dict[str, tuple[str, str, list[tuple[str, str, str]], str, str]] = {
    "go": (
        "c@K@.go",
        'package main\n\nimport "mod/c@P@"\n\n// func No() {}\ntype T@K@ struct {\n\tn int\n}\n\nfunc Help@K@() int { return 1 }\nfunc (t *T@K@) Run@K@() int { return Help@K@() }\n',
        [("contains", "module:@F@", "class:@F@#T@K@"), ("contains", "module:@F@", "function:@F@#Help@K@"), ("contains", "module:@F@", "function:@F@#Run@K@"), ("calls", "function:@F@#Run@K@", "function:@F@#Help@K@")],
        "module:external:mod/c@P@",
        "module:external:mod/c@P@",
    ),
    "java": (
        "src/app/C@K@.java",
        'package app;\nimport app.C@P@;\npublic class C@K@ {\n  int help() { return "run()".length(); }\n  int run() { if (true) { return help(); } return 0; }\n}\n',
        [("contains", "module:@F@", "class:@F@#C@K@"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.help"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.run"), ("calls", "method:@F@#C@K@.run", "method:@F@#C@K@.help")],
        "module:src/app/C@P@.java",
        "module:external:app.C@P@",
    ),
    "rust": (
        "c@K@.rs",
        "use crate::c@P@::Item;\npub struct S@K@;\nimpl S@K@ {\n  fn help() -> i32 { 1 }\n  pub fn run<'a>() -> i32 { Self::help() }\n}\n",
        [("contains", "module:@F@", "class:@F@#S@K@"), ("contains", "module:@F@", "class:@F@#S@K@~2"), ("contains", "class:@F@#S@K@~2", "method:@F@#S@K@.help"), ("contains", "class:@F@#S@K@~2", "method:@F@#S@K@.run"), ("calls", "method:@F@#S@K@.run", "method:@F@#S@K@.help")],
        "module:c@P@.rs",
        "module:external:crate::c@P@::Item",
    ),
    "ruby": (
        "lib/c@K@.rb",
        "require_relative './c@P@'\nclass C@K@\n  def help\n    1 if true\n  end\n\n  def run\n    help()\n  end\nend\n",
        [("contains", "module:@F@", "class:@F@#C@K@"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.help"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.run"), ("calls", "method:@F@#C@K@.run", "method:@F@#C@K@.help")],
        "module:lib/c@P@.rb",
        "module:external:./c@P@",
    ),
    "csharp": (
        "C@K@.cs",
        "using App.C@P@;\nnamespace App.Core {\n  public class C@K@ {\n    int Help() => 1;\n    public int Run() { return Help(); }\n  }\n}\n",
        [("contains", "module:@F@", "namespace:@F@#App.Core"), ("contains", "namespace:@F@#App.Core", "class:@F@#App.Core.C@K@"), ("contains", "class:@F@#App.Core.C@K@", "method:@F@#App.Core.C@K@.Help"), ("contains", "class:@F@#App.Core.C@K@", "method:@F@#App.Core.C@K@.Run"), ("calls", "method:@F@#App.Core.C@K@.Run", "method:@F@#App.Core.C@K@.Help")],
        "module:external:App.C@P@",
        "module:external:App.C@P@",
    ),
    "analyze_typescript": (
        "src/c@K@.ts",
        'import { start } from "./c@P@";\n\nexport class C@K@ {\n  help(): number { return 1; }\n  go(): number { return this.help(); }\n}\nexport function start(): number {\n  const own = new C@K@();\n  return missing() + own.go();\n}\n',
        [("contains", "module:@F@", "class:@F@#C@K@"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.help"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.go"), ("contains", "module:@F@", "function:@F@#start"), ("calls", "method:@F@#C@K@.go", "method:@F@#C@K@.help"), ("calls", "function:@F@#start", "class:@F@#C@K@"), ("calls", "function:@F@#start", "function:unresolved#missing")],
        "module:src/c@P@.ts",
        "module:external:./c@P@",
    ),
}


def _sql(path: str, edges: list[tuple[str, str, str]], here: str, missing: str) -> str:
    fill = lambda t: "replace(replace('" + t.replace("@F@", path) + "', '@K@', k), '@P@', p)"
    rows = [f"SELECT '{kind}' AS kind, {fill(a)} AS src, {fill(b)} AS dst FROM c" for kind, a, b in edges]
    rows.append(f"SELECT 'imports', {fill('module:@F@')}, CASE WHEN known THEN {fill(here)} ELSE {fill(missing)} END FROM c")
    return "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_custkey + 1 AS VARCHAR) AS p, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS known FROM customer) " + " UNION ALL ".join(rows)


def _register(key: str) -> None:
    path, text, edges, here, missing = PROGRAMS[key]

    def run(spark, d):
        k, p = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 1).cast("string")
        fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("@K@"), k), F.lit("@P@"), p)
        files = read(spark, d, "customer").select(fill(path).alias("path"), fill(text).alias("text"))
        return analyze(files, key.removeprefix("analyze_"))[0].edges.select("kind", "src", "dst")

    query(_sql(path, edges, here, missing), key)(run)


for _key in PROGRAMS:
    _register(_key)


_TS = "function f@K@(a) {\n  let n = 0;\n  for (const x of a) {\n    if (x % 2) continue;\n    n += await x;\n  }\n  switch (n) { case 1: case 2: return n; default: throw n; }\n}\n"
_BLOCKS = [("b1", "let n = 0;", False), ("b2", "const x of a", False), ("b3", "x % 2", False), ("b4", "switch n", False), ("b5", "n += await x;", True), ("b6", "continue;", False), ("b7", "return n;", False), ("b8", "throw n;", False), ("entry", "Start", False), ("exit", "End", False)]
_FLOW = [("entry", "b1", "normal", ""), ("b1", "b2", "normal", ""), ("b2", "b3", "true", ""), ("b2", "b4", "false", ""), ("b3", "b5", "false", ""), ("b3", "b6", "true", ""), ("b4", "b7", "case", "1"), ("b4", "b7", "case", "2"), ("b4", "b8", "case", "default"), ("b5", "b2", "back", ""), ("b6", "b2", "back", ""), ("b7", "exit", "normal", ""), ("b8", "exit", "exception", "")]
_values = lambda rows: ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in rows)
_EACH = "SELECT 'f' || c_custkey AS name, v.* FROM customer CROSS JOIN (VALUES "


def _flows(spark, d):
    k = F.col("c_custkey").cast("string")
    return flow(read(spark, d, "customer").select(F.concat(F.lit("c"), k, F.lit(".ts")).alias("path"), F.replace(F.lit(_TS), F.lit("@K@"), k).alias("text")))


@query(f"{_EACH}{_values(_FLOW)}) AS v(src, dst, kind, label)")
def cfg_extract(spark, d):
    return _flows(spark, d).where("fact = 'edge'").select("name", "src", "dst", "kind", F.coalesce("label", F.lit("")).alias("label"))


@query(f"{_EACH}{_values([(i, ('⏳ ' if w else '') + t) for i, t, w in _BLOCKS])}) AS v(id, label)")
def cfg_block_label(spark, d):
    return _flows(spark, d).where("fact = 'block'").select("name", "id", block_label(F.col("kind"), F.col("statements"), F.col("awaits")).alias("label"))


_CHART = "flowchart TD\n" + "".join(f'  {i}{a}"{"⏳ " if w else ""}{t}"{b}\n' for i, t, w in sorted(_BLOCKS, key=lambda r: (r[0] != "entry", r[0] != "exit", r[0])) for a, b in [("([", "])") if i in ("entry", "exit") else ("[", "]")])
_CHART += "".join(f"  {a} {'-.->' if k == 'exception' else '-->'}{f'|{n or k}|' if n or k != 'normal' else ''} {b}\n" for a, b, k, n in _FLOW)


@query(f"SELECT 'c' || c_custkey || '.ts' AS path, 1 AS fn, '{_CHART}' AS text FROM customer")
def export_cfg_mermaid(spark, d):
    return flow_charts(_flows(spark, d))


_TYPES = 'import { Shape@P@ as Next, type Mark@P@ } from "./c@P@";\n\n/** A mark. */\nexport interface Mark@K@ extends Mark@P@ { size: number; }\n\n/**\n * Shape number @K@.\n * @see none\n */\nexport class Shape@K@<T extends object = never> extends Next<Map<string, T>> implements Mark@K@, Gone {\n  size = 1;\n  /** Its area. */\n  area(scale: number, from?: string): number { return scale; }\n}\n\n// no doc\nexport const double = (x: number) => 2 * x;\n'
_EACH_TYPE = "WITH c AS (SELECT c_custkey AS k, c_custkey + 1 AS p, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS known, 'src/c' || c_custkey || '.ts#' AS f, 'src/c' || (c_custkey + 1) || '.ts#' AS g FROM customer) "


def _typed(spark, d):
    k, p = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 1).cast("string")
    text = F.replace(F.replace(F.lit(_TYPES), F.lit("@K@"), k), F.lit("@P@"), p)
    return analyze(read(spark, d, "customer").select(F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("path"), text.alias("text")), "typescript")[0]


@query(_EACH_TYPE + "SELECT 'implements' AS kind, 'class:' || f || 'Shape' || k AS src, 'interface:' || f || 'Mark' || k AS dst, 10 AS line FROM c UNION ALL SELECT 'extends', 'class:' || f || 'Shape' || k, 'class:' || g || 'Shape' || p, 10 FROM c WHERE known UNION ALL SELECT 'extends', 'interface:' || f || 'Mark' || k, 'interface:' || g || 'Mark' || p, 4 FROM c WHERE known")
def ts_heritage(spark, d):
    return _typed(spark, d).edges.where("kind in ('extends', 'implements')").select("kind", "src", "dst", "line")


@query(_EACH_TYPE + "SELECT 'interface:' || f || 'Mark' || k AS id, '' AS signature, 'A mark.' AS doc FROM c UNION ALL SELECT 'class:' || f || 'Shape' || k, '', 'Shape number ' || k || '.' FROM c UNION ALL SELECT 'method:' || f || 'Shape' || k || '.area', '(scale: number, from?: string): number', 'Its area.' FROM c UNION ALL SELECT 'function:' || f || 'double', '(x: number)', '' FROM c")
def ts_signature(spark, d):
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return _typed(spark, d).nodes.where("kind <> 'module'").select("id", text("signature"), text("doc"))


@query("SELECT path, fn, problem FROM (SELECT '' AS path, 0 AS fn, '' AS problem) WHERE path <> ''")
def cfg_validate(spark, d):
    return validate_flow(_flows(spark, d))


@query(f"SELECT 'c' || c_custkey || '.ts' AS path, v.src, v.dst, v.kind, string_agg(v.label, ' / ' ORDER BY v.label) AS label FROM customer CROSS JOIN (VALUES {_values(_FLOW)}) AS v(src, dst, kind, label) GROUP BY ALL")
def cfg_parallel_edges(spark, d):
    return parallel_edges(_flows(spark, d)).select("path", "src", "dst", "kind", "label")


@query("SELECT o_orderstatus AS condition, count(*) AS runs, round(avg((o_orderkey % 3 = 0)::INT), 6) AS accuracy, round(avg(o_orderkey % 7), 6) AS recall, round(avg(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END), 4) AS tokens, round(coalesce(stddev_pop(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END), 0), 4) AS deviation FROM orders GROUP BY 1")
def summarize(spark, d):
    runs = read(spark, d, "orders").selectExpr("o_orderstatus AS condition", "o_orderkey % 3 = 0 AS correct", "o_orderkey % 7 AS recall", "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS tokens")
    out = ev.summarize(runs)
    return out.select("condition", "runs", *[F.round(c, n).alias(c) for c, n in (("accuracy", 6), ("recall", 6), ("tokens", 4), ("deviation", 4))])


@query("WITH m AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS metric, CASE WHEN c_custkey % 2 = 0 AND v > 5000 THEN 'over budget' WHEN c_custkey % 3 = 0 AND v > 1200 THEN 'regressed' ELSE 'ok' END AS status FROM m")
def bench_compare(spark, d):
    m = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("metric"), F.col("c_acctbal").cast("double").alias("value"), "c_custkey")
    fixed = lambda k, v: m.where(F.col("c_custkey") % k == 0).select("metric", F.lit(v).alias("value"))
    return ev.compare_bench(m, fixed(2, 5000.0), fixed(3, 1000.0)).select("metric", "status")


@query("SELECT doc_id AS question, round((regexp_matches(text, '(^|[^\\w$])(' || w || ')([^\\w$]|$)')::INT + contains(text, 'e.t')::INT) / 2, 4) AS recall FROM (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE 'de' END AS w FROM documents)")
def score_answer(spark, d):
    docs = read(spark, d, "documents").select(F.lit("run").alias("run"), F.col("doc_id").alias("question"), "text")
    word = F.when(F.col("question") % 2 == 0, "the").otherwise("de")
    gold = docs.select("question", F.explode(F.array(F.struct(F.lit("symbol").alias("kind"), word.alias("expected")), F.struct(F.lit("file").alias("kind"), F.lit("a/e.t").alias("expected")))).alias("g"), F.lit(None).cast("int").alias("minimum")).select("question", "g.*", "minimum")
    return ev.score_answers(docs, gold).select("question", F.round("recall", 4).alias("recall"))


@query("SELECT 'symbol' AS kind, 'Customer#missing' || c_custkey AS expected FROM customer")
def gold_verify(spark, d):
    g = trade(spark, d)
    c = read(spark, d, "customer")
    gold = c.select(F.lit("symbol").alias("kind"), F.explode(F.array("c_name", F.concat(F.lit("Customer#missing"), F.col("c_custkey").cast("string")))).alias("expected"))
    return ev.verify_gold(gold, g.nodes)


@query("SELECT '@s/p' || s_suppkey AS name, 'packages/p' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '/src/index.ts' WHEN 1 THEN '/lib/main.js' ELSE '/mod.ts' END AS entry FROM supplier")
def scan_packages(spark, d):
    return packages(_workspace(spark, d)).select("name", "entry")


@query("WITH p AS (SELECT '@s/p' || s_suppkey AS n, 'packages/p' || s_suppkey AS r, s_suppkey % 3 AS m FROM supplier) SELECT n AS pattern, r || CASE m WHEN 0 THEN '/src/index.ts' WHEN 1 THEN '/lib/main.js' ELSE '/mod.ts' END AS target FROM p UNION ALL SELECT n || '/*', r || CASE m WHEN 0 THEN '/src' WHEN 1 THEN '/lib' ELSE '' END || '/*' FROM p")
def package_aliases(spark, d):
    return aliases_of(packages(_workspace(spark, d)))


def _workspace(spark, d):
    root = F.concat(F.lit("packages/p"), F.col("s_suppkey").cast("string"))
    m = F.col("s_suppkey") % 3
    name = F.concat(F.lit('{"name": "@s/p'), F.col("s_suppkey").cast("string"), F.lit('"}'))
    rows = [("/package.json", F.lit(True)), ("/src/index.ts", m == 0), ("/lib/main.js", m < 2), ("/mod.ts", F.lit(True))]
    file = F.explode(F.filter(F.array(*[F.when(c, F.concat(root, F.lit(p))) for p, c in rows]), lambda x: x.isNotNull())).alias("path")
    return read(spark, d, "supplier").select(file, name.alias("text"))


@query("SELECT n_nationkey AS pos, CASE WHEN rn > 1 THEN n || '~' || rn ELSE n END AS prefix FROM (SELECT n_nationkey, 'r' || n_regionkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation)")
def root_prefix(spark, d):
    roots = read(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("name"))
    return root_prefixes(roots).select("pos", "prefix")
