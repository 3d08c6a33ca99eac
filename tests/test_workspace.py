"""Packages, aliases, roots and evaluation on small tables."""

from weftgraph.operators import evaluation as ev
from weftgraph.sources import packages as pk


def test_packages_and_aliases(spark):
    files = [("package.json", '{"name": "root"}'), ("index.ts", ""), ("p/a/package.json", '{"name": "a"}'), ("p/a/src/main.ts", ""), ("p/a/index.js", ""), ("z/package.json", '{"name": "a"}'), ("z/mod.js", ""), ("q/package.json", "not json"), ("1/2/3/4/5/6/package.json", '{"name": "deep"}'), ("1/2/3/4/5/6/index.ts", "")]
    found = pk.packages(spark.createDataFrame(files, "path string, text string"))
    assert {r["name"]: r["entry"] for r in found.collect()} == {"root": "index.ts", "a": "p/a/src/main.ts"}
    assert pk.alias_map(found, {"a": ["x"]}) == {"a": ["x"], "a/*": ["p/a/src/*"], "root": ["index.ts"], "root/*": ["*"]}


def test_tsconfig():
    text = '{ // base\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "up": ["../../../x"], "u//": ["../a",]}}, }'
    assert pk.tsconfig_aliases(text, "pkg") == ({"@/*": ["pkg/src/*"], "u//": ["pkg/a"]}, None)
    assert pk.tsconfig_aliases("{", "")[1] == "tsconfig can't be read"
    assert pk.tsconfig_aliases("{}", "")[1] == "tsconfig has no paths"


def test_roots(spark):
    one = spark.createDataFrame([(0, "a")], "pos int, name string")
    assert [r["prefix"] for r in pk.root_prefixes(one).collect()] == [""]
    many = pk.root_prefixes(one.union(spark.createDataFrame([(1, "a"), (2, "b")], one.schema)))
    assert [r["prefix"] for r in many.orderBy("pos").collect()] == ["a", "a~2", "b"]


def test_scores(spark):
    answers = spark.createDataFrame([("r", 1, "calls run_all and a.ts"), ("r", 2, None)], "run string, question int, text string")
    gold = spark.createDataFrame([(1, "symbol", "run", None), (1, "symbol", "run_all", 1), (1, "file", "src/a.ts", None), (2, "symbol", "x", None)], "question int, kind string, expected string, minimum int")
    got = {r["question"]: (round(r["recall"], 3), r["correct"]) for r in ev.score_answers(answers, gold).collect()}
    assert got == {1: (0.667, True), 2: (0.0, False)}


def test_queries_register_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as s; q, o = s.queries(), s.oracle_sql(); assert len(q) > 90 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
