"""Queries of data flow, exporters and scalar functions, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..export import text as ex
from ..frontends.dataflow import sites
from ..functions import text as tx
from ..schema import CodeGraph
from ..sources.packages import prefixed, split_roots
from .graphs import read
from .queries import query

_BODY = "function f@K@(a) {\n  let n = a;\n  const g = () => { n += 1; };\n  return n;\n}\n"
_SITES = [("f", "a", "write", 1, False), ("f", "a", "read", 2, False), ("f", "n", "write", 2, False), ("f", "g", "write", 3, False), ("f", "n", "read", 4, False), ("g", "n", "read", 3, True), ("g", "n", "write", 3, True)]


@query("SELECT c_custkey AS k, v.* FROM customer CROSS JOIN (VALUES " + ", ".join(f"('{f}', '{v}', '{a}', {n}, {str(c).lower()})" for f, v, a, n, c in _SITES) + ") AS v(fn, variable, access, line, captured)")
def dataflow_extract(spark, d):
    k = F.col("c_custkey").cast("string")
    found = sites(read(spark, d, "customer").select(k.alias("path"), F.replace(F.lit(_BODY), F.lit("@K@"), k).alias("text")))
    return found.select(F.col("path").cast("long").alias("k"), F.substring("name", 1, 1).alias("fn"), "variable", "access", "line", "captured")


def _regions(spark, d) -> CodeGraph:
    """Regions as modules that import the next one: five rows, for the text exporters."""
    r = read(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"))
    nodes = r.select(F.concat(F.lit("module:"), "name").alias("id"), F.lit("module").alias("kind"), "name", F.col("name").alias("qn"), F.col("name").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("boolean").alias("exported"), F.lit(None).cast("boolean").alias("external"), *[F.lit(None).cast("string").alias(c) for c in ("signature", "doc")])
    to = r.select((F.col("r_regionkey") - 1).alias("r_regionkey"), F.col("name").alias("to"))
    e = r.join(to, "r_regionkey").select(F.concat(F.lit("imports:module:"), "name", F.lit("->module:"), "to").alias("id"), F.lit("imports").alias("kind"), F.concat(F.lit("module:"), "name").alias("src"), F.concat(F.lit("module:"), "to").alias("dst"), *[F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("cnt", "long"), ("type_only", "boolean"), ("low", "boolean"), ("in_cycle", "boolean"))])
    return CodeGraph(nodes, e)


def _places(spark, d) -> CodeGraph:
    """Regions as folders that contain their nations, modules that import the next one."""
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("folder"))
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    no = lambda *typed: [F.lit(None).cast(t).alias(c) for c, t in typed]
    rest = no(("exported", "boolean"), ("external", "boolean"), ("signature", "string"), ("doc", "string"))
    folders = r.select(F.concat(F.lit("folder:"), "folder").alias("id"), F.lit("folder").alias("kind"), F.col("folder").alias("name"), F.col("folder").alias("qn"), *no(("file", "string"), ("start_line", "int"), ("end_line", "int")), *rest)
    modules = n.select(F.concat(F.lit("module:"), "name").alias("id"), F.lit("module").alias("kind"), "name", F.col("name").alias("qn"), F.col("name").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), *rest)
    holds = n.join(r, "region").select(F.lit("contains").alias("kind"), F.concat(F.lit("folder:"), "folder").alias("src"), F.concat(F.lit("module:"), "name").alias("dst"))
    to = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("name").alias("to"))
    uses = n.join(to, "n_nationkey").select(F.lit("imports").alias("kind"), F.concat(F.lit("module:"), "name").alias("src"), F.concat(F.lit("module:"), "to").alias("dst"))
    edges = holds.unionByName(uses).select(F.concat("kind", F.lit(":"), "src", F.lit("->"), "dst").alias("id"), "kind", "src", "dst", *no(("line", "int"), ("cnt", "long"), ("type_only", "boolean"), ("low", "boolean"), ("in_cycle", "boolean")))
    return CodeGraph(folders.unionByName(modules), edges)


PLACES = r"""WITH f AS (SELECT r_regionkey AS region, 'folder:' || r_name AS id, r_name AS name, regexp_replace('folder:' || r_name, '[^A-Za-z0-9]', '_', 'g') AS n FROM region),
m AS (SELECT n_nationkey AS k, n_regionkey AS region, 'module:' || n_name AS id, n_name AS name, regexp_replace('module:' || n_name, '[^A-Za-z0-9]', '_', 'g') AS n FROM nation),
u AS (SELECT a.id AS src, b.id AS dst, a.n AS sn, b.n AS dn, 'imports:' || a.id || '->' || b.id AS id FROM m a JOIN m b ON b.k = a.k + 1),
"""


def _export(key: str, run, inner: str, outer: str, edge: str, text: str) -> None:
    """The whole text of an export of the regions and nations. ``inner``: a nation's lines, ``outer``: a region's around ``held``."""

    def f(spark, d):
        return spark.createDataFrame([(run(_places(spark, d)),)], "text string")

    held = f"h AS (SELECT region, string_agg({inner}, '' ORDER BY id) AS held FROM m GROUP BY region), b AS (SELECT string_agg({outer}, '' ORDER BY f.id) AS boxes FROM f JOIN h USING (region)), l AS (SELECT string_agg({edge}, '' ORDER BY id) AS links FROM u)"
    query(f"{PLACES}{held} SELECT replace({text}, '~', chr(10)) AS text FROM b, l", key)(f)


_export("export_mermaid", ex.to_mermaid, """'    ' || n || '["' || name || '"]~'""", """'  subgraph ' || n || '["' || name || '"]~' || held || '  end~'""", "'  ' || sn || ' -.->|imports| ' || dn || '~'", "'flowchart LR~' || boxes || links")
_export("export_dot", ex.to_dot, """'    "' || id || '" [label="' || name || '", tooltip="module"];~'""", """'  subgraph "cluster_' || f.id || '" {~    label="' || name || '";~    "' || f.id || '" [label="' || name || '", tooltip="folder"];~' || held || '  }~'""", """'  "' || src || '" -> "' || dst || '" [label="imports"];~'""", "'digraph G {~' || boxes || links || '}~'")
_export("export_plantuml", ex.to_plantuml, """'  component "' || name || '" as ' || n || '~'""", """'package "' || name || '" as ' || n || ' {~' || held || '}~'""", "sn || ' ..> ' || dn || ' : imports~'", "'@startuml~' || boxes || links || '@enduml~'")


def export_json(spark, d):
    return spark.createDataFrame([(ex.to_json(_places(spark, d)),)], "text string")


_OBJECT = "'    {{~      ' || array_to_string([{0}], ',~      ') || '~    }}'"
_FIELD = """'"{0}": "' || {1} || '"'"""
_LINK = _OBJECT.format(", ".join(_FIELD.format(k, v) for k, v in (("from", "src"), ("id", "id"), ("kind", "kind"), ("to", "dst"))))
_NODE = _OBJECT.format(", ".join(_FIELD.format(k, v) for k, v in (("id", "id"), ("kind", "kind"), ("name", "name"), ("qualifiedName", "name"))) + ", span")
_SPAN = """'"span": {~        "endLine": 1,~        "file": "' || name || '",~        "startLine": 1~      }'"""
query(f"""{PLACES} e AS (SELECT 'contains:' || f.id || '->' || m.id AS id, 'contains' AS kind, f.id AS src, m.id AS dst FROM f JOIN m USING (region) UNION ALL SELECT id, 'imports', src, dst FROM u),
x AS (SELECT id, 'folder' AS kind, name, NULL AS span FROM f UNION ALL SELECT id, 'module', name, {_SPAN} FROM m),
t AS (SELECT (SELECT string_agg({_LINK}, ',~' ORDER BY id) FROM e) AS links, (SELECT string_agg({_NODE}, ',~' ORDER BY id) FROM x) AS boxes)
SELECT replace('{{~  "edges": [~' || links || '~  ],~  "nodes": [~' || boxes || '~  ],~  "schemaVersion": 1~}}~', '~', chr(10)) AS text FROM t""", "export_json")(export_json)


@query("SELECT doc_id, CAST(ceil(length(text) / 3.7) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, length(text) >= 20000 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 400 AS minified FROM documents")
def looks_minified(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.looks_minified(F.col("text")).alias("minified"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


_FILE = "CASE p_partkey % 4 WHEN 0 THEN 'src/test_' || p_partkey || '.py' WHEN 1 THEN 'lib/spec/a.ts' WHEN 2 THEN './b.JSX' ELSE '../c.min.css' END"
_PARTS = f"WITH p AS (SELECT p_partkey, {_FILE} AS path, p_partkey % 4 AS m FROM part) SELECT p_partkey, "


def _paths(spark, d):
    return read(spark, d, "part").withColumn("path", F.expr(_FILE))


def _scalar(key: str, sql: str, column) -> None:
    query(f"{_PARTS}{sql} AS v FROM p", key)(lambda spark, d: _paths(spark, d).select("p_partkey", column(F.col("path")).alias("v")))


_scalar("is_test_file", "m < 2", lambda path: tx.is_test_file(path))
_scalar("is_relative", "m > 1", lambda path: tx.is_relative(path))
_scalar("top_segment", "split_part(path, '/', 1)", lambda path: tx.top_segment(path))
_scalar("fuzzy_match", "m = 0", lambda path: tx.fuzzy_match(path, "SPY"))
_scalar("glob_any", "m = 0 OR m = 3", lambda path: tx.glob_column(path, ["src/**", "**/*.css"]))
_scalar("brace_expand", "m < 2", lambda path: tx.glob_column(path, ["{src,lib}/**/*.{py,ts}"]))
_scalar("glob_defaults", "m < 2", lambda path: tx.glob_column(path, tx.DEFAULT_INCLUDE))
_scalar("adapter_for_path", "['python', 'typescript', 'typescript', ''][m + 1]", lambda path: F.coalesce(tx.language(path), F.lit("")))
_scalar("root_prefix_path", "CASE WHEN m = 0 THEN path ELSE 'r' || m || '/' || path END", lambda path: prefixed(path, F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("p_partkey") % 4).cast("string")))))
_scalar("display_label", "CASE WHEN m < 2 THEN path || '()' ELSE path END", lambda path: tx.display_label(F.when(F.col("p_partkey") % 4 == 0, "function").when(F.col("p_partkey") % 4 == 1, "method").otherwise("class"), path))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN ['web', 'api'][p_partkey % 3 + 1] END AS root, CASE WHEN p_partkey % 3 < 2 THEN 'src/a' || p_partkey || '.ts' END AS rest FROM part")
def root_split_path(spark, d):
    head = F.element_at(F.array(F.lit("web"), F.lit("api"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    paths = read(spark, d, "part").select("p_partkey", F.concat(head, F.lit("/src/a"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))
    return split_roots(paths, spark.createDataFrame([(0, "web"), (1, "api")], "pos int, name string")).select("p_partkey", "root", "rest")


@query("SELECT p_partkey, ['#4c78a8', '#f58518', '#555555'][CAST(p_partkey % 3 AS INT) + 1] AS colour FROM part")
def palette(spark, d):
    kind = F.element_at(F.array(F.lit("module"), F.lit("class"), F.lit("unknown")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", tx.palette(kind, tx.NODE_COLOURS).alias("colour"))
