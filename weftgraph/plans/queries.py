"""A query for each operator over the driver's tables, and the SQL that expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answers as an
from ..operators import hierarchy as hi
from ..operators import rank as rk
from ..operators import relational as rl
from ..operators import traverse as tv
from ..schema import CodeGraph
from .graphs import CHAIN, EVENTS, FOLDERS, LIFT, MODULES, TRADE, chain, read, trade, transitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _edges(df: DataFrame) -> DataFrame:
    return df.select("id", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"), F.coalesce("type_only", F.lit(False)).alias("type_only"), F.coalesce("low", F.lit(False)).alias("low"))


E = "SELECT id, coalesce(line, -1) AS line, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt, coalesce(type_only, false) AS type_only, coalesce(low, false) AS low FROM "


@query(f"WITH {MODULES} SELECT src, dst, CAST(coalesce(cnt, 1) AS BIGINT) AS uses FROM medges WHERE kind = 'imports'")
def q_nation_dependencies(spark, d):
    """Which nations depend on which, with merged counts."""
    return hi.collapse_modules(trade(spark, d)).edges.where("kind = 'imports'").select("src", "dst", F.coalesce("cnt", F.lit(1)).cast("long").alias("uses"))


@query(f"WITH {TRADE} {E} edges")
def merge_edges(spark, d):
    return _edges(trade(spark, d).edges)


@query(f"WITH {TRADE}, up AS (SELECT id, 'module:' || file AS t FROM nodes WHERE file IS NOT NULL), l AS ({LIFT.format(edges='edges', target='up', where='')}) {E} l")
def lift_edges(spark, d):
    g = trade(spark, d)
    return _edges(rl.lift_edges(g.edges, g.nodes.where("file is not null").select("id", F.concat(F.lit("module:"), "file").alias("to")), ()))


@query(f"WITH {MODULES} {E} medges")
def collapse_modules(spark, d):
    return _edges(hi.collapse_modules(trade(spark, d)).edges)


@query(f"WITH {FOLDERS} {E} fedges")
def collapse_folders(spark, d):
    return _edges(hi.collapse_folders(trade(spark, d), 1).edges)


@query("SELECT 1 AS depth")
def best_folder_depth(spark, d):
    return spark.createDataFrame([(hi.best_folder_depth(trade(spark, d)),)], "depth int")


@query(f"WITH {TRADE} SELECT id FROM nodes UNION SELECT 'folder:' || split_part(path, '/', 1) FROM nat")
def folder_hierarchy(spark, d):
    return hi.folder_hierarchy(trade(spark, d)).nodes.select("id")


_X = "module:AFRICA/NATION_0"


@query(f"WITH {TRADE}, up AS (SELECT id, CASE WHEN external THEN id WHEN kind = 'class' AND 'module:' || file = '{_X}' THEN id WHEN kind = 'method' AND 'module:' || file = '{_X}' THEN 'class:' || file || '#' || split_part(qn, '.', 1) ELSE 'module:' || file END AS t FROM nodes), l AS ({LIFT.format(edges='edges', target='up', where='')}) {E} l")
def expand_nodes(spark, d):
    return _edges(hi.expand_nodes(trade(spark, d), [_X]).edges)


@query(f"WITH {TRADE} SELECT DISTINCT src AS id FROM edges WHERE kind = 'contains' AND src <> '{_X}'")
def expandable_ids(spark, d):
    g = trade(spark, d)
    return hi.expandable_ids(g, g.nodes, [_X])


@query(f"WITH {FOLDERS}, c AS (SELECT (SELECT count(*) FROM mnodes) AS modules, (SELECT count(*) FROM mnodes WHERE external) + (SELECT count(DISTINCT t) FROM fold) AS folders, (SELECT count(*) FROM medges) AS flat_edges) SELECT *, CASE WHEN (modules > 40 OR flat_edges > 600) AND folders < modules THEN 'folders' ELSE 'modules' END AS level, false AS refused FROM c")
def fold_decision(spark, d):
    g = trade(spark, d)
    return hi.fold_decision(hi.collapse_modules(g), hi.collapse_folders(g))


@query(f"WITH {TRADE} SELECT dst AS id, CAST(sum(coalesce(cnt, 1)) AS BIGINT) AS inbound FROM edges WHERE kind IN ('calls', 'imports') GROUP BY 1")
def inbound_weight(spark, d):
    return rl.inbound_weight(trade(spark, d).edges)


@query(f"WITH {TRADE}, x AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges WHERE kind <> 'contains' UNION ALL SELECT dst, 0, 1 FROM edges WHERE kind <> 'contains') SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY 1")
def degrees(spark, d):
    return rl.degrees(trade(spark, d).edges)


@query(f"WITH {TRADE} SELECT count(*) AS flat_edges FROM edges WHERE kind <> 'contains'")
def flat_edge_count(spark, d):
    return trade(spark, d).edges.where("kind <> 'contains'").agg(F.count("*").alias("flat_edges"))


@query(f"WITH {TRADE} SELECT id, round(CAST(coalesce(cnt, 1) AS DOUBLE) * CASE WHEN low THEN 0.5 ELSE 1 END * CASE WHEN type_only THEN 0.25 ELSE 1 END, 4) AS weight FROM edges WHERE kind <> 'contains'")
def edge_weight(spark, d):
    e = trade(spark, d).edges.where("kind <> 'contains'")
    return e.select("id", F.round(rl.edge_weight(e), 4).alias("weight"))


_KEEP = "(file LIKE 'ASIA/%' OR file LIKE 'EUROPE/%') AND file NOT LIKE '%/NATION_5' AND kind IN ('module', 'class')"


@query(f"WITH {TRADE}, k AS (SELECT id FROM nodes WHERE {_KEEP}) SELECT id FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def filter_graph(spark, d):
    return rl.filter_graph(trade(spark, d), ["module", "class"], ["{ASIA,EUROPE}/**"], ["**/NATION_5"]).edges.select("id")


@query(f"WITH {TRADE}, k AS (SELECT id FROM nodes WHERE kind = 'class' OR kind = 'method') SELECT id FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def induced_subgraph(spark, d):
    g = trade(spark, d)
    return rl.induced(g, g.nodes.where("kind in ('class', 'method')").select("id")).edges.select("id")


@query(f"WITH {TRADE} SELECT dst AS id, src AS parent FROM edges WHERE kind = 'contains'")
def contains_parents(spark, d):
    return rl.parents(trade(spark, d).edges)


@query(f"WITH {TRADE} SELECT e.id FROM edges e WHERE e.dst NOT LIKE 'module:external:%'")
def drop_external(spark, d):
    return rl.drop_external(trade(spark, d)).edges.select("id")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE NOT external OR kind = 'module'")
def drop_sinks(spark, d):
    return rl.drop_sinks(trade(spark, d)).nodes.select("id")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE NOT external OR id IN (SELECT dst FROM edges)")
def drop_unreferenced_external(spark, d):
    return rl.drop_unreferenced_external(trade(spark, d)).nodes.select("id")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE file LIKE 'ASIA/%' OR kind = 'class' AND file LIKE 'A%'")
def union_graphs(spark, d):
    g = trade(spark, d)
    return rl.union_graphs(rl.filter_graph(g, include=["ASIA/**"]), rl.filter_graph(g, kinds=["class"], include=["A*/**"])).nodes.select("id")


@query(f"WITH {TRADE}, m AS (SELECT id, CASE WHEN external THEN id ELSE regexp_replace(id, '^([a-z]+):', '\\1:root/') END AS new FROM nodes) SELECT kind || ':' || a.new || '->' || b.new AS id FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst")
def rebase_graph(spark, d):
    return rl.rebase(trade(spark, d), "root").edges.select("id")


@query(f"WITH {TRADE} SELECT coalesce(n.file, '__shared__') AS owner, count(*) AS edges FROM edges e JOIN nodes n ON n.id = e.src GROUP BY 1")
def fragment_split(spark, d):
    return rl.fragment_split(trade(spark, d))[1].groupBy("owner").agg(F.count("*").alias("edges"))


@query(f"WITH {TRADE} SELECT id, name || '2' AS name FROM nodes WHERE file IS NOT NULL OR id IN (SELECT dst FROM edges)")
def fragment_merge(spark, d):
    g = trade(spark, d)
    old, new = g.nodes.withColumn("at", F.lit(1)), g.nodes.withColumns({"name": F.concat("name", F.lit("2")), "at": F.lit(2)})
    return rl.fragment_merge(old.unionByName(new), g.edges.withColumn("at", F.lit(1)), "at").nodes.select("id", "name")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE false")
def validate_graph(spark, d):
    return rl.validate(trade(spark, d)).select(F.col("message").alias("id"))


@query(f"WITH {TRADE} SELECT id, file, name || CASE WHEN kind = 'method' THEN '()' ELSE '' END AS label, CASE kind WHEN 'class' THEN 'class' WHEN 'method' THEN 'method' ELSE 'module' END || ' ' || name || CASE WHEN external THEN ' (external)' ELSE '' END || coalesce(' ·' || start_line, '') AS text FROM nodes")
def symbol_text(spark, d):
    c = F.col
    return trade(spark, d).nodes.select("id", "file", tx.display_label(c("kind"), c("name")).alias("label"), an.symbol_text(c("kind"), c("name"), c("signature"), c("external"), c("start_line")).alias("text"))


@query(f"WITH {TRADE} SELECT coalesce(file, '(external)') AS file, string_agg(CASE kind WHEN 'class' THEN 'class' ELSE 'module' END || ' ' || name || CASE WHEN external THEN ' (external)' ELSE '' END || coalesce(' ·' || start_line, ''), chr(10) ORDER BY coalesce(start_line, 0), id) AS symbols FROM nodes WHERE kind <> 'method' GROUP BY 1")
def group_nodes_by_file(spark, d):
    return an.group_by_file(trade(spark, d).nodes.where("kind <> 'method'"))


@query(f"WITH {TRADE} SELECT 'resolved' AS status, id FROM nodes WHERE kind = 'class' AND name = 'Customer#000000001'")
def resolve_symbol(spark, d):
    n = trade(spark, d).nodes
    return an.resolve_symbol(n, n.where("kind = 'class' and name like 'Customer%1'").select("name").orderBy("name").first()["name"])


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE kind = 'module' AND qn = 'AFRICA/NATION_0'")
def resolve_module(spark, d):
    return an.resolve_module(trade(spark, d).nodes, "AFRICA/NATION_0")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE kind NOT IN ('module', 'folder') AND (lower(name) LIKE '%99%' OR lower(qn) LIKE '%99%')")
def query_defs(spark, d):
    return an.definitions(trade(spark, d).nodes, "99").select("id")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE lower(name) LIKE '%customer%' OR lower(qn) LIKE '%customer%' ORDER BY id LIMIT 5")
def suggestions_limit(spark, d):
    return an.suggestions(trade(spark, d).nodes, "Customer").select("id")


@query(f"WITH {TRADE}, e AS (SELECT *, CASE WHEN coalesce(low, false) OR coalesce(type_only, false) THEN 'muted' ELSE 'normal' END AS tone, round(least(1.2 + 0.75 * log2(coalesce(cnt, 1)), 3.5), 2) AS width FROM edges) SELECT kind, tone, width, count(*) AS edges FROM e GROUP BY ALL")
def edge_emphasis(spark, d):
    tone, width = tx.emphasis(*[F.col(c) for c in ("kind", "cnt", "type_only", "low", "in_cycle")])
    return trade(spark, d).edges.groupBy("kind", tone.alias("tone"), width.alias("width")).agg(F.count("*").alias("edges"))


@query(f"WITH {TRADE} SELECT DISTINCT 'node' AS what, kind FROM nodes UNION SELECT DISTINCT 'edge', kind FROM edges")
def legend_presence(spark, d):
    g = trade(spark, d)
    return g.nodes.select(F.lit("node").alias("what"), "kind").union(g.edges.select(F.lit("edge").alias("what"), "kind")).distinct()


def _rank_sql(personal: bool) -> str:
    """Forty passes over the module graph, each a table of its own."""
    start = "id = 'module:AFRICA/NATION_0'" if personal else "true"
    sql = f"""WITH {MODULES}, w AS (SELECT src, dst, coalesce(cnt, 1) * CASE WHEN low THEN 0.5 ELSE 1.0 END * CASE WHEN type_only THEN 0.25 ELSE 1.0 END AS w FROM medges),
t AS (SELECT src, sum(w) AS total FROM w GROUP BY 1), p AS MATERIALIZED (SELECT src, dst, sum(CAST(w AS DOUBLE) / total) AS p FROM w JOIN t USING (src) GROUP BY 1, 2),
b AS MATERIALIZED (SELECT id, CASE WHEN {start} THEN 1.0 / (SELECT count(*) FROM mnodes WHERE {start}) ELSE 0.0 END AS r, id IN (SELECT src FROM p) AS flows FROM mnodes), s0 AS (SELECT id, CAST(r AS DOUBLE) AS s FROM b)"""
    for k in range(40):
        sql += f", s{k + 1} AS MATERIALIZED (SELECT b.id, 0.85 * coalesce(g, 0) + r * (0.15 + 0.85 * (SELECT coalesce(sum(s), 0) FROM s{k} JOIN b USING (id) WHERE NOT flows)) AS s FROM b LEFT JOIN (SELECT dst AS id, sum(s * p) AS g FROM p JOIN s{k} ON s{k}.id = src GROUP BY 1) USING (id))"
    return sql + " SELECT id, round(s, 6) AS score FROM s40"


@query(_rank_sql(False))
def pagerank(spark, d):
    return rk.pagerank(hi.collapse_modules(trade(spark, d))).select("id", F.round("score", 6).alias("score"))


@query(_rank_sql(True))
def pagerank_personalized(spark, d):
    return rk.pagerank(hi.collapse_modules(trade(spark, d)), seeds=["module:AFRICA/NATION_0"]).select("id", F.round("score", 6).alias("score"))


_MAP = f"WITH {TRADE}, r AS (SELECT n.id, n.file, coalesce(i.inbound, 0) AS inbound, '  ' || n.kind || ' ' || name || coalesce(' ·' || start_line, '') || CASE WHEN i.inbound > 0 THEN ' ←' || i.inbound ELSE '' END AS line FROM nodes n LEFT JOIN (SELECT dst AS id, sum(coalesce(cnt, 1)) AS inbound FROM edges WHERE kind IN ('calls', 'imports') GROUP BY 1) i USING (id) WHERE kind <> 'module'), o AS (SELECT *, row_number() OVER (ORDER BY inbound DESC, id) AS pos, row_number() OVER (PARTITION BY file ORDER BY inbound DESC, id) AS f FROM r), c AS (SELECT *, sum(length(line) + 1 + CASE WHEN f = 1 THEN length(file) + 1 ELSE 0 END) OVER (ORDER BY pos) AS chars FROM o), shown AS (SELECT CAST(pos AS INT) AS pos, file, line, CAST(chars AS BIGINT) AS chars FROM c WHERE ceil(chars / 3.7) <= 500 OR pos = 1)"


def _map(spark, d):
    g = trade(spark, d)
    ranks = g.nodes.select("id").join(rl.inbound_weight(g.edges), "id", "left").select("id", F.coalesce("inbound", F.lit(0)).cast("double").alias("score"))
    return an.repo_map(g, ranks, 500)


@query(_MAP + " SELECT * FROM shown")
def repo_map(spark, d):
    return _map(spark, d)


@query(_MAP + " SELECT file, min(pos) AS best, count(*) AS symbols FROM shown GROUP BY 1")
def repo_map_group(spark, d):
    return an.map_by_file(_map(spark, d))


_AT = "function:chain#1"


def _walk_sql(seed: str, reverse: bool, depth: int | None) -> str:
    s, t = ("dst", "src") if reverse else ("src", "dst")
    return f"WITH RECURSIVE {CHAIN}, walk AS (SELECT {seed} AS id, 0 AS depth UNION SELECT e.{t}, walk.depth + 1 FROM walk JOIN edges e ON e.{s} = walk.id {'WHERE walk.depth < ' + str(depth) if depth else ''}) SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1"


@query(_walk_sql(f"'{_AT}'", False, None))
def reachable_from(spark, d):
    return tv.reach(chain(spark, d), [_AT])


@query(_walk_sql(f"'{_AT}'", True, None))
def reached_by(spark, d):
    return tv.reach(chain(spark, d), [_AT], reverse=True)


@query(_walk_sql(f"'{_AT}'", False, 2))
def query_callees(spark, d):
    return tv.reach(chain(spark, d), [_AT], kinds=("calls",), max_depth=2)


@query(_walk_sql(f"'{_AT}'", True, 2))
def query_callers(spark, d):
    return tv.reach(chain(spark, d), [_AT], kinds=("calls",), max_depth=2, reverse=True)


@query(_walk_sql("unnest(['function:chain#1', 'function:chain#2', 'function:chain#3'])", True, 2))
def multi_source_reach(spark, d):
    return tv.reach(chain(spark, d), ["function:chain#1", "function:chain#2", "function:chain#3"], max_depth=2, reverse=True)


@query(f"WITH RECURSIVE {CHAIN}, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), walk AS (SELECT '{_AT}' AS id, 0 AS depth UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN both_ways e ON e.src = walk.id WHERE walk.depth < 3) SELECT DISTINCT id FROM walk")
def slice_around(spark, d):
    return tv.slice_around(chain(spark, d), _AT, 3).nodes.select("id")


@query("WITH RECURSIVE edges AS (SELECT 'a' AS src), " + EVENTS.replace("edges AS", "edges2 AS").replace("FROM edges", "FROM edges2").replace("JOIN edges", "JOIN edges2").strip() + ", walk AS (SELECT 'module:signup/0' AS id, ['module:signup/0'] AS p, 0 AS d UNION ALL SELECT dst, list_append(p, dst), d + 1 FROM walk JOIN edges2 ON src = id WHERE d < 6 AND NOT list_contains(p, dst) AND (dst LIKE '%/0' OR dst LIKE '%/1' OR dst LIKE '%/2')) , best AS (SELECT p FROM walk WHERE id = 'module:signup/2' ORDER BY d, p LIMIT 1) SELECT CAST(i - 1 AS INT) AS pos, p[i] AS id FROM best, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)")
def shortest_path(spark, d):
    return tv.shortest_path(transitions(spark, d), "module:signup/0", "module:signup/2")


_SCC = f"WITH RECURSIVE {EVENTS}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), scc AS (SELECT id, coalesce(least(id, (SELECT min(c.dst) FROM closure c JOIN closure r ON r.src = c.dst AND r.dst = c.src WHERE c.src = ids.id)), id) AS scc FROM ids)"


@query(_SCC + " SELECT id, scc FROM scc")
def scc(spark, d):
    return rk.scc(transitions(spark, d).edges.select("src", "dst"))


@query(f"WITH RECURSIVE {EVENTS} SELECT DISTINCT src AS id FROM closure WHERE src = dst")
def vertices_in_cycles(spark, d):
    return rk.vertices_in_cycles(transitions(spark, d).edges.select("src", "dst"))


@query(f"WITH RECURSIVE {EVENTS}, cyc AS (SELECT DISTINCT src AS id FROM closure WHERE src = dst) SELECT 'imports:' || src || '->' || dst AS id, src IN (FROM cyc) AND dst IN (FROM cyc) AS in_cycle FROM edges")
def mark_import_cycles(spark, d):
    return rk.mark_import_cycles(transitions(spark, d)).select("id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


@query(_SCC + " SELECT 'imports:' || src || '->' || dst AS id, a.scc = b.scc AND (src <> dst AND true OR src = dst) AND (SELECT count(*) FROM scc x WHERE x.scc = a.scc) + (src = dst)::INT > 1 AS in_cycle FROM edges JOIN scc a ON a.id = src JOIN scc b ON b.id = dst", "mark_import_cycles_strict")
def _strict(spark, d):
    return rk.mark_import_cycles(transitions(spark, d), strict=True).select("id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


@query("WITH l AS (SELECT (SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey) AS file, c_name, c_custkey * 100 + 50 AS line FROM customer) SELECT file, CAST(line AS INT) AS line, 'class:' || file || '#' || c_name AS id FROM l")
def enclosing(spark, d):
    """A line in every customer's class."""
    g = trade(spark, d)
    lines = g.nodes.where("kind = 'class' and start_line is not null").select("file", (F.col("start_line") + 49).alias("line"))
    return an.enclosing(g.nodes, lines)


@query(f"WITH {TRADE}, ch AS (SELECT id FROM nodes WHERE id = 'module:AFRICA/NATION_0'), one AS (SELECT DISTINCT src AS id FROM edges WHERE kind = 'imports' AND dst IN (FROM ch)), two AS (SELECT DISTINCT src AS id FROM edges WHERE kind = 'imports' AND dst IN (FROM one)) SELECT id, CASE WHEN id IN (FROM ch) THEN 'changed' ELSE 'reached' END AS role, false AS is_test FROM (SELECT id FROM ch UNION SELECT id FROM one UNION SELECT id FROM two)")
def impact(spark, d):
    return an.impact(trade(spark, d), spark.createDataFrame([("AFRICA/NATION_0", 900000000)], "file string, line int"))


_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"SELECT page_id, regexp_matches({_PATH}, '^(?:.*/)?[^/]*\\.example\\.(com|org)/.*$') AS globbed, split_part({_PATH}, '/', 1) AS top, regexp_matches(lower(url), 't.*h.*e.*9') AS fuzzy FROM pages")
def glob_match(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, d, "pages").select("page_id", tx.glob_column(path, ["**/*.example.{com,org}/**"]).alias("globbed"), tx.top_segment(path).alias("top"), tx.fuzzy_match(F.col("url"), "the9").alias("fuzzy"))


_P = "CASE doc_id % 5 WHEN 0 THEN 'src/test_' || doc_id || '.py' WHEN 1 THEN 'spec/a.ts' WHEN 2 THEN 'lib/x.spec.mjs' WHEN 3 THEN './lib/' || lang || '.RS' ELSE '@org/pkg/deep' END"


@query(f"WITH p AS (SELECT doc_id, {_P} AS path, text FROM documents) SELECT doc_id, regexp_matches(path, '(?i)(^|/)(__tests__|tests|spec)/|\\.(test|spec)\\.[cm]?[jt]sx?$|(^|/)(test_[^/]+|[^/]+_test)\\.py$') AS is_test, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 3 THEN 'rust' WHEN 4 THEN '' ELSE 'typescript' END AS language, path LIKE './%' AS relative, regexp_extract(path, '^(@[^/]+/[^/]+|[^/]*)', 1) AS package, length(text) >= 20000 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 400 AS minified, CAST(ceil(length(text) / 3.7) AS BIGINT) AS tokens FROM p")
def path_classifiers(spark, d):
    p = read(spark, d, "documents").withColumn("path", F.expr(_P))
    c = F.col
    return p.select("doc_id", tx.is_test_file(c("path")).alias("is_test"), F.coalesce(tx.language(c("path")), F.lit("")).alias("language"), tx.is_relative(c("path")).alias("relative"), tx.package_name(c("path")).alias("package"), tx.looks_minified(c("text")).alias("minified"), tx.estimate_tokens(c("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN ceil(length(text) / 3.7) > 100 THEN regexp_replace(substr(text, 1, 370), '\\n[^\\n]*$', '') || chr(10) || '… truncated' ELSE text END AS capped FROM documents")
def cap_text(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.cap_text(F.col("text"), 100).alias("capped"))


@query("SELECT o_orderkey AS diff_id, 'src/f' || o_custkey || '.ts' AS file, CAST(unnest([10, 11, 13]) AS INT) AS line FROM orders")
def parse_diff(spark, d):
    body = F.concat(F.lit("--- a/x\n+++ b/src/f"), F.col("o_custkey").cast("string"), F.lit(".ts\n@@ -9,4 +9,5 @@ fn\n keep\n-old\n+new\n++ plus\n keep\n-gone\n"))
    return an.parse_diff(read(spark, d, "orders").select(F.col("o_orderkey").alias("diff_id"), body.alias("text")))


def graph_of(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return trade(spark, sf_dir)


_PYTHON = "from pkg.c@P@ import work\n\ndef helper():\n    return 1\n\nclass C@K@:\n    def run(self):\n        return helper()\n\ndef work():\n    return helper() + helper()\n"
_PY_EDGES = [("contains", "module:@F@", "function:@F@#helper"), ("contains", "module:@F@", "class:@F@#C@K@"), ("contains", "class:@F@#C@K@", "method:@F@#C@K@.run"), ("contains", "module:@F@", "function:@F@#work"), ("calls", "method:@F@#C@K@.run", "function:@F@#helper"), ("calls", "function:@F@#work", "function:@F@#helper")]
_PY_SQL = "WITH c AS (SELECT 'pkg/c' || c_custkey || '.py' AS f, c_custkey AS k, c_custkey + 1 AS p, c_custkey + 1 IN (SELECT c_custkey FROM customer) AS known FROM customer) "
_PY_IMPORT = "SELECT {}'module:' || f AS src, CASE WHEN known THEN 'module:pkg/c' || p || '.py' ELSE 'module:external:pkg.c' || p END AS dst FROM c"


def _python(spark, d):
    """One Python file a customer, that imports the next customer's file."""
    from ..frontends.python import analyze

    k, p = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 1).cast("string")
    text = F.replace(F.replace(F.lit(_PYTHON), F.lit("@K@"), k), F.lit("@P@"), p)
    return analyze(read(spark, d, "customer").select(F.concat(F.lit("pkg/c"), k, F.lit(".py")).alias("path"), text.alias("text")))[0]


@query(_PY_SQL + _PY_IMPORT.format(""), "python_imports")
def _imports(spark, d):
    return _python(spark, d).edges.where("kind = 'imports'").select("src", "dst")


@query(_PY_SQL + " UNION ALL ".join([*(f"SELECT '{kind}' AS kind, replace(replace('{a}', '@F@', f), '@K@', k::VARCHAR) AS src, replace(replace('{b}', '@F@', f), '@K@', k::VARCHAR) AS dst FROM c" for kind, a, b in _PY_EDGES), _PY_IMPORT.format("'imports', ")]))
def analyze_python(spark, d):
    return _python(spark, d).edges.select("kind", "src", "dst")


@query("WITH p AS (SELECT count(*) AS n FROM part) SELECT 'contains' AS kind, 2 * n AS edges FROM p UNION ALL SELECT 'imports', 2 * n - 1 FROM p UNION ALL SELECT 'calls', n FROM p")
def gen_synthetic(spark, d):
    """A generated project of as many modules as there are parts; imports of one file count once."""
    from ..frontends.python import analyze
    from ..sources.files import synthetic

    return analyze(synthetic(spark, read(spark, d, "part").count()))[0].edges.groupBy("kind").agg(F.count("*").alias("edges"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g) SELECT user_id, count(*) AS saves, epoch_us(min(ts)) AS first FROM s GROUP BY user_id, b")
def debounce_refresh(spark, d):
    from ..streaming.changes import debounce

    out = debounce(read(spark, d, "events"), "user_id", "ts", "1 hour")
    return out.select("user_id", "saves", F.unix_micros(F.col("first").cast("timestamp")).alias("first"))
