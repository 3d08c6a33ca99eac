"""Queries of answers, drawn exports, transcripts and change handling, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..export import diagrams as dg
from ..frontends import flow as fl
from ..frontends.dataflow import sites
from ..operators import answers as an
from ..operators import evaluation as ev
from ..operators import rank as rk
from ..operators import traverse as tv
from ..operators.layout import crossings
from ..schema import CodeGraph
from ..streaming import changes as ch
from .graphs import CHAIN, EVENTS, TRADE, chain, read, trade, transitions
from .queries import _AT, ORACLES, query
from .scalars import _regions, _scalar

_MOD = "module:signup/1"


@query(f"WITH RECURSIVE {EVENTS}, walk AS (SELECT '{_MOD}' AS id UNION SELECT e.src FROM edges e JOIN walk ON e.dst = walk.id) SELECT id FROM walk")
def query_importers(spark, d):
    return an.importers(transitions(spark, d), _MOD).select("id")


@query(f"WITH RECURSIVE {CHAIN} SELECT '{_AT}' AS id UNION SELECT src FROM edges WHERE dst = '{_AT}' UNION SELECT dst FROM edges WHERE src = '{_AT}'")
def query_slice(spark, d):
    return tv.slice_around(chain(spark, d), _AT).nodes.select("id")


@query(f"SELECT string_agg(split_part(id, ':', 2), ' → ' ORDER BY pos) AS path FROM ({ORACLES['shortest_path']})")
def query_path(spark, d):
    g = transitions(spark, d)
    return an.path_text(g.nodes, tv.shortest_path(g, "module:signup/0", "module:signup/2"))


@query(f"WITH {TRADE}, e AS (SELECT src, dst FROM edges WHERE kind <> 'contains'), o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) SELECT nodes.id, CASE WHEN kind = 'method' THEN name || '()' ELSE name END AS label, CASE WHEN file IS NULL THEN coalesce(start_line::VARCHAR, '') ELSE file || coalesce(':' || start_line, '') END AS place, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes LEFT JOIN i USING (id) LEFT JOIN o ON o.id = nodes.id")
def hover_details(spark, d):
    return an.hover_details(trade(spark, d)).drop("kind")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE kind <> 'class' AND coalesce(file, '') NOT LIKE 'AFRICA%' AND (lower(name) LIKE '%n%1%' OR coalesce(lower(file), '') LIKE '%n%1%')")
def search_filter(spark, d):
    return an.search_filter(trade(spark, d).nodes, "N1", ["class"], ["AFRICA"]).select("id")


@query(f"WITH {TRADE} SELECT id FROM nodes WHERE file IS NOT NULL AND kind NOT IN ('module', 'folder') AND NOT external")
def is_listable(spark, d):
    return an.listable(trade(spark, d).nodes).select("id")


@query(f"WITH {TRADE}, i AS (SELECT dst AS id, CAST(sum(coalesce(cnt, 1)) AS BIGINT) AS n FROM edges WHERE kind IN ('calls', 'imports') GROUP BY 1) SELECT nodes.id, '  ' || kind || ' ' || name || coalesce(' ·' || start_line, '') || coalesce(' ←' || n, '') AS line FROM nodes LEFT JOIN i USING (id)")
def symbol_line(spark, d):
    g = trade(spark, d)
    return g.nodes.join(an.inbound_weight(g.edges), "id", "left").select("id", an.symbol_line().alias("line"))


@query(ORACLES["vertices_in_cycles"])
def containment_cycles(spark, d):
    g = transitions(spark, d)
    return rk.containment_cycles(CodeGraph(g.nodes, g.edges.withColumn("kind", F.lit("contains"))))


@query("SELECT 'module:' || r_name AS id FROM region")
def canonicalize(spark, d):
    return _regions(spark, d).canonical().nodes.select("id")


_scalar("clean_path", "path", lambda path: an.clean_path(F.concat(F.lit('"b/'), path, F.lit('"\t2020'))))


@query("SELECT count(*) AS pairs FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def layout_crossings(spark, d):
    """Lines from each region on the left to the one of opposite rank on the right: all pairs cross."""
    k = F.col("r_regionkey").cast("double")
    lines = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(0.0).alias("x1"), k.alias("y1"), F.lit(3.5).alias("x2"), (-k * 2).alias("y2"))
    return crossings(lines).agg(F.count("*").alias("pairs"))


def _drawn(key: str, run, match: str, less: int) -> None:
    def f(spark, d):
        return spark.createDataFrame([(run(_regions(spark, d)).count(match),)], "found long")

    query(f"SELECT count(*) - {less} AS found FROM region", key)(f)


_drawn("export_svg", dg.to_svg, "<polyline", 1)
_drawn("export_drawio", dg.to_drawio, 'vertex="1"', 0)


def _types(spark, d) -> CodeGraph:
    """Regions as classes, each extending the next."""
    g = _regions(spark, d)
    return CodeGraph(g.nodes.withColumn("kind", F.lit("class")), g.edges.withColumn("kind", F.lit("extends")))


_CLASSES = r"""WITH c AS (SELECT r_regionkey AS k, r_name AS name, 'module:' || r_name AS id, regexp_replace('module:' || r_name, '[^A-Za-z0-9]', '_', 'g') AS n FROM region),
u AS (SELECT b.n || ' <|-- ' || a.n || '~' AS line, a.id AS id FROM c a JOIN c b ON b.k = a.k + 1)"""


def _class_export(key: str, run, box: str, pad: str, begin: str, end: str) -> None:
    """The whole text of a class export; edge ids begin with the extending class's."""
    text = f"'{begin}~' || (SELECT string_agg({box}, '' ORDER BY id) FROM c) || (SELECT string_agg('{pad}' || line, '' ORDER BY id) FROM u) || '{end}'"
    query(f"{_CLASSES} SELECT replace({text}, '~', chr(10)) AS text", key)(lambda spark, d: spark.createDataFrame([(run(_types(spark, d)),)], "text string"))


_class_export("export_mermaid_class", dg.to_mermaid_class, """'  class ' || n || '["' || name || '"] {~  }~'""", "  ", "classDiagram", "")
_class_export("export_plantuml_class", dg.to_plantuml_class, """'class "' || name || '" as ' || n || ' {~}~'""", "", "@startuml", "@enduml~")

_DEAD = "function f(a) {\n  let n = a;\n  return n;\n  n = 2;\n}\n"


def _dead(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit(_DEAD).alias("text"))


@query("SELECT c_custkey AS k, 1 AS dead FROM customer")
def cfg_reachable(spark, d):
    return fl.dead_blocks(fl.flow(_dead(spark, d))).groupBy(F.col("path").cast("long").alias("k")).agg(F.count("*").cast("int").alias("dead"))


@query("SELECT c_custkey AS k, v.* FROM customer CROSS JOIN (VALUES ('a', 'read'), ('n', 'write'), ('n', 'read')) AS v(variable, access)")
def variable_blocks(spark, d):
    files = _dead(spark, d)
    hit = fl.variable_blocks(fl.flow(files), sites(files)).where("id = 'b1'")
    return hit.select(F.col("path").cast("long").alias("k"), "variable", "access")


@query("SELECT conv_id * 1000 + turn AS run, CAST(turn AS BIGINT) AS input_tokens, CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS BIGINT) END AS output_tokens, CAST(turn + CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END AS BIGINT) AS total_tokens, CAST(1 AS BIGINT) AS tool_calls, text AS answer FROM conversations WHERE text IS NOT NULL")
def read_transcripts(spark, d):
    usage = F.struct(F.col("turn").alias("input_tokens"), F.when(F.col("turn") % 2 == 0, F.length("text")).alias("output_tokens"))
    entry = F.struct(F.lit("result").alias("type"), usage.alias("usage"), F.col("text").alias("result"))
    used = F.lit('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"x"}]}}')
    rows = read(spark, d, "conversations").where("text is not null")
    return ev.read_transcripts(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("run"), F.concat(F.lit("["), used, F.lit(","), F.to_json(entry), F.lit("]")).alias("text")))


@query("SELECT count(*) + 1 AS lines FROM region")
def bench_table(spark, d):
    rows = read(spark, d, "region").selectExpr("r_name AS metric", "r_regionkey AS value", "'ok' AS status")
    return spark.createDataFrame([(len(ev.bench_table(rows).splitlines()),)], "lines long")


_INDEX = f"WITH RECURSIVE {EVENTS}, ix AS (SELECT DISTINCT split_part(src, ':', 2) AS file, split_part(dst, ':', 2) AS imports FROM edges WHERE src <> dst)"


def _index(spark, d):
    g = transitions(spark, d)
    return ch.dependency_index(g.edges, g.nodes.withColumn("file", F.col("name")))


@query(f"{_INDEX} SELECT file, imports FROM ix")
def dependency_index(spark, d):
    return _index(spark, d)


@query(f"{_INDEX}, dirty AS (SELECT 'signup/1' AS file UNION SELECT file FROM ix WHERE imports = 'signup/1'), one AS (SELECT imports AS file FROM ix WHERE file IN (FROM dirty)), two AS (SELECT imports AS file FROM ix WHERE file IN (FROM one)) SELECT DISTINCT file, CASE WHEN file IN (FROM dirty) THEN 'dirty' ELSE 'context' END AS role FROM (FROM dirty UNION FROM one UNION FROM two)")
def dirty_closure(spark, d):
    return ch.dirty_closure(_index(spark, d), spark.createDataFrame([("signup/1",)], "path string"))


@query("SELECT event_id, event_type AS file FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def follow(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "user_id", "ts", "event_type AS file", "event_id % 5 > 0 AS following", "event_id % 7 = 0 AS pinned")
    return ch.followed(e, "user_id", ["ts", "event_id"]).select("event_id", "file")


_SPANS = "p_partkey, p_size, p_partkey % 50 AS a, p_partkey % 50 + p_size AS b"


@query("SELECT p_partkey, a >= 10 AND b <= 40 AS within, a >= 10 AND b <= 40 AND NOT (a = 10 AND b = 40) AS strictly FROM (SELECT p_partkey, p_partkey % 50 AS a, p_partkey % 50 + p_size AS b FROM part)")
def span_within(spark, d):
    s = read(spark, d, "part").selectExpr(*_SPANS.split(", "))
    ten, forty = F.lit(10), F.lit(40)
    return s.select("p_partkey", an.span_within(F.col("a"), F.col("b"), ten, forty).alias("within"), an.span_contains_strict(ten, forty, F.col("a"), F.col("b")).alias("strictly"))


_NESTED = "function outer(a) {\n  function inner(b) {\n    return b;\n  }\n  return inner(a);\n}\n"


def _nested(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit(_NESTED).alias("text"))


@query("SELECT c_custkey AS k, CAST(1 + c_custkey % 7 AS INT) AS line, CASE WHEN c_custkey % 7 BETWEEN 1 AND 3 THEN 'inner' ELSE 'outer' END AS name FROM customer WHERE c_custkey % 7 < 6")
def cfg_at_line(spark, d):
    files = _nested(spark, d)
    lines = files.select("path", (F.lit(1) + F.col("path").cast("long") % 7).cast("int").alias("line"))
    return fl.cfg_at_line(fl.spans(files), lines).select(F.col("path").cast("long").alias("k"), "line", "name")


@query("SELECT c_custkey AS k, v.* FROM customer CROSS JOIN (VALUES ('b', 'write', 2::INT), ('b', 'read', 3::INT)) AS v(variable, access, line)")
def dataflow_for_span(spark, d):
    files = _nested(spark, d)
    where = fl.spans(files)
    asked = where.where("name = 'inner'").select("path", "start_line", "start_col")
    return fl.dataflow_for_span(where, sites(files), asked).select(F.col("path").cast("long").alias("k"), "variable", "access", "line")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents", "file_digests")
def _digests(spark, d):
    return ch.digests(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")).select(F.col("path").cast("long").alias("doc_id"), "digest")


@query("SELECT CASE WHEN count(*) FILTER (doc_id % 3 = 0) = 0 THEN 'cached' ELSE 'partial' END AS pass, count(*) FILTER (doc_id % 3 = 0) AS changed FROM documents", "incremental_decision")
def _decision(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    edited = files.withColumn("text", F.when(F.col("path").cast("long") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return ch.decision(ch.digests(files), ch.digests(edited))


@query(f"WITH {TRADE}, c AS (SELECT dst AS id, src AS parent FROM edges WHERE kind = 'contains'), p AS (SELECT parent, min(id) AS a, max(id) AS b FROM c GROUP BY 1) SELECT a, b, CASE WHEN a = b THEN a ELSE parent END AS ancestor FROM p")
def common_ancestor(spark, d):
    g = trade(spark, d)
    pairs = tv.parents(g.edges).groupBy("parent").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    return tv.common_ancestor(g, pairs)


@query(f"WITH {TRADE}, f AS (SELECT id FROM nodes WHERE kind = 'module' AND qn = 'nowhere') SELECT 'suggestion' AS status, id FROM nodes WHERE kind = 'module' AND contains(lower(name), 'a') OR kind = 'module' AND contains(lower(qn), 'a') ORDER BY id LIMIT 5")
def resolve_module_status(spark, d):
    return an.resolve_module_status(trade(spark, d).nodes, "A")
