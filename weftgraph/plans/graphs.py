"""Graphs over the driver's tables, in Spark and as SQL, so that each operator has an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.relational import merge_edges
from ..schema import EDGES, NODES, CodeGraph, edge_id, padded
from ..storage import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Nations are modules in region folders; customers and suppliers are classes; orders are methods; brands external."""
    t = lambda n: read(spark, sf_dir, n)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"))
    nation = F.broadcast(nation)  # 25 rows by definition
    mod = F.concat(F.lit("module:"), "path")
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "path", F.concat(F.lit("class:"), "path", F.lit("#"), "c_name").alias("cid"))
    supp = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "path", F.concat(F.lit("class:"), "path", F.lit("#"), "s_name").alias("sid"))
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "path", "cid", "c_name", F.concat(F.lit("method:"), "path", F.lit("#"), "c_name", F.lit("."), F.col("o_orderkey").cast("string")).alias("oid"))
    brand = t("part").select("p_brand").distinct()
    nodes = [
        nation.select(mod.alias("id"), F.lit("module").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("qn"), F.col("path").alias("file"), F.lit(1).alias("start_line"), F.lit(1000000000).alias("end_line"), F.lit(False).alias("external")),
        cust.select(F.col("cid").alias("id"), F.lit("class").alias("kind"), F.col("c_name").alias("name"), F.col("c_name").alias("qn"), F.col("path").alias("file"), (F.col("c_custkey") * 100 + 1).cast("int").alias("start_line"), (F.col("c_custkey") * 100 + 100).cast("int").alias("end_line"), F.lit(False).alias("external")),
        supp.select(F.col("sid").alias("id"), F.lit("class").alias("kind"), F.col("s_name").alias("name"), F.col("s_name").alias("qn"), F.col("path").alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(False).alias("external")),
        orders.select(F.col("oid").alias("id"), F.lit("method").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.concat_ws(".", "c_name", F.col("o_orderkey").cast("string")).alias("qn"), F.col("path").alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(False).alias("external")),
        brand.select(F.concat(F.lit("module:external:"), "p_brand").alias("id"), F.lit("module").alias("kind"), F.col("p_brand").alias("name"), F.col("p_brand").alias("qn"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(True).alias("external")),
    ]
    n = padded(nodes[0], NODES)
    for x in nodes[1:]:
        n = n.unionByName(padded(x, NODES))
    contains = cust.select(mod.alias("src"), F.col("cid").alias("dst")).unionByName(supp.select(mod.alias("src"), F.col("sid").alias("dst"))).unionByName(orders.select(F.col("cid").alias("src"), F.col("oid").alias("dst")))
    contains = padded(contains.withColumn("kind", F.lit("contains")).withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst"))), EDGES)
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    j = li.join(orders.select("o_orderkey", "oid", F.col("path").alias("cpath")), F.col("l_orderkey") == F.col("o_orderkey")).join(supp.select("s_suppkey", "sid", F.col("path").alias("spath")), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    flag = lambda c: F.when(c, True)
    one = lambda kind, src, dst, type_only, low: F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.col("l_linenumber").alias("line"), type_only.alias("type_only"), low.alias("low"))
    no = F.lit(None).cast("boolean")
    m = lambda c: F.concat(F.lit("module:"), c)
    occ = j.select("o", F.explode(F.array(one("calls", F.col("oid"), F.col("sid"), no, flag(F.col("l_returnflag") == "R")), one("imports", m(F.col("cpath")), m(F.col("spath")), flag(F.col("l_linestatus") == "F"), no), one("imports", m(F.col("cpath")), F.concat(F.lit("module:external:"), "p_brand"), no, no))).alias("e")).select("o", "e.*")
    return CodeGraph(n, contains.unionByName(merge_edges(occ, "o").select(*contains.columns)))


TRADE = """
nat AS (SELECT n_nationkey, r_name || '/' || n_name AS path, 'module:' || r_name || '/' || n_name AS mid, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cst AS (SELECT c_custkey, c_name, path, mid, 'class:' || path || '#' || c_name AS cid FROM customer JOIN nat ON c_nationkey = n_nationkey),
sup AS (SELECT s_suppkey, s_name, path, mid, 'class:' || path || '#' || s_name AS sid FROM supplier JOIN nat ON s_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, path, mid, cid, c_name, 'method:' || path || '#' || c_name || '.' || o_orderkey AS oid FROM orders JOIN cst ON o_custkey = c_custkey),
nodes AS (
  SELECT mid AS id, 'module' AS kind, n_name AS name, path AS qn, path AS file, 1 AS start_line, 1000000000 AS end_line, false AS external FROM nat
  UNION ALL SELECT cid, 'class', c_name, c_name, path, CAST(c_custkey * 100 + 1 AS INT), CAST(c_custkey * 100 + 100 AS INT), false FROM cst
  UNION ALL SELECT sid, 'class', s_name, s_name, path, NULL, NULL, false FROM sup
  UNION ALL SELECT oid, 'method', CAST(o_orderkey AS VARCHAR), c_name || '.' || o_orderkey, path, NULL, NULL, false FROM ord
  UNION ALL SELECT DISTINCT 'module:external:' || p_brand, 'module', p_brand, p_brand, NULL, NULL, NULL, true FROM part),
occ AS (
  SELECT l_orderkey * 10 + l_linenumber AS o, l_linenumber AS line, unnest([{'kind': 'calls', 'src': oid, 'dst': sid, 't': false, 'l': l_returnflag = 'R'},
    {'kind': 'imports', 'src': ord.mid, 'dst': sup.mid, 't': l_linestatus = 'F', 'l': false}, {'kind': 'imports', 'src': ord.mid, 'dst': 'module:external:' || p_brand, 't': false, 'l': false}]) AS e
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN sup ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
edges AS (
  SELECT 'contains:' || mid || '->' || cid AS id, 'contains' AS kind, mid AS src, cid AS dst, NULL AS line, NULL AS cnt, NULL AS type_only, NULL AS low FROM cst
  UNION ALL SELECT 'contains:' || mid || '->' || sid, 'contains', mid, sid, NULL, NULL, NULL, NULL FROM sup
  UNION ALL SELECT 'contains:' || cid || '->' || oid, 'contains', cid, oid, NULL, NULL, NULL, NULL FROM ord
  UNION ALL SELECT e.kind || ':' || e.src || '->' || e.dst, e.kind, e.src, e.dst, min_by(line, o), CASE WHEN count(*) > 1 THEN count(*) END,
    CASE WHEN bool_and(e.t) THEN true END, CASE WHEN bool_and(e.l) THEN true END FROM occ GROUP BY e.kind, e.src, e.dst)
"""
_LIFT = """SELECT kind || ':' || s || '->' || d AS id, kind, s AS src, d AS dst, min_by(line, id) AS line,
  CASE WHEN count(*) > 1 OR max(cnt) IS NOT NULL THEN CAST(sum(coalesce(cnt, 1)) AS BIGINT) END AS cnt,
  CASE WHEN bool_and(coalesce(type_only, false)) THEN true END AS type_only, CASE WHEN bool_and(coalesce(low, false)) THEN true END AS low
  FROM (SELECT e.*, coalesce(a.t, e.src) AS s, coalesce(b.t, e.dst) AS d FROM {edges} e LEFT JOIN {target} a ON a.id = e.src LEFT JOIN {target} b ON b.id = e.dst {where}) WHERE s <> d GROUP BY kind, s, d"""
#: Nodes to modules, and the graph of modules; then the graph of region folders.
MODULES = TRADE + ", up AS (SELECT id, CASE WHEN external OR kind = 'module' THEN id ELSE 'module:' || file END AS t FROM nodes), medges AS (" + _LIFT.format(edges="edges", target="up", where="WHERE e.kind <> 'contains'") + "), mnodes AS (SELECT * FROM nodes WHERE kind = 'module')"
FOLDERS = MODULES + ", fold AS (SELECT id, 'folder:' || split_part(qn, '/', 1) AS t FROM mnodes WHERE NOT external), fedges AS (" + _LIFT.format(edges="medges", target="fold", where="") + ")"
LIFT = _LIFT


def chain(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """An order calls its customer's next order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = lambda c: F.concat(F.lit("function:chain#"), c.cast("string"))
    nodes = o.select(name(F.col("o_orderkey")).alias("id"), F.lit("function").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("qn"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"))
    e = o.withColumn("n", F.lead("o_orderkey").over(w)).where("n is not null").select(F.lit("calls").alias("kind"), name(F.col("o_orderkey")).alias("src"), name(F.col("n")).alias("dst"))
    e = e.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst")))
    return CodeGraph(padded(nodes, NODES), padded(e, EDGES))


CHAIN = """
edges AS (SELECT 'function:chain#' || o_orderkey AS src, 'function:chain#' || n AS dst FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS NOT NULL)
"""


def transitions(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Event types by user group are modules; consecutive events of a user are imports, with bridges between groups."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    at = F.concat(F.lit("module:"), "event_type", F.lit("/"), (F.col("user_id") % 50).cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hops = e.select(at.alias("src"), F.lead(at).over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    bridge = e.sparkSession.range(49).select(F.concat(F.lit("module:signup/"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("module:signup/"), (F.col("id") + 1).cast("string")).alias("dst"), F.lit(1).cast("long").alias("n"))
    rows = hops.unionByName(bridge).groupBy("src", "dst").agg(F.sum("n").alias("n")).select(F.lit("imports").alias("kind"), "src", "dst", F.when(F.col("n") > 1, F.col("n")).alias("cnt"))
    edges = padded(rows.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst"))), EDGES)
    ids = rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()
    nodes = padded(ids.select("id", F.lit("module").alias("kind"), F.substring_index("id", ":", -1).alias("name"), F.substring_index("id", ":", -1).alias("qn"), F.lit(False).alias("external")), NODES)
    return CodeGraph(nodes, stored(edges, "transitions"))


EVENTS = """
edges AS (SELECT src, dst, sum(n) AS n FROM (
  SELECT src, dst, count(*) AS n FROM (SELECT 'module:' || event_type || '/' || (user_id % 50) AS src, lead('module:' || event_type || '/' || (user_id % 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'module:signup/' || i, 'module:signup/' || (i + 1), 1 FROM range(0, 49) AS r(i)) GROUP BY src, dst),
closure AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON e.src = c.dst)
"""
