"""Filters, unions, merging and lifting of edges: plain relational operators over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_column
from ..schema import CodeGraph, edge_id
from ..storage import stored


# The kinds of nodes and edges.
NODE_KINDS = ["module", "folder", "namespace", "class", "interface", "enum", "function", "method", "variable"]
EDGE_KINDS = ["contains", "imports", "calls", "extends", "implements"]


def path_of(g: CodeGraph) -> Column:
    return F.coalesce("file", "qn")


def induced(g: CodeGraph, keep: DataFrame) -> CodeGraph:
    """The nodes whose id is in ``keep(id)`` and the edges with both ends kept."""
    k = keep.select("id").distinct()
    e = g.edges.join(k.select(F.col("id").alias("src")), "src", "left_semi").join(k.select(F.col("id").alias("dst")), "dst", "left_semi")
    return CodeGraph(g.nodes.join(k, "id", "left_semi"), e.select(*g.edges.columns))


def filter_graph(g: CodeGraph, kinds=None, include=None, exclude=None) -> CodeGraph:
    n = g.nodes
    if kinds:
        n = n.where(F.col("kind").isin(*kinds))
    if include:
        n = n.where(glob_column(path_of(g), include))
    if exclude:
        n = n.where(~glob_column(path_of(g), exclude))
    return induced(g, n.select("id"))


def drop_external(g: CodeGraph) -> CodeGraph:
    return induced(g, g.nodes.where(~F.coalesce("external", F.lit(False))).select("id"))


def drop_sinks(g: CodeGraph) -> CodeGraph:
    """Without external nodes that aren't modules."""
    return induced(g, g.nodes.where(~F.coalesce("external", F.lit(False)) | (F.col("kind") == "module")).select("id"))


def drop_unreferenced_external(g: CodeGraph) -> CodeGraph:
    used = g.edges.select(F.col("src").alias("id")).union(g.edges.select("dst")).distinct()
    own = g.nodes.where(~F.coalesce("external", F.lit(False)))
    return CodeGraph(own.unionByName(g.nodes.where("external").join(used, "id", "left_semi")), g.edges)


def parents(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'contains'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))


def union_graphs(*graphs: CodeGraph) -> CodeGraph:
    """A union that keeps one row an id: that of the first graph that has it, there the least row."""

    def first(tables: list[DataFrame]) -> DataFrame:
        rest = [c for c in tables[0].columns if c != "id"]
        both = [t.select("id", F.struct(F.lit(k).alias("__at"), *rest).alias("r")) for k, t in enumerate(tables)]
        out = both[0]
        for t in both[1:]:
            out = out.unionByName(t)
        return out.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*").select(*tables[0].columns)

    return CodeGraph(first([g.nodes for g in graphs]), first([g.edges for g in graphs]))


def rebase(g: CodeGraph, prefix: str) -> CodeGraph:
    """Project nodes move below ``prefix``; externals stay, edge ids follow their ends; an empty prefix changes nothing."""
    if not prefix:
        return g
    own = ~F.coalesce("external", F.lit(False))
    moved = F.when(own, F.regexp_replace("id", r"^([a-z]+):", f"$1:{prefix}/")).otherwise(F.col("id"))
    names = g.nodes.select("id", moved.alias("new"))
    under = lambda c: F.when(own & c.isNotNull(), F.concat(F.lit(prefix + "/"), c)).otherwise(c)
    nodes = g.nodes.withColumns({"qn": F.when(F.col("kind").isin("module", "folder"), under(F.col("qn"))).otherwise(F.col("qn")), "file": under(F.col("file")), "id": moved})
    e = g.edges.join(names.select(F.col("id").alias("src"), F.col("new").alias("s")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst", "left")
    e = e.withColumns({"src": F.coalesce("s", "src"), "dst": F.coalesce("d", "dst")}).withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst")))
    return CodeGraph(nodes.select(*g.nodes.columns), e.select(*g.edges.columns))


def merge_edges(occurrences: DataFrame, order: str) -> DataFrame:
    """Occurrences ``(kind, src, dst, line, type_only, low, <order>)`` to edges: counted, the first line wins, flags AND."""
    true_or_null = lambda c: F.when(F.bool_and(F.coalesce(c, F.lit(False))), True)
    n = F.count("*")
    e = occurrences.groupBy("kind", "src", "dst").agg(F.min_by("line", order).alias("line"), F.when(n > 1, n).alias("cnt"), true_or_null("type_only").alias("type_only"), true_or_null("low").alias("low"))
    return e.select(edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "*", F.lit(None).cast("boolean").alias("in_cycle"))


def lift_edges(edges: DataFrame, target: DataFrame, drop_kinds=("contains",)) -> DataFrame:
    """Both ends through ``target(id, to)``, self loops dropped, duplicates merged: counts add, flags AND, cycles OR."""
    e = edges.where(~F.col("kind").isin(*drop_kinds)) if drop_kinds else edges
    to = target.select(F.col("id").alias("src"), F.col("to").alias("s")), target.select(F.col("id").alias("dst"), F.col("to").alias("d"))
    e = e.join(to[0], "src", "left").join(to[1], "dst", "left").withColumns({"src": F.coalesce("s", "src"), "dst": F.coalesce("d", "dst")}).where("src <> dst")
    total, n = F.sum(F.coalesce("cnt", F.lit(1).cast("long"))), F.count("*")
    flag = lambda c: F.when(F.bool_and(F.coalesce(c, F.lit(False))), True)
    out = e.groupBy("kind", "src", "dst").agg(
        F.min_by("line", "id").alias("line"), F.when((n > 1) | F.max("cnt").isNotNull(), total).alias("cnt"), flag("type_only").alias("type_only"), flag("low").alias("low"),
        F.when(F.bool_or(F.coalesce("in_cycle", F.lit(False))), True).alias("in_cycle"),
    )
    return out.select(edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "kind", "src", "dst", "line", "cnt", "type_only", "low", "in_cycle")


def inbound_weight(edges: DataFrame) -> DataFrame:
    return edges.where("kind in ('calls', 'imports')").groupBy(F.col("dst").alias("id")).agg(F.sum(F.coalesce("cnt", F.lit(1).cast("long"))).alias("inbound"))


def degrees(edges: DataFrame) -> DataFrame:
    e = edges.where("kind <> 'contains'")
    both = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def edge_weight(edges: DataFrame) -> Column:
    return F.coalesce(F.col("cnt"), F.lit(1)).cast("double") * F.when(F.col("low"), 0.5).otherwise(1.0) * F.when(F.col("type_only"), 0.25).otherwise(1.0)


def fragment_split(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the file that owns them; an edge belongs to its source's file."""
    owner = F.coalesce("file", F.lit("__shared__"))
    nodes = g.nodes.withColumn("owner", owner)
    e = g.edges.join(nodes.select(F.col("id").alias("src"), "owner"), "src", "left").withColumn("owner", F.coalesce("owner", F.lit("__shared__")))
    return nodes, e


def fragment_merge(nodes: DataFrame, edges: DataFrame, order: str) -> CodeGraph:
    """The last row of an id wins, dangling edges go, nodes without a file go unless an edge needs them."""
    last = lambda df: df.groupBy("id").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("id", order)]), order).alias("r")).select("id", "r.*")
    n, e = last(nodes), last(edges)
    e = e.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    used = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return CodeGraph(n.where("file is not null").unionByName(n.where("file is null").join(used, "id", "left_semi")), e)


def validate(g: CodeGraph) -> DataFrame:
    """``message`` rows: repeated ids, edges without ends, ids that don't fit, attributes where they can't be, bad spans."""
    # each part reads them again: stored, so that what is behind them runs once
    n, e = stored(g.nodes, "nodes"), stored(g.edges, "edges")
    ids = n.select("id")
    say = lambda df, text, col="id": df.select(F.concat(F.lit(text + ": "), F.col(col)).alias("message"))
    parts = [
        say(n.groupBy("id").count().where("count > 1"), "duplicate node"), say(e.groupBy("id").count().where("count > 1"), "duplicate edge"),
        say(e.join(ids.select(F.col("id").alias("src")), "src", "left_anti"), "edge without source"), say(e.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti"), "edge without target"),
        say(e.where(F.col("id") != edge_id(F.col("kind"), F.col("src"), F.col("dst"))), "edge id"), say(n.where(F.substring_index("id", ":", 1) != F.col("kind")), "node id"),
        say(e.where("cnt < 2"), "count below two"), say(e.where("type_only is not null and kind <> 'imports'"), "type-only edge"), say(e.where("in_cycle is not null and kind <> 'imports'"), "cycle flag"),
        say(e.where("low is not null and kind <> 'calls'"), "confidence"), say(parents(e).groupBy("id").count().where("count > 1"), "several parents"),
        say(parents(e).where("id = parent"), "contains itself"), say(n.where(~F.col("kind").isin(*NODE_KINDS)), "node kind"), say(e.where(~F.col("kind").isin(*EDGE_KINDS)), "edge kind"),
        say(n.where("start_line < 1 or end_line < start_line or file like '%\\\\\\\\%'"), "span"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
