"""Containment: collapsing to modules or folders, drill-down, and the choice between them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NODES, CodeGraph, edge_id, padded
from ..storage import stored
from .relational import lift_edges, parents

# What still fits an overview.
MAX_MODULES, MAX_EDGES, FOLD_THRESHOLD, MAX_LAID_OUT = 250, 600, 40, 1500


def chase(start: DataFrame, step: DataFrame) -> DataFrame:
    """``(id, to)`` followed through ``step(id, parent)`` to its end, by pointer doubling: a chain of depth d takes log2 d rounds.

    ``step`` is stored once and only its own narrow rows are joined in a round.
    """
    hop = stored(step.select("id", "parent"), "chase")
    for _ in range(2 + math.ceil(math.log2(1 + hop.count()))):
        up = hop.select(F.col("id").alias("parent"), F.col("parent").alias("up"))
        if hop.join(up, "parent", "left_semi").isEmpty():
            ends = hop.select(F.col("id").alias("to"), F.col("parent").alias("up"))
            return start.join(ends, "to", "left").select("id", F.coalesce("up", "to").alias("to"))
        hop = stored(hop.join(up, "parent", "left").select("id", F.coalesce("up", "parent").alias("parent")), "chase")
    raise ValueError("containment has a cycle")


def collapse_modules(g: CodeGraph) -> CodeGraph:
    """Every node folds into its nearest module or folder; contains edges go, the others are lifted."""
    # read three times each below: stored, so that what is behind them runs once
    g = CodeGraph(stored(g.nodes, "nodes"), stored(g.edges, "edges"))
    top = g.nodes.where("kind in ('module', 'folder')").select("id")
    up = parents(g.edges).join(top, "id", "left_anti")
    target = stored(chase(g.nodes.select("id", F.col("id").alias("to")), up), "chased")
    keep = target.select(F.col("to").alias("id")).distinct()
    return CodeGraph(g.nodes.join(keep, "id", "left_semi"), lift_edges(g.edges, target))


def _folder(depth: int):
    parts = F.split("qn", "/")
    return F.when((F.col("kind") == "module") & ~F.coalesce("external", F.lit(False)) & (F.size(parts) > depth), F.array_join(F.slice(parts, 1, depth), "/"))


def _folder_nodes(paths: DataFrame) -> DataFrame:
    rows = paths.select(F.concat(F.lit("folder:"), "path").alias("id"), F.lit("folder").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("qn"))
    return padded(rows, NODES)


def collapse_folders(g: CodeGraph, depth: int = 1, modules: CodeGraph | None = None) -> CodeGraph:
    """``modules``: the graph collapsed to modules, where the caller has it."""
    depth = max(1, depth)
    m = modules or collapse_modules(g)
    path = m.nodes.select("id", _folder(depth).alias("path"))
    folders = path.where("path is not null")
    target = folders.select("id", F.concat(F.lit("folder:"), "path").alias("to"))
    nodes = m.nodes.join(folders, "id", "left_anti").unionByName(_folder_nodes(folders.select("path").distinct()))
    return CodeGraph(nodes, lift_edges(m.edges, target, ()))


def best_folder_depth(g: CodeGraph, deepest: int = 4) -> int:
    """The least depth with several folders and an edge at one; else the depth of most folders, the first on ties."""
    best, most = 1, -1
    m = collapse_modules(g)
    m = CodeGraph(stored(m.nodes, "modules"), stored(m.edges, "lifted"))
    for d in range(1, deepest + 1):
        f = collapse_folders(g, d, m)
        folders = f.nodes.where("kind = 'folder'").select("id")
        n = folders.count()
        ends = f.edges.select(F.col("src").alias("id")).unionByName(f.edges.select(F.col("dst").alias("id")))
        if n > 1 and not ends.join(folders, "id", "left_semi").isEmpty():
            return d
        if n > most:
            best, most = d, n
    return best


def folder_hierarchy(g: CodeGraph, depth: int = 1) -> CodeGraph:
    """Adds folder nodes and contains edges for the modules below them."""
    path = g.nodes.select("id", _folder(max(1, depth)).alias("path")).where("path is not null")
    rows = path.select(F.lit("contains").alias("kind"), F.concat(F.lit("folder:"), "path").alias("src"), F.col("id").alias("dst"))
    rows = padded(rows.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst"))), "id string, kind string, src string, dst string, line int, cnt bigint, type_only boolean, low boolean, in_cycle boolean")
    return CodeGraph(g.nodes.unionByName(_folder_nodes(path.select("path").distinct())), g.edges.unionByName(rows))


def expand_nodes(g: CodeGraph, expanded: list[str]) -> CodeGraph:
    """A node shows if it has no parent or its parent is expanded; others stand behind where their parent lands."""
    g = CodeGraph(g.nodes, stored(g.edges, "edges"))
    hidden = parents(g.edges).where(~F.col("parent").isin(*expanded)) if expanded else parents(g.edges)
    target = chase(g.nodes.select("id", F.col("id").alias("to")), hidden)
    shown = target.where("id = to").select("id")
    return CodeGraph(g.nodes.join(shown, "id", "left_semi"), lift_edges(g.edges, target, ()))


def expandable_ids(g: CodeGraph, shown: DataFrame, expanded: list[str]) -> DataFrame:
    have = parents(g.edges).select(F.col("parent").alias("id")).distinct().join(shown.select("id"), "id", "left_semi")
    return have.where(~F.col("id").isin(*expanded)) if expanded else have


def fold_decision(modules: CodeGraph, folders: CodeGraph, threshold: int = FOLD_THRESHOLD) -> DataFrame:
    """One row: how many nodes each level has and which of them is shown."""
    m, f, e = modules.nodes.agg(F.count("*").alias("modules")), folders.nodes.agg(F.count("*").alias("folders")), modules.edges.where("kind <> 'contains'").agg(F.count("*").alias("flat_edges"))
    one = m.join(f).join(e)  # three single-row aggregates
    fold = ((F.col("modules") > MAX_MODULES) | (F.col("flat_edges") > MAX_EDGES) | (F.col("modules") > threshold)) & (F.col("folders") < F.col("modules"))
    level = F.when(fold, "folders").otherwise("modules")
    return one.withColumn("level", level).withColumn("refused", F.when(fold, F.col("folders")).otherwise(F.col("modules")) > MAX_LAID_OUT)
