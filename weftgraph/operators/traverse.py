"""Reachability, neighbourhoods and shortest paths.

One level a round, the frontier against the edges of the asked kinds, visited nodes removed by an anti join, each level
stored so that lineage stays short. Edges that are measured to be few (``FEW``, whatever the input's size) are walked by
one task instead, which high-diameter graphs need; both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CodeGraph
from ..storage import stored
from .hierarchy import chase  # noqa: F401
from .relational import induced, parents

KINDS = ("calls", "imports")
FEW = 1 << 18


def _walk_task(pairs: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    rows = pairs.select("src", "dst").unionByName(seeds.select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst")))

    def run(batches):
        out, start = defaultdict(list), []
        for b in batches:
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                start.append(d) if s is None else out[s].append(d)
        depth = dict.fromkeys(start, 0)
        now, level = list(depth), 0
        while now and (max_depth is None or level < max_depth):
            level += 1
            nxt = []
            for s in now:
                for d in out.get(s, ()):
                    if d not in depth:
                        depth[d] = level
                        nxt.append(d)
            now = nxt
        yield pa.RecordBatch.from_arrays([pa.array(list(depth), pa.string()), pa.array(list(depth.values()), pa.int32())], names=["id", "depth"])

    return rows.coalesce(1).mapInArrow(run, "id string, depth int")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, few: int = FEW) -> DataFrame:
    """``(id, depth)`` of all nodes that ``seeds(id)`` reach along ``edges(src, dst)``."""
    pairs, seeds = stored(edges.select("src", "dst").distinct(), "bfs-edges"), stored(seeds.select("id").distinct(), "bfs-seeds")
    if pairs.count() + seeds.count() <= few:
        return stored(_walk_task(pairs, seeds, max_depth), "bfs")
    visited = seeds.withColumn("depth", F.lit(0))
    front, level = visited.select("id"), 0
    while (max_depth is None or level < max_depth) and not front.isEmpty():
        level += 1
        reached = pairs.join(front, pairs["src"] == front["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        front = stored(reached.join(visited, "id", "left_anti"), "bfs-front")
        visited = visited.unionByName(front.withColumn("depth", F.lit(level)))
    return visited


def _required(g: CodeGraph, ids: list[str]) -> DataFrame:
    found = g.nodes.where(F.col("id").isin(*ids)).select("id").distinct()
    missing = set(ids) - {r["id"] for r in found.collect()}  # as many as were asked for
    if missing:
        raise KeyError(f"no such node: {sorted(missing)}")
    return found


def reach(g: CodeGraph, start: list[str], kinds=KINDS, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    e = g.edges.where(F.col("kind").isin(*kinds)).select("src", "dst")
    if reverse:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs(e, _required(g, start), max_depth)


def reachable_from(g: CodeGraph, start: str, **kw) -> CodeGraph:
    return induced(g, reach(g, [start], **kw))


def reached_by(g: CodeGraph, start: str, **kw) -> CodeGraph:
    return induced(g, reach(g, [start], reverse=True, **kw))


def ancestors(g: CodeGraph, ids: DataFrame) -> DataFrame:
    up = parents(g.edges).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return bfs(up, ids)


def containment_chains(g: CodeGraph) -> DataFrame:
    """``(id, ancestor, steps)``: each node's containers, itself at 0; a round joins the chains found to one more step."""
    up = stored(parents(g.edges).select(F.col("id").alias("ancestor"), F.col("parent").alias("up")), "chain-up")
    front = stored(g.nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps")), "chain")
    out, most = front, up.count()
    while not front.isEmpty():
        front = stored(front.join(up, "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("steps") + 1).alias("steps")), "chain")
        out = out.unionByName(front)
        most -= 1
        if most < -1:
            raise ValueError("containment has a cycle")
    return out


def common_ancestor(g: CodeGraph, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``ancestor``: the nearest container of both, which may be one of them; null where there is none."""
    chains = stored(containment_chains(g), "chains")
    a, b = (chains.select(F.col("id").alias(c), "ancestor", F.col("steps").alias(c + "_steps")) for c in "ab")
    met = pairs.distinct().join(a, "a").join(b, ["b", "ancestor"])
    best = met.groupBy("a", "b").agg(F.min_by("ancestor", F.struct("a_steps", "ancestor")).alias("ancestor"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", "ancestor")


def slice_around(g: CodeGraph, start: str, hops: int = 1) -> CodeGraph:
    """The undirected neighbourhood over all but containment, with the containers of what is kept."""
    e = g.edges.where("kind <> 'contains'").select("src", "dst")
    near = bfs(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), _required(g, [start]), hops)
    return induced(g, ancestors(g, near.select("id")))


def shortest_path(g: CodeGraph, a: str, b: str, kinds=KINDS) -> DataFrame:
    """``(pos, id)`` of the least id sequence among the shortest paths; no rows if there is none."""
    spark = g.nodes.sparkSession
    _required(g, [a, b])
    pairs = stored(g.edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct(), "path-edges")
    there = bfs(pairs, spark.createDataFrame([(a,)], "id string"))
    back = bfs(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(b,)], "id string"))
    total = there.where(F.col("id") == b).select("depth").first()
    if total is None:
        return spark.createDataFrame([], "pos int, id string")
    # nodes on some shortest path, then the least next node at every position
    on = stored(there.join(back.withColumnRenamed("depth", "left"), "id").where(F.col("depth") + F.col("left") == total["depth"]).select("id", "depth"), "path-nodes")
    steps = pairs.join(on.select(F.col("id").alias("src"), F.col("depth").alias("at")), "src").join(on.select(F.col("id").alias("dst"), F.col("depth").alias("to")), "dst").where("to = at + 1")
    least = steps.groupBy("src", "at").agg(F.min("dst").alias("dst"))
    walk = bfs(least.select("src", "dst"), spark.createDataFrame([(a,)], "id string"))
    return walk.select(F.col("depth").alias("pos"), "id")
