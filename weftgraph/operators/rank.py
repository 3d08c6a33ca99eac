"""PageRank over calls and imports, strongly connected components and import cycles."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CodeGraph
from ..storage import stored
from .relational import edge_weight
from .traverse import FEW, bfs


def _rank_task(edges: DataFrame, base: DataFrame, damping: float, iterations: int) -> DataFrame:
    rows = edges.select("src", "dst", "p").unionByName(base.select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst"), F.when(F.col("flows"), F.col("r")).otherwise(-1 - F.col("r")).alias("p")))

    def run(batches):
        start, links = {}, []
        for b in batches:
            for s, d, p in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), b.column("p").to_pylist(), strict=True):
                if s is None:
                    start[d] = p
                else:
                    links.append((s, d, p))
        ids = sorted(start)
        at = {x: k for k, x in enumerate(ids)}
        raw = np.array([start[x] for x in ids])
        stuck = raw < 0
        r = np.where(stuck, -1 - raw, raw)
        links.sort()
        s, d, w = np.array([at[x[0]] for x in links], int), np.array([at[x[1]] for x in links], int), np.array([x[2] for x in links])
        score = r.copy()
        for _ in range(iterations):
            got = np.bincount(d, score[s] * w, len(ids)) if len(links) else np.zeros(len(ids))
            score = damping * got + r * (1 - damping + damping * score[stuck].sum())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(score, pa.float64())], names=["id", "score"])

    return rows.coalesce(1).mapInArrow(run, "id string, score double")


def pagerank(g: CodeGraph, damping: float = 0.85, iterations: int = 40, seeds: list[str] | None = None, few: int = FEW) -> DataFrame:
    """``(id, score)``: weighted, fixed passes, the mass of nodes without weight goes to the restart vector.

    A pass is one join on the source and one map-side combined sum on the target. The mass of dangling nodes is one minus
    what moves, so it needs no second pass. Lineage is cut every five passes. Few edges and nodes are one task's.
    """
    e = g.edges.where("kind in ('calls', 'imports')").select("src", "dst", edge_weight(g.edges).alias("w"))
    ids = g.nodes.select("id").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = stored(e.join(out, "src").where("total > 0").select("src", "dst", (F.col("w") / F.col("total")).alias("p")).groupBy("src", "dst").agg(F.sum("p").alias("p")), "rank-edges")
    start = ids
    if seeds:
        named = ids.where(F.col("id").isin(*seeds))
        start = ids if named.isEmpty() else named
    n = start.count()
    restart = start.select("id", F.lit(1.0 / max(n, 1)).alias("r"))
    base = stored(ids.join(restart, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"), F.lit(True).alias("x")).join(out.select(F.col("src").alias("id"), (F.col("total") > 0).alias("flows")), "id", "left").select("id", "r", F.coalesce("flows", F.lit(False)).alias("flows")), "rank-base")
    if e.count() + base.count() <= few:
        return stored(_rank_task(e, base, damping, iterations), "rank")
    score = base.select("id", F.col("r").alias("score"))
    for k in range(iterations):
        sent = e.join(score, e["src"] == score["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        dangling = base.where("not flows").join(score, "id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        score = base.join(sent, "id", "left").join(F.broadcast(dangling)).select("id", (F.coalesce("got", F.lit(0.0)) * damping + F.col("r") * (1 - damping + damping * F.col("lost"))).alias("score"))
        if k % 5 == 4:
            score = stored(score, "rank")
    return score


def _strong(nodes, out) -> dict:
    """Node to the least node of its component; ``out`` has the nodes behind each node that has some."""
    index, low, stack, on, component = {}, {}, [], set(), {}
    for begin in nodes:
        if begin in index:
            continue
        index[begin] = low[begin] = len(index)
        stack.append(begin)
        on.add(begin)
        work = [(begin, iter(out.get(begin, ())))]
        while work:
            v, more = work[-1]
            for w in more:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    component.update(dict.fromkeys(members, least))
    return component


def _tarjan(pairs: DataFrame) -> DataFrame:
    def run(batches):
        out, nodes = defaultdict(list), {}
        for b in batches:
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                nodes[s] = nodes[d] = None
                out[s].append(d)
        component = _strong(nodes, out)
        yield pa.RecordBatch.from_arrays([pa.array(list(component), pa.string()), pa.array(list(component.values()), pa.string())], names=["id", "scc"])

    return pairs.coalesce(1).mapInArrow(run, "id string, scc string")


def scc(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``(id, scc)`` of every node of ``edges(src, dst)``; a component is named by its least node.

    Few edges are one task's; more go by colouring: the least id that reaches a node is its colour, and what a colour's
    root is reached from within the colour is a component; the rest goes round again.
    """
    pairs = stored(edges.select("src", "dst").distinct(), "scc-edges")
    if pairs.count() <= few:
        return stored(_tarjan(pairs), "scc")
    left = stored(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), "scc-nodes")
    done = None
    while not left.isEmpty():
        colour = left.withColumn("c", F.col("id"))
        while True:
            low = pairs.join(colour, pairs["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            nxt = stored(colour.join(low, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), "scc-colour")
            colour = nxt.select("id", "c")
            if nxt.where("moved").isEmpty():
                break
        s, d = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        same = pairs.join(s, "src").join(d, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("id = c").select("id")
        found = bfs(same, roots, few=few).select("id").join(colour, "id").select("id", F.col("c").alias("scc"))
        found = stored(found, "scc-found")
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found, "id", "left_anti"), "scc-nodes")
        pairs = stored(pairs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), "scc-edges")
    return done if done is not None else edges.sparkSession.createDataFrame([], "id string, scc string")


def vertices_in_cycles(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``parts``: the components, where the caller has them."""
    parts = scc(edges) if parts is None else parts
    big = parts.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    return parts.join(big, "scc", "left_semi").select("id").union(loops).distinct()


#: Edges up to which ``cyclic`` is one task's: as numbers they take much less than the strings of ``FEW``.
CYCLE_FEW = 1 << 22


def _cyclic_task(pairs: DataFrame) -> DataFrame:
    """What no edge leads into or out of, of what is left, is peeled off first: chains have nothing left, however long."""

    def run(batches):
        held = [(b.column("src"), b.column("dst")) for b in batches]
        if not held:
            return
        ids = pa.concat_arrays([x[0] for x in held] + [x[1] for x in held]).dictionary_encode()
        at, names = ids.indices.to_numpy(), ids.dictionary
        s, d = at[: len(at) // 2], at[len(at) // 2 :]
        found = set(s[s == d].tolist())
        s, d = s[s != d], d[s != d]
        for _ in range(2):  # along the edges, then against them
            order = np.argsort(s, kind="stable")
            begins, ends = np.searchsorted(s[order], np.arange(len(names) + 1)).tolist(), d[order].tolist()
            into = np.bincount(d, minlength=len(names)).tolist()
            free = [v for v, n in enumerate(into) if not n]
            gone = np.zeros(len(names), bool)
            while free:
                v = free.pop()
                gone[v] = True
                for w in ends[begins[v] : begins[v + 1]]:
                    into[w] -= 1
                    if not into[w]:
                        free.append(w)
            keep = ~(gone[s] | gone[d])
            s, d = d[keep], s[keep]
        out = defaultdict(list)
        for a, b in zip(s.tolist(), d.tolist(), strict=True):
            out[a].append(b)
        several = defaultdict(list)
        for v, c in _strong(list(out), out).items():
            several[c].append(v)
        found.update(v for members in several.values() if len(members) > 1 for v in members)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(sorted(found), pa.int64())).cast(pa.string())], names=["id"])

    return pairs.coalesce(1).mapInArrow(run, "id string")


def cyclic(edges: DataFrame, few: int = CYCLE_FEW) -> DataFrame:
    """``id`` of the nodes of ``edges(src, dst)`` on a cycle, stored; more than ``few`` edges go by components."""
    pairs = stored(edges.select("src", "dst").distinct(), "cycle-edges")
    return stored(_cyclic_task(pairs) if pairs.count() <= few else vertices_in_cycles(pairs), "cyclic")


def mark_import_cycles(g: CodeGraph, strict: bool = False) -> DataFrame:
    """Edges with ``in_cycle`` on value imports between internal modules that are both cyclic; strict: in one component."""
    own = g.nodes.where("kind = 'module' and not coalesce(external, false)").select("id")
    value = g.edges.where("kind = 'imports' and not coalesce(type_only, false)")
    value = value.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    value = stored(value.select("src", "dst"), "value-imports")
    parts = scc(value)
    cyclic = parts.join(vertices_in_cycles(value, parts), "id", "left_semi")
    s, d = cyclic.select(F.col("id").alias("src"), F.col("scc").alias("cs")), cyclic.select(F.col("id").alias("dst"), F.col("scc").alias("cd"))
    e = g.edges.drop("in_cycle").join(s, "src", "left").join(d, "dst", "left")
    both = (F.col("cs") == F.col("cd")) if strict else F.col("cs").isNotNull() & F.col("cd").isNotNull()
    flag = F.when((F.col("kind") == "imports") & ~F.coalesce("type_only", F.lit(False)) & both, True)
    return e.withColumn("in_cycle", flag).select(*g.edges.columns)


def containment_cycles(g: CodeGraph) -> DataFrame:
    """``id``: nodes that contain themselves over some number of steps."""
    return vertices_in_cycles(g.edges.where("kind = 'contains'").select("src", "dst"))
