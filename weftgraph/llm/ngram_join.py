"""Jaccard self-join of word-shingle sets with adaptive multi-match prefixes.

A text's set is its distinct 5-word shingles. Two sets link when their Jaccard similarity is at least 0.75. The result is
one row per document with its component, found without listing the pairs inside a group of copies.

1. Classes. Texts with the same set are one class (128-bit key), so copies cost one row each and are never paired.
2. Order. A fixed-size sketch of shingle counts over all documents (``2**SKETCH_BITS`` cells whatever the input) gives a
   rarity order that all tasks share. An estimate that is off changes work, never results: any common order is right. What
   other shingles add to a cell on the median is taken off, as it grows with the input and would hide what is frequent.
3. Adaptive prefixes. Sets that link share at least l shingles of their l-prefixes (the first ``n - ceil(0.75 n) + l`` in
   the order). Each class takes the l of least estimated cost: longer prefixes cost postings, but candidates must then
   share more of them. Two classes are candidates if they share ``min(l, l')`` prefix shingles.
4. Short runs. Classes that share a prefix shingle form its run. Postings are dealt by shingle, and one that the sketch
   has as hot also by class, so that it spreads over as many tasks as its size asks for; such a run is passed on as rows. Many
   postings are dealt in up to ``PASSES`` slices of the shingles, one after the other, so that the disk holds one slice's
   shuffle at a time; each slice is a pass over the texts. In runs of at most ``LONG`` classes the pairs are listed (so at most ``LONG / 2`` a posting), counted, and kept if
   they share enough. Groups of such candidates are verified together, each text moving once a group.
5. Long runs, of a shingle in many classes, are never listed as pairs. Their classes are first tried against the
   ``PIVOTS`` pivots that they share most shingles with, a run having a central pivot and two by hash; what links is joined
   into components, and runs that lie within one component are done. Classes of the runs left are compared within their
   connected groups block by block. A pair that shares a long run's shingle is compared there; a pair that shares none has
   all its shared shingles in short runs. So no link is lost, and there are no caps.

What grows beyond the input is the rest of step 5: m classes that share shingles of long runs and that the pivots leave
apart are compared in all pairs of blocks of ``BLOCK``, so that each text is copied ``m / BLOCK`` times.

Verification compares whole sets. Texts travel only for classes that are in some candidate pair; a class paired with very
many others is dealt out in chunks. Runs are streamed in sorted order and held for ``LONG`` rows at most.

Shingles are compared by 64-bit hashes.

Edge cases: null, empty and blank texts have no set, link with nothing, and are their own component; texts of fewer than
five words are one shingle; rows that repeat with one id are one document; a row with a null id belongs to the component
of the rows with an id that have its set, and has a null ``component_id`` and no other links where there are none; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, freed, materialise, release_shuffles, sized, trimmed
from .components import connected_components

# Fixed values of the contract.
SHINGLE = 5
#: Sets link when OVER times the intersection reaches UNDER times the union.
OVER, UNDER = 4, 3

SKETCH_BITS = 24
SLOT_BITS = 10
#: A task's count of a cell stops here.
MOST = 50000
#: The longest multi-match prefix tried, and what verifying one candidate costs in postings read.
MAX_L, VERIFY_COST = 4, 8
#: Pivots that a class of a long run is tried against before the exact rest.
PIVOTS = 2
#: Partners of one class in one verification group.
CHUNK = 256
#: Postings by the sketch's estimate that one task gets of a shingle; beyond it the shingle is dealt by class, too.
SPREAD = 4096
#: Postings of a slice of the shingles, and the most slices.
SLICE, PASSES = 1 << 26, 3
#: Classes of a run whose pairs are listed; classes, and shingles, of a block.
LONG, BLOCK, BLOCK_SHINGLES = 64, 512, 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles."""
    import xxhash

    ws = text.translate(_LOWER).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out ^ h[j : j + n]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    out ^= out >> np.uint64(32)
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    x, y = len(a), len(b)
    if not x or not y or OVER * min(x, y) < UNDER * max(x, y):
        return False
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return OVER * inter >= UNDER * (x + y - inter)


def class_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _raw(column) -> list[bytes | None]:
    return [None if not t.is_valid else t.as_buffer().to_pybytes() for t in column]


def prefix(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int, int]:
    """``(prefix, l, centrality)`` of a set: rarest first, with the l of least estimated cost."""
    lv = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((s, lv))
    n = len(s)
    need = -(-UNDER * n // OVER)
    base = n - need
    est = np.exp2(lv[order[: base + MAX_L]].astype(np.float64) / 8) - 1
    read = np.cumsum(est)
    most = min(MAX_L, need)
    cost = [read[base + k - 1] * (1 + VERIFY_COST / k**2) + k for k in range(1, most + 1)]
    best = int(np.argmin(cost)) + 1
    return s[order[: base + best]], best, int(lv.mean() * 4)


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (slot null) and, per task, of the sketch (slot set)."""

    def run(batches):
        import zstandard

        cells = None
        for b in batches:
            n, k1, k2, all_sets = [], [], [], []
            for text in _raw(b.column("__text")):
                s = shingles(text)
                key = class_key(s) if len(s) else (None, None)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                all_sets.append(s)
            if sum(n):
                cells = np.zeros(1 << SKETCH_BITS, np.uint16) if cells is None else cells
                at = (np.concatenate(all_sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                for k in range(0, len(at), MOST // 4):
                    part = at[k : k + MOST // 4]  # adds less than what is left above MOST
                    np.add.at(cells, part, 1)
                    cells[part] = np.minimum(cells[part], MOST)
            m = len(n)
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["id", "n", "k1", "k2", "slot", "cells"])
        if cells is not None:
            z = zstandard.ZstdCompressor(level=1)  # most cells are 0 or 1
            packed = [z.compress(part.tobytes()) for part in cells.reshape(1 << SLOT_BITS, -1)]
            m = len(packed)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 4 + [pa.array(np.arange(m), pa.int32()), pa.array(packed, pa.binary())], names=["id", "n", "k1", "k2", "slot", "cells"])

    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return src.mapInArrow(lambda b: trimmed(run(b)), "id long, n long, k1 long, k2 long, slot int, cells binary")


def level(counts: np.ndarray) -> np.ndarray:
    """Counts of cells less what the median cell has, on a log scale; a cell that is met counts 1 at least."""
    own = np.maximum(counts - int(np.median(counts)), np.minimum(counts, 1))
    return np.minimum(255, np.rint(8 * np.log2(1 + own))).astype(np.uint8)


def _levels(sig: DataFrame) -> np.ndarray:
    """The summed sketch on a log scale: one byte a cell, of a fixed number of cells."""

    def add(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, cells in zip(b.column("slot").to_pylist(), b.column("cells").to_pylist(), strict=True):
                c = np.frombuffer(z.decompress(cells), np.uint16)
                total[slot] = total[slot] + c if slot in total else c.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([level(c).tobytes() for c in total.values()], pa.binary())], names=["slot", "levels"])

    width = (1 << SKETCH_BITS) >> SLOT_BITS
    out = np.zeros((1 << SLOT_BITS, width), np.uint8)
    for r in sig.where("slot is not null").select("slot", "cells").repartition("slot").mapInArrow(lambda b: trimmed(add(b)), "slot int, levels binary").collect():
        out[r["slot"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def slices(postings: int) -> int:
    """Passes over the texts that so many postings are dealt in."""
    return min(PASSES, max(1, -(-postings // SLICE)))


def salts(tokens: np.ndarray, k1: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Which of its tasks a posting goes to: 0 where the shingle has one, else 1 and up, by class."""
    est = np.exp2(levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.float64) / 8) - 1
    tasks = np.minimum(np.ceil(est / SPREAD), 1 << 20).astype(np.int64)
    return np.where(tasks > 1, 1 + k1 % np.maximum(tasks, 1), 0).astype(np.int32)


def _postings(docs: DataFrame, text_col: str, levels, part: int = 0, parts: int = 1) -> DataFrame:
    """Prefix shingles of each class, of one slice of all shingles; a task posts a class once however many copies it reads."""

    def run(batches):
        lv = levels.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            tokens, meta = [], []
            for text in _raw(b.column("__text")):
                s = shingles(text)
                if not len(s) or (key := class_key(s)) in seen:
                    continue
                seen.add(key)
                p, k, mid = prefix(s, lv)
                p = p[p % np.uint64(parts) == part]
                tokens.append(p)
                meta.append((*key, len(s), k, mid, len(p)))
            if tokens:
                m = np.array(meta, np.int64)
                t = np.concatenate(tokens)
                cols = [t.view(np.int64), *(np.repeat(m[:, c], m[:, 5]) for c in range(5))]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), *(pa.array(c.astype(np.int32)) for c in cols[3:]), pa.array(salts(t, cols[1], lv))], names=["token", "k1", "k2", "n", "l", "mid", "salt"])

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(lambda b: trimmed(run(b)), "token long, k1 long, k2 long, n int, l int, mid int, salt int")


_RUNS = "kind int, token long, k1 long, k2 long, n int, l int, mid int, h1 long, h2 long"
#: Kinds of rows: a pair of classes that share a short run's shingle; a class of a long run, or of one that is dealt to many tasks.
_PAIR, _MEMBER = 0, 1


def _pairs_of(t: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray):
    """The pairs within runs of one size each time, as positions; only those whose sizes fit."""
    for s in np.unique(size):
        first = start[size == s]
        i, j = np.triu_indices(s, 1)
        x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        lo, hi = np.minimum(t["n"][x], t["n"][y]), np.maximum(t["n"][x], t["n"][y])
        fits = OVER * lo.astype(np.int64) >= UNDER * hi.astype(np.int64)
        yield x[fits], y[fits]


def _runs(postings: DataFrame) -> DataFrame:
    """Pairs of short runs and members of all others, from postings dealt by (token, salt) and sorted."""
    names = ["token", "k1", "k2", "n", "l", "mid"]

    def members(t, pick):
        m = {c: t[c][pick] for c in names}
        k = len(m["token"])
        cols = [pa.array(np.full(k, _MEMBER, np.int32)), *(pa.array(m[c]) for c in names), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["kind", *names, "h1", "h2"])

    def run(batches):
        held = {c: np.zeros(0, np.int32 if c in ("n", "l", "mid") else np.int64) for c in names}
        flushed, last = None, None  # a token whose run is already long; the last posting
        for b in batches:
            t = {c: b.column(c).to_numpy() for c in names}
            if not b.num_rows:
                continue
            many = b.column("salt").to_numpy() > 0
            same = np.zeros(b.num_rows, bool)
            same[1:] = (t["token"][1:] == t["token"][:-1]) & (t["k1"][1:] == t["k1"][:-1]) & (t["k2"][1:] == t["k2"][:-1])
            same[0] = last == tuple(t[c][0] for c in names[:3])
            last = tuple(t[c][-1] for c in names[:3])
            many = np.append(np.zeros(len(held["token"]), bool), many[~same])  # what is held has one task
            t = {c: np.concatenate((held[c], t[c][~same])) for c in names}
            if not len(t["token"]):
                continue
            start = np.flatnonzero(np.append(True, t["token"][1:] != t["token"][:-1]))
            size = np.diff(np.append(start, len(t["token"])))
            of = t["token"][start]
            # the last run may go on; it is held until it is long, and then passed on as it comes
            keep = np.zeros(len(start), bool)
            keep[-1] = not many[start[-1]] and of[-1] != flushed and size[-1] <= LONG
            alone = many[start] | (of == flushed) | (size > LONG)
            if alone[-1]:
                flushed = of[-1]
            if alone.any():
                yield members(t, np.repeat(alone, size))
            short = ~alone & ~keep & (size > 1)
            for x, y in _pairs_of(t, start[short], size[short]):
                for at in range(0, len(x), 1 << 15):
                    i, j = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                    none = pa.nulls(len(i), pa.int32())
                    cols = [pa.array(np.full(len(i), _PAIR, np.int32)), pa.nulls(len(i), pa.int64()), pa.array(t["k1"][i]), pa.array(t["k2"][i]), none, pa.array(np.minimum(t["l"][i], t["l"][j])), none, pa.array(t["k1"][j]), pa.array(t["k2"][j])]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", *names, "h1", "h2"])
            held = {c: v[np.repeat(keep, size)] for c, v in t.items()}
        if len(held["token"]):
            yield members(held, slice(None))

    dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "k1", "k2")
    return dealt.mapInArrow(lambda b: trimmed(run(b)), _RUNS)


def _cut_pairs(cut: DataFrame) -> DataFrame:
    """``k1, k2, h1, h2, l`` of the short runs that were dealt to many tasks, few rows of each."""
    x, y = (cut.select("token", *[F.col(c).alias(side + c) for c in ("k1", "k2", "n", "l")]) for side in "xy")
    later = (F.col("xk1") < F.col("yk1")) | ((F.col("xk1") == F.col("yk1")) & (F.col("xk2") < F.col("yk2")))
    both = x.join(y, "token").where(later & _fits("xn", "yn"))
    return both.select(F.col("xk1").alias("k1"), F.col("xk2").alias("k2"), F.col("yk1").alias("h1"), F.col("yk2").alias("h2"), F.least("xl", "yl").alias("l"))


def _texts(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, t)`` of the wanted ids; the ids are sent to the scan if they are measured to be few, else both are dealt out."""
    wanted = materialise(ids.distinct(), "join-wanted")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(sized(wanted), "id")
    return materialise(found, "join-texts")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose sets link; b's set is held while its a's stream past in chunks."""
    sizes = pairs.groupBy("b").agg(F.count("*").alias("c"))
    dealt = materialise(pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / CHUNK)).cast("int").alias("part")), "join-pairs")
    texts = _texts(dealt.select(F.col("a").alias("id")).union(dealt.select("b")), docs, id_col, text_col)
    left = dealt.join(texts, dealt["a"] == texts["id"]).select("b", "part", F.col("a").alias("who"), F.lit(1).alias("kind"), "t")
    right = dealt.select("b", "part").distinct().join(texts, F.col("b") == texts["id"]).select("b", "part", F.col("b").alias("who"), F.lit(0).alias("kind"), "t")

    def run(batches):
        held, own = None, None
        for b in batches:
            a_out, b_out = [], []
            for pivot, who, kind, text in zip(b.column("b").to_pylist(), b.column("who").to_pylist(), b.column("kind").to_pylist(), _raw(b.column("t")), strict=True):
                s = shingles(text)
                if kind == 0:
                    held, own = pivot, s
                elif held != pivot:
                    raise ValueError("a verification group has no pivot")
                elif linked(own, s):
                    a_out.append(who)
                    b_out.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", "kind").mapInArrow(lambda b: trimmed(run(b)), "a long, b long")


def compare(sets: list[np.ndarray], sides: list[int], cross: bool) -> list[tuple[int, int]]:
    """Links among some sets that connect all that link, as positions; with cross, only between the two sides."""
    n = len(sets)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []

    def join(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))

    if n <= 6:
        for a in range(n):
            for b in range(a):
                if (not cross or sides[a] != sides[b]) and root(a) != root(b) and linked(sets[a], sets[b]):
                    join(a, b)
        return out
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times > 1
    place = np.cumsum(keep) - 1
    owner = np.repeat(np.arange(n), sizes)[keep[token]]
    column = place[token[keep[token]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((n, n), np.float32)
    width = 4096
    for begin in range(0, int(keep.sum()), width):
        lo, hi = np.searchsorted(column, (begin, begin + width))
        x = np.zeros((n, width), np.float32)
        x[owner[lo:hi], column[lo:hi] - begin] = 1
        inter += x @ x.T
    ok = OVER * inter >= UNDER * (sizes[:, None] + sizes[None, :] - inter)
    ok &= np.tri(n, n, -1, dtype=bool)
    if cross:
        side = np.array(sides)
        ok &= side[:, None] != side[None, :]
    for a, b in zip(*np.nonzero(ok), strict=True):
        join(int(a), int(b))
    return out


def _block_links(dealt: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``(a, b)`` within blocks; rows ``(g, i, j, side, rep)``, a block being (g, i, j) of at most two sides."""
    texts = _texts(dealt.select(F.col("rep").alias("id")), docs, id_col, text_col).withColumnRenamed("id", "rep")

    def run(batches):
        key, ids, sides, sets = None, [], [], []

        def links():
            found = compare(sets, sides, key[1] != key[2]) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for g, i, j, side, rep, text in zip(*(b.column(c).to_pylist() for c in ("g", "i", "j", "side", "rep")), _raw(b.column("t")), strict=True):
                if (g, i, j) != key:
                    if key is not None:
                        yield links()
                    key, ids, sides, sets = (g, i, j), [], [], []
                ids.append(rep)
                sides.append(side)
                sets.append(shingles(text))
        if key is not None:
            yield links()

    return dealt.join(texts, "rep").select("g", "i", "j", "side", "rep", "t").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(lambda b: trimmed(run(b)), "a long, b long")


def _dealt(groups: DataFrame, known: DataFrame) -> DataFrame:
    """``(g, rep)`` dealt into blocks of bounded size, every pair of blocks of a group meeting once."""
    sized_groups = groups.join(known.select("rep", "n"), "rep")
    sizes = sized_groups.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    rows = groups.join(sizes, "g").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("g", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "rep")


def _fits(x: str, y: str):
    return OVER * F.least(x, y) >= UNDER * F.greatest(x, y)


def _labelled(rows: DataFrame, labels: DataFrame | None, key: str, name: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(name, F.col(key))
    found = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return rows.join(found, rows[key] == found["__n"], "left").withColumn(name, F.coalesce("__c", key)).drop("__n", "__c")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``__id, n_shingles, component_id``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sig = materialise(_signatures(docs, id_col, text_col), "join-sig")
    rows = sig.where("slot is null").select("id", "n", "k1", "k2")
    # a class stands under the smallest id that has its set
    classes = materialise(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "join-classes")
    levels = spark.sparkContext.broadcast(_levels(sig))  # 2**SKETCH_BITS bytes
    # of n shingles at most n / 4 + MAX_L are posted
    parts = slices(int(classes.agg(F.sum(F.col("n") / OVER + MAX_L).cast("long")).first()[0] or 0))
    runs = None
    for part in range(parts):
        found = materialise(_runs(_postings(docs, text_col, levels, part, parts)), "join-runs")
        runs = found if runs is None else runs.unionByName(found)
        release_shuffles(spark)  # that of the postings is the largest by far
    levels.unpersist()
    known = classes.where("rep is not null")
    keys = known.select("k1", "k2", "rep")
    links, labels = None, None

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        found = materialise(found, "join-links")
        links = found if links is None else links.unionByName(found)
        labels = materialise(connected_components(links, "a", "b"), "join-labels")

    members = runs.where(F.col("kind") == _MEMBER).select("token", "k1", "k2", "n", "l", "mid")
    hot = materialise(members.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > LONG).select("token"), "join-hot")
    long = members.join(sized(hot), "token", "left_semi").join(keys, ["k1", "k2"]).select("token", "rep", "n", "mid")
    long = materialise(long, "join-long")
    if not long.isEmpty():
        best = lambda *by: F.max(F.struct(*by, F.col("rep").alias("p"), F.col("n").alias("pn")))
        pivot = long.groupBy("token").agg(best("mid").alias("x"), best(F.xxhash64("rep")).alias("y"), best(F.xxhash64("rep", F.lit(1))).alias("z"))
        pivot = pivot.select("token", F.explode(F.array_distinct(F.array(*[F.struct(F.col(c).getField("p").alias("p"), F.col(c).getField("pn").alias("pn")) for c in "xyz"]))).alias("v"))
        pivot = materialise(pivot.select("token", "v.p", "v.pn"), "join-pivots")
        near = long.join(sized(pivot, 20), "token").where((F.col("rep") != F.col("p")) & _fits("n", "pn")).groupBy("rep", "p").agg(F.count("*").alias("c"))
        near = near.withColumn("o", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("c"), "p"))).where(F.col("o") <= PIVOTS)
        add(_verified(materialise(near.select(F.col("rep").alias("a"), F.col("p").alias("b")), "join-try"), docs, id_col, text_col))
        # what the pivots left apart: all classes of a group against all
        long = _labelled(long, labels, "rep", "comp")
        lead = long.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("rep").alias("lead")).where("x <> y").select("token", "lead")
        lead = materialise(lead, "join-open")
        if not lead.isEmpty():
            groups = materialise(connected_components(long.join(sized(lead, 16), "token").select("rep", "lead"), "rep", "lead"), "join-groups").select(F.col("component").alias("g"), F.col("node").alias("rep"))
            add(_block_links(materialise(_dealt(groups, known), "join-dealt"), docs, id_col, text_col))

    cut = members.join(sized(hot), "token", "left_anti")
    pairs = runs.where(F.col("kind") == _PAIR).select("k1", "k2", "h1", "h2", "l").unionByName(_cut_pairs(cut))
    pairs = pairs.groupBy("k1", "k2", "h1", "h2").agg(F.count("*").alias("c"), F.min("l").alias("l")).where("c >= l")
    pairs = pairs.join(keys.withColumnRenamed("rep", "a"), ["k1", "k2"]).join(known.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("rep").alias("b")), ["h1", "h2"]).select("a", "b")
    pairs = _labelled(_labelled(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b")
    pairs = materialise(pairs, "join-pairs")
    if not pairs.isEmpty():
        groups = materialise(connected_components(pairs, "a", "b"), "join-groups").select(F.col("component").alias("g"), F.col("node").alias("rep"))
        big = groups.groupBy("g").agg(F.count("*").alias("s")).where(F.col("s") > BLOCK).select("g")
        found = _block_links(materialise(_dealt(groups.join(big, "g", "left_anti"), known), "join-dealt"), docs, id_col, text_col)
        apart = materialise(pairs.join(groups.join(big, "g", "left_semi").select(F.col("rep").alias("a")), "a", "left_semi"), "join-apart")
        if not apart.isEmpty():
            found = found.unionByName(_verified(apart, docs, id_col, text_col))
        add(found)
    out = rows.join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    out = _labelled(out.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))), labels, "rep", "component_id")
    return out.select(F.col("id").alias("__id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, columns as they were."""
    with freed(docs.sparkSession):
        out = jaccard_components(docs, id_col, text_col)
        lost = materialise(out.where("component_id < __id").select("__id").distinct(), "join-drop", keep=True)
    return docs.join(sized(lost), docs[id_col].cast("long") == lost["__id"], "left_anti")
