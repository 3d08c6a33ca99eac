"""Streams of file changes: debounced saves, and fact tables that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def debounce(events: DataFrame, key: str, ts: str, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst: a key's events no further apart than the gap, with its end and size. Batch or stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    burst = e.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("saves"))
    return burst.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("refresh_at"), "saves")


def latest(files: DataFrame, order: str) -> DataFrame:
    """The newest version of each path."""
    rest = [c for c in files.columns if c not in ("path", order)]
    return files.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("r")).select("path", "r.*")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose text differs or that only one side has."""
    a, b = old.select("path", F.sha2("text", 256).alias("a")), new.select("path", F.sha2("text", 256).alias("b"))
    return a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def digests(files: DataFrame) -> DataFrame:
    """``path, digest``: what is kept of a pass to compare the next one with."""
    return files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def decision(old: DataFrame, new: DataFrame, same_options: bool = True) -> DataFrame:
    """One row ``pass, changed``: ``cold`` if options or the set of paths differ, ``cached`` if nothing does, else ``partial``.

    ``old, new``: as of ``digests``.
    """
    a, b = old.select("path", F.col("digest").alias("a")), new.select("path", F.col("digest").alias("b"))
    both = a.join(b, "path", "full")
    n = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("other"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
    cold = F.lit(not same_options) | (F.col("other") > 0)
    return n.select(F.when(cold, "cold").when(F.col("changed") == 0, "cached").otherwise("partial").alias("pass"), "changed")


class Incremental:
    """Passes over file sets, in batch or from ``writeStream.foreachBatch(analyzer.on_batch)`` of whole snapshots.

    ``extract(files)`` gives facts with a ``path``; a partial pass extracts only the dirty files (changed ones and their
    direct importers, by ``index(facts)``: ``file, imports``) and keeps the others' facts. State is two stored tables.
    ``progress(phase, done, total)`` is told of every pass; it may raise to stop before the next phase.
    """

    def __init__(self, extract, index, progress=None):
        self.extract, self.index, self.tell = extract, index, progress or (lambda *_: None)
        self.known = self.facts = self.options = self.last = None

    def analyze(self, files: DataFrame, options=None) -> DataFrame:
        fresh = stored(digests(files), "digests")
        first = self.known is None
        self.last = "cold" if first else decision(self.known, fresh, options == self.options).first()["pass"]
        self.tell(self.last, 0, 1)
        if self.last == "cold":
            self.facts = stored(self.extract(files), "facts")
        elif self.last == "partial":
            old = self.known.select("path", F.col("digest").alias("was"))
            touched = stored(fresh.join(old, "path").where("digest <> was").select("path"), "touched")
            near = dirty_closure(self.index(self.facts), touched, 0).where("role = 'dirty'").select(F.col("file").alias("path"))
            near = stored(near, "dirty")
            again = files.join(near, "path", "left_semi")
            self.facts = stored(merge_facts(self.facts, self.extract(again), near), "facts")
        self.known, self.options = fresh, options
        self.tell(self.last, 1, 1)
        return self.facts

    def on_batch(self, files: DataFrame, _batch: int) -> None:
        self.analyze(files)


def merge_facts(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Facts of untouched files as they were, those of touched ones replaced; resolution then runs over all facts."""
    return old.join(touched.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def dependency_index(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file, imports)``: pairs of files of which one imports the other, externals left out."""
    own = nodes.where("file is not null").select("id", "file")
    e = edges.where("kind = 'imports'").join(own.select(F.col("id").alias("src"), "file"), "src").join(own.select(F.col("id").alias("dst"), F.col("file").alias("imports")), "dst")
    return e.where("file <> imports").select("file", "imports").distinct()


def dirty_closure(index: DataFrame, touched: DataFrame, levels: int = 2) -> DataFrame:
    """``(file, role)``: touched files and their direct importers are ``dirty``; what those import within levels is ``context``."""
    hit = touched.select(F.col("path").alias("file"))
    dirty = hit.unionByName(index.join(hit.select(F.col("file").alias("imports")), "imports", "left_semi").select("file")).distinct()
    near = front = dirty
    for _ in range(levels):
        front = index.join(front, "file", "left_semi").select(F.col("imports").alias("file")).distinct()
        near = near.unionByName(front)
    seen = near.distinct().join(dirty.withColumn("role", F.lit("dirty")), "file", "left")
    return seen.select("file", F.coalesce("role", F.lit("context")).alias("role"))


def followed(events: DataFrame, session: str, order: list[str], file: str = "file") -> DataFrame:
    """Events ``following, pinned, <file>`` that switch the shown file: followed, not pinned, another file than the last such."""
    live = events.where("following AND NOT pinned")
    last = F.lag(file).over(Window.partitionBy(session).orderBy(*order))
    return live.withColumn("__last", last).where(~F.col("__last").eqNullSafe(F.col(file))).drop("__last")
