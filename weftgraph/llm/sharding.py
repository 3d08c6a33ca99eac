"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split.

A bucket is a prefix of the 60-bit hash of a row's key. Byte sums per fine cell (map-side combined) stand for the rows
while buckets split bit by bit; only buckets that are still oversized at the depth of the cells go back to their rows
for deeper cells. Rows are then joined to the directory on their cell, so no bucket's rows ever meet in one task.

Edge cases: a null key hashes the text instead; a null text has 0 bytes; rows whose hashes are all the same can't be
parted by bits, so such a bucket ends as one shard with ``oversized`` true, as does a single row beyond the limit; an
empty table gives an empty result; repeated rows share a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BITS = 60
#: Bits of a cell beyond the depth at which the mean bucket would fit.
FINE_BITS = 6


def key_hash(key: Column, text: Column) -> Column:
    """The first 60 bits of md5, as a long that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: int | Column) -> Column:
    shift = F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.call_function("shiftright", h, shift.cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``cell_depth, cell, depth, bucket, shard_bytes, shard_rows, oversized`` from rows ``(__h, __b)``."""
    total = rows.agg(F.sum("__b")).first()[0] or 0
    fits = max(0, math.ceil(math.log2(max(1, total / limit))))
    depth, cell_depth, left, parts = 0, min(BITS, fits + FINE_BITS), rows, []
    while True:
        cells = materialise(left.groupBy(_prefix(F.col("__h"), cell_depth).alias("cell")).agg(F.sum("__b").alias("b"), F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")), "shard-cells")
        here = cells.select("cell", "b", "n", "lo", "hi", F.lit(None).cast("int").alias("depth"))
        for d in range(depth, cell_depth + 1):
            at = F.call_function("shiftright", F.col("cell"), F.lit(cell_depth - d))
            sums = here.where("depth is null").groupBy(at.alias("__p")).agg(F.sum("b").alias("__s"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
            done = sums.where((F.col("__s") <= limit) | (F.col("__lo") == F.col("__hi"))).select("__p")
            here = here.join(done, at == done["__p"], "left").select("cell", "b", "n", "lo", "hi", F.when(F.col("depth").isNull() & F.col("__p").isNotNull(), d).otherwise(F.col("depth")).alias("depth"))
            if d % 4 == 3:
                here = materialise(here, "shard-dir")
        here = materialise(here, "shard-dir")
        parts.append(here.where("depth is not null").select(F.lit(cell_depth).alias("cell_depth"), "cell", "depth", "b", "n"))
        open_cells = here.where("depth is null").select("cell")
        if cell_depth >= BITS or open_cells.isEmpty():
            break
        left = left.join(open_cells, _prefix(F.col("__h"), cell_depth) == open_cells["cell"], "left_semi")
        depth, cell_depth = cell_depth + 1, min(BITS, cell_depth + 2 * FINE_BITS)
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = cells.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.col("cell_depth") - F.col("depth")))
    sums = cells.groupBy("depth", "bucket").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    return materialise(cells.select("cell_depth", "cell", "depth", "bucket").join(sums, ["depth", "bucket"]).withColumn("oversized", F.col("shard_bytes") > limit), "shard-dir")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``__id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized``.

    ``shard`` is the bucket's bit string; the root bucket (everything fits one shard) is the empty string.
    """
    text = F.col(text_col)
    rows = materialise(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__b"), key_hash(F.col(id_col), text).alias("__h")), "shard-rows")
    cells = directory(rows, limit)
    depths = [r[0] for r in cells.select("cell_depth").distinct().orderBy("cell_depth").collect()]  # a handful of levels
    out = None
    for d in depths:
        level = cells.where(F.col("cell_depth") == d)
        got = rows.join(level, _prefix(F.col("__h"), d) == level["cell"])
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = rows.join(cells, F.col("__h") == F.col("cell"))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(bucket), depth, '0')"))
    return out.select("__id", F.col("__b").alias("n_bytes"), bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", "oversized")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write each shard's rows below ``shard=<bits>``; ids must be unique."""
    a = assigned.select(F.col("__id"), F.concat(F.lit("b"), "shard").alias("shard"))
    docs.join(a, docs[id_col] == a["__id"]).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)
