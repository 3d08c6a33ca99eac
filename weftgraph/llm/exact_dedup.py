"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space. The first scan takes each row's length and prefix hash, a few
bytes a row. Rows whose length nobody shares are settled; of the rest, those whose (length, prefix hash) nobody shares.
Only rows of surviving (length, prefix hash) keys are read again in full and grouped by their full hash.

Every level is a map-side combined count, so a hot group is a row per task before each shuffle. The surviving keys are
broadcast to the second scan if they are measured to be few; beyond that Spark deals the second scan's rows by key, and
AQE can split a hot one. The join back has the hot keys on the streamed side, which AQE can split too.

Edge cases: a null text counts as empty, so all null, empty and blank texts are one group; ties on code points go to
the smallest doc_id; rows that repeat with the same id and text count in ``group_size`` and are all marked kept,
because kept means "this id is the one that stays"; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, freed, materialise, sized

#: Code points of the normalised text that the second level hashes.
PREFIX = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __cp, __n, __p, __norm``: narrow, no shuffle."""
    norm = docs.select(F.col(id_col).alias("__id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("__cp"), normalised(F.col(text_col)).alias("__norm"))
    return norm.select("__id", "__cp", F.length("__norm").alias("__n"), F.xxhash64(F.substring("__norm", 1, PREFIX)).alias("__p"), "__norm")


def survivors(sig: DataFrame) -> DataFrame:
    """The keys ``(__n, __p)`` that several rows share, looked for only among rows whose length is shared."""
    lengths = materialise(sig.groupBy("__n").agg(F.count("*").alias("__c")).where("__c > 1").select("__n"), "dedup-lengths")
    left = sig.join(sized(lengths), "__n", "left_semi")
    return materialise(left.groupBy("__n", "__p").agg(F.count("*").alias("__c")).where("__c > 1").select("__n", "__p"), "dedup-prefixes")


def _judged(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """One row per input row: ``__id, __cp, __n, __p, __sha, __size, __keep, kept``; ``__sha`` is null where nobody asked for it."""
    sig = materialise(_read(docs, id_col, text_col).drop("__norm"), "dedup-sig")
    shared = survivors(sig)
    again = _read(docs, id_col, text_col)
    hashed = [*sig.columns, F.sha2("__norm", 256).alias("__sha")]
    if digest_all:
        full = materialise(again.select(*hashed), "dedup-full")
        members = full.join(sized(shared, 16), ["__n", "__p"], "left_semi")
    else:
        full = members = materialise(again.join(sized(shared, 16), ["__n", "__p"], "left_semi").select(*hashed), "dedup-full")
    best = F.min(F.struct(-F.col("__cp"), F.col("__id").isNull(), F.col("__id")))
    same = members.groupBy("__n", "__p", "__sha").agg(F.count("*").alias("__size"), best.alias("__best")).where("__size > 1")
    # stored, so that the join back is one of two plain tables, whose hot keys AQE can split or do without a shuffle
    same = materialise(same, "dedup-groups")
    out = full.join(sized(same, 120), ["__n", "__p", "__sha"], "left").select("__id", "__cp", "__n", "__p", "__sha", "__size", F.col("__best.__id").alias("__keep"))
    if not digest_all:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("__sha", "string"), ("__size", "long"))]
        alone = sig.join(sized(shared, 16), ["__n", "__p"], "left_anti")
        out = out.unionByName(alone.select("__id", "__cp", "__n", "__p", *none, F.lit(None).cast(sig.schema["__id"].dataType).alias("__keep")))
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return out.withColumn("__keep", keep).withColumn("kept", F.col("__keep").eqNullSafe(F.col("__id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = True) -> DataFrame:
    """One row per input row: ``__id, keep_id, group_size, kept, text_sha256``.

    ``digest_all``: the caller wants the digest of every row, so the second scan computes it for all; the groups still come
    from the survivors. Without it ``text_sha256`` is null for rows that the first two levels settled.
    """
    out = _judged(docs, id_col, text_col, digest_all)
    return out.select("__id", F.col("__keep").alias("keep_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), "kept", F.col("__sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, columns as they were.

    A null id is never the one that stays unless its whole group has null ids, and such rows all stay. Dropped rows are
    known by (id, lengths, prefix hash); only where one id has several texts under one such key is the full hash asked again.
    """
    with freed(docs.sparkSession):
        out = materialise(_judged(docs, id_col, text_col, digest_all=False).where("__sha is not null"), "dedup-judged")
        key = ["__id", "__cp", "__n", "__p"]
        by = out.groupBy(*key).agg(F.min("__sha").alias("__lo"), F.max("__sha").alias("__hi"), F.max(~F.col("kept")).alias("__lost")).where("__lost")
        by = materialise(by, "dedup-lost")
        clash = by.where("__lo <> __hi").select(*[F.col(c).alias(c + "_") for c in key])
        several = out.where(~F.col("kept")).join(clash, F.col("__id").eqNullSafe(F.col("__id_")) & (F.col("__cp") == F.col("__cp_")) & (F.col("__n") == F.col("__n_")) & (F.col("__p") == F.col("__p_")), "left_semi")
        lost = by.where("__lo = __hi").select(*key, F.lit(None).cast("string").alias("__sha"))
        lost = materialise(lost.unionByName(several.select(*key, "__sha").distinct()), "dedup-drop", keep=True)
    norm = normalised(docs[text_col])
    # id and length are the join's key; the rest, which takes white space out, is asked for only where they agree
    near = docs[id_col].eqNullSafe(lost["__id"]) & (F.length(F.coalesce(docs[text_col], F.lit(""))) == lost["__cp"])
    same = (F.length(norm) == lost["__n"]) & (F.xxhash64(F.substring(norm, 1, PREFIX)) == lost["__p"]) & (lost["__sha"].isNull() | (F.sha2(norm, 256) == lost["__sha"]))
    return docs.join(sized(lost, 100), near & F.coalesce(same, F.lit(False)), "left_anti")
