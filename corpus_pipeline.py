"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, BPE; each stage on what the one before kept.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes each stage's result as Parquet in the shared folder and
reads it back for the next; what a stage made on its way, and its input, are deleted once its result is stored. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, exact_dedup, ngram_join, quality
from weftgraph.llm.common import freed, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), left_out=True)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("__id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", decontam_stage), ("bpe", bpe_stage)]

#: The quality stage is a trained model, which SQL can't express; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with freed(spark, before):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs, before = spark.read.schema(out.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
