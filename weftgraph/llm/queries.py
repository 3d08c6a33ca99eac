"""The thin query of each operator, with production parameters, over its whole table, and the SQL that expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact_dedup, ngram_join, pii, quality, secret_scan, sharding, url_filter, warc
from .common import table

#: Bytes of a shard in ``op4_sharding``.
SHARD_BYTES = 256 << 10
#: Key of the surrogates in ``op6_pii``; a deployment passes its own secret.
PII_KEY = "example-key"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.url_filter(table(spark, sf_dir, "pages"))
    return out.select(F.col("__id").alias("page_id"), "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("__id").alias("doc_id"), "lang", "n_chars", "perplexity", "threshold", "rejected")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.annotate(docs, table(spark, sf_dir, "benchmark"), prefix="")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select(F.col("__id").alias("doc_id"), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversized")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.col("__pii_n").alias("n_entities"), F.col("__pii_types").alias("types"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("__id").alias("doc_id"), "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("__id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["ord"] < len(secret_scan.BASE))
    return out.select(F.col("__id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_decontam": op3_decontam,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_ngram_join": op7_ngram_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_secret_scan": op10_secret_scan,
}
