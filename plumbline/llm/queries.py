"""The queries of this subpackage, op1 to op10 and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, mixing, near_dedup, pii, quality, sharding, tokens, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "shared", "n_shingles")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.listed_keys(spark))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    keys = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(t).cast("bigint") + 8).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    out = sharding.shard_keys(keys)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("stored_bytes")


def op6_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), details=True)
    return out.select("doc_id", "source", F.col("mix_copy").alias("copy"), F.col("mix_copies").alias("copies"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_prints(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4).drop("set_digest")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pii, op2_decontamination, op3_url_filter, op4_sharding, op5_warc, op6_token_counts, op7_mixing, op8_fingerprints, op9_near_dedup, op10_quality, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": pii.oracle_sql(),
        "op2_decontamination": decontamination.oracle_sql(),
        "op3_url_filter": url_filter.oracle_sql(),
        "op5_warc": warc.oracle_sql(),
        "op7_mixing": mixing.oracle_sql(),
        "op9_near_dedup": near_dedup.oracle_sql(),
    }
