"""The registered queries over the text tables, each a thin call of its operator over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamjobs.llm import (
    byte_bpe,
    conversation_repair,
    fast_sketch,
    histogram_shards,
    language_codes,
    licenses,
    metric_tree,
    periodic_runs,
    quality_ledger,
    relative_lz,
    simhash_windows,
    token_files,
    toxicity,
)
from streamjobs.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(metric_tree.TOP_SQL)
def op1_exact_top_k(spark, sf_dir):
    return metric_tree.top_inner_products(read(spark, sf_dir, "embeddings"))


@query()
def op7_minhash_near_dedup(spark, sf_dir):
    return fast_sketch.near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


@query()
def op8_substring_dedup(spark, sf_dir):
    return relative_lz.repeat_report(read(spark, sf_dir, "documents"))


def encoded_report(encoded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of what the encoder made, and its columns ``more``."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more)


@query()
def op10_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded_report(byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


@query()
def op6_token_files(spark, sf_dir):
    return token_files.token_report(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op4_language_id(spark, sf_dir):
    return language_codes.language_report(read(spark, sf_dir, "documents"))


@query(histogram_shards.SHARD_SQL)
def op3_sharding(spark, sf_dir):
    return histogram_shards.shard(read(spark, sf_dir, "documents"), shards=8)


@query(licenses.LICENSE_SQL)
def op2_license_scan(spark, sf_dir):
    return licenses.license_report(read(spark, sf_dir, "documents"), licenses.default_templates(spark))


@query()
def op5_benchmark_decontamination(spark, sf_dir):
    return simhash_windows.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.run_report(read(spark, sf_dir, "documents"))


@query(quality_ledger.QUALITY_SQL)
def op12_quality_rules(spark, sf_dir):
    return quality_ledger.quality_report(read(spark, sf_dir, "documents"))


@query(conversation_repair.REPAIR_SQL)
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_report(read(spark, sf_dir, "conversations"))
