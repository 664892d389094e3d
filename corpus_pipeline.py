"""From documents to token ids: toxic texts, near copies, repeated passages and benchmark items go, the rest is encoded.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before
it kept; all but the last return the columns of ``docs``. Between stages the documents are
written to the shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from streamjobs.llm import byte_bpe, fast_sketch, relative_lz, simhash_windows, toxicity  # noqa: E402
from streamjobs.llm.queries import encoded_report, read  # noqa: E402
from streamjobs.llm.ship import ship  # noqa: E402
from streamjobs.session import written  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5; the model learns from the labels of documents that are there."""
    ship(spark)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: five-word shingles, similarity 0.8."""
    ship(spark)
    return fast_sketch.without_near_duplicates(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without passages of 13 words or more that an earlier document has."""
    ship(spark)
    return relative_lz.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item is found."""
    ship(spark)
    return simhash_windows.without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and digests."""
    ship(spark)
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded_report(encoded, "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: Classifier, sketches and tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
