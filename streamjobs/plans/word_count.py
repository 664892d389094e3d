"""Word count of a topic, and the plain copy of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from streamjobs.operators.aggregates import word_count
from streamjobs.sources.topics import Source, read_topic
from streamjobs.streaming.sinks import Sink, start


def topic_copy(spark: SparkSession, source: Source, sink: Sink, **run) -> StreamingQuery:
    return start(read_topic(spark, source), sink, "append", **run)


def running_word_count(spark: SparkSession, source: Source) -> DataFrame:
    """Counts over all messages so far; its state grows with the vocabulary."""
    return word_count(read_topic(spark, source))
