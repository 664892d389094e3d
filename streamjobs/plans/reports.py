"""Reports over the logs of a run: latency, delivery, bandwidth, resources, triggers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamjobs.functions.scalar import format_log_time, zero_pad
from streamjobs.operators import delivery, latency, network, progress
from streamjobs.sources import logs


def producer_entries(lines: DataFrame) -> DataFrame:
    """Sent messages of all producers; the producer id is the node, two digits."""
    return logs.parse_producer(lines, ["node_id"]).withColumn("prod_id", zero_pad(F.col("node_id"), 2)).drop("node_id")


def consumer_entries(lines: DataFrame) -> DataFrame:
    """Receipts of all consumers, with ``line_key`` where the lines have it; consumers count from 1."""
    keep = [c for c in ("node_id", "line_key") if c in lines.columns]
    return logs.parse_consumer(lines, keep).withColumnRenamed("node_id", "consumer_id")


def confirmation_entries(lines: DataFrame) -> DataFrame:
    return (logs.parse_confirmations(lines, ["node_id"])
                .withColumn("prod_id", zero_pad(F.col("node_id"), 2)).drop("node_id"))


def message_latency(spark: SparkSession, producer_logs: str, consumer_logs: str) -> DataFrame:
    return latency.message_latency(producer_entries(logs.read_lines(spark, producer_logs)),
                                   consumer_entries(logs.read_lines(spark, consumer_logs)))


def latency_lines(rows: DataFrame) -> DataFrame:
    """Latencies as log lines, the duration as ``H:MM:SS.ffffff``."""
    us = F.unix_micros("consumed_ts") - F.unix_micros("produced_ts")
    size = F.abs(us)
    text = F.concat(F.when(us < 0, F.lit("-")).otherwise(F.lit("")),
                    F.floor(size / 3_600_000_000).cast("string"), F.lit(":"),
                    F.lpad(F.floor(size / 60_000_000 % 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(F.floor(size / 1_000_000 % 60).cast("string"), 2, "0"), F.lit("."),
                    F.lpad((size % 1_000_000).cast("string"), 6, "0"))
    return rows.select("consumer_id", F.concat(
        F.lit("Producer ID: "), "prod_id", F.lit(" Message ID: "), "msg_id", F.lit(" Topic ID: "), "topic_id",
        F.lit(" Consumer ID: "), F.col("consumer_id").cast("string"), F.lit(" Production time: "),
        format_log_time(F.col("produced_ts")), F.lit(" Consumtion time: "), format_log_time(F.col("consumed_ts")),
        F.lit(" Latency of this message: "), text).alias("value"))


def packet_latency(produced: DataFrame, consumed: DataFrame, aggregated: bool = False) -> DataFrame:
    """Mean packet latency from producer lines and either received packets or aggregate results."""
    sent = logs.parse_packets(produced, "produced")
    got = logs.parse_aggregates(consumed) if aggregated else logs.parse_packets(consumed, "received")
    return latency.mean_packet_latency(sent, got)


def delivery_report(producer_lines: DataFrame, consumer_lines: DataFrame, consumers: DataFrame) -> DataFrame:
    """Words of delivered messages from the two kinds of log; ``consumers`` has ``consumer_id``."""
    return delivery.delivery_words(producer_entries(producer_lines), consumer_entries(consumer_lines), consumers,
                                   confirmation_entries(producer_lines))


def bandwidth(counters: DataFrame, counter: str, order: Sequence[str] = ("sample",),
              seconds: float = network.SAMPLE_SECONDS) -> DataFrame:
    """Rate series of each port."""
    return network.counter_rate(counters, ["switch", "port"], order, counter, seconds)


def bandwidth_report(spark: SparkSession, path: str, counter: str = "rx_bytes") -> DataFrame:
    """Rates of all ports out of counter dumps, numbered by their order in the file."""
    counters = logs.read_port_counters(spark, path)
    numbered = network.sample_numbers(counters, ["switch", "port"], ["line_key"])
    return bandwidth(numbered, counter)


def resource_series(spark: SparkSession, path: str, hz: float = 2.0) -> DataFrame:
    """One reading per line of each file, with its time in seconds."""
    lines = logs.read_lines(spark, path)
    numbered = network.sample_numbers(lines, ["file"], ["line_key"], 1.0 / hz, start=1)
    return logs.parse_series(numbered, ["file", "time_s"])


def trigger_report(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    records = logs.parse_progress(lines, [*by, order])
    return progress.trigger_stats(records, by, order)
