"""Synthetic messages. Each is computed from the key of an input row, so the amount
grows with the input and a repeated task makes the same messages."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamjobs.functions.randoms import hash_int, hash_normal, hash_poisson, hash_text
from streamjobs.functions.scalar import zero_pad
from streamjobs.operators.ordered import running_totals

# Fixed values of a generated packet.
SOURCE_IP = "192.168.1.11"
TARGET_IP = "20.198.162.76"
TARGET_PORTS = ["20", "443", "25", "53"]
PROTOCOL = "6"
SOURCE_PORTS = (49152, 65535)
MAX_PACKETS = 200
MAX_PAYLOAD = 1500
FLOW_GAP_SECONDS = 120.0
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits


def message_size(seed: int, key: Column, fixed: int | None = None,
                 gaussian: tuple[float, float] | None = None) -> Column:
    """A fixed size, or one drawn from (mean, deviation), cut to a whole number of at least 1."""
    if (fixed is None) == (gaussian is None):
        raise ValueError("give either a fixed size or a gaussian one")
    if fixed is not None:
        return F.lit(fixed)
    drawn = hash_normal(*gaussian, seed, key)
    return F.greatest(drawn.cast("int"), F.lit(1))


def fixed_messages(df: DataFrame, node: str, sequence: str, size: Column) -> DataFrame:
    """Fixed-width messages: node id, message number, and a payload of ``size - 4`` letters."""
    payload = F.repeat(F.lit("a"), F.greatest(size - 4, F.lit(0)).cast("int"))
    return df.withColumn("value", F.concat(zero_pad(F.col(node), 2), zero_pad(F.col(sequence), 6), payload))


def xml_messages(df: DataFrame, key: str, seed: int, per_line: bool = False, text: str = "value") -> DataFrame:
    """Replace every run of digits by a random number 1..999: one number per message, or one per line."""
    if not per_line:
        number = hash_int(1, 999, seed, F.col(key)).cast("string")
        return df.withColumn(text, F.regexp_replace(F.col(text), F.lit("[0-9]+"), number))

    def line(t: Column, i: Column) -> Column:
        return F.regexp_replace(t, F.lit("[0-9]+"), hash_int(1, 999, seed, F.col(key), i).cast("string"))

    lines = F.transform(F.split(F.col(text), "\n"), line)
    return df.withColumn(text, F.array_join(lines, "\n"))


def random_topic(df: DataFrame, key: str, n_topics: int, seed: int) -> DataFrame:
    """Add ``topic``, one of ``topic-0`` .. ``topic-<n-1>`` with equal chance."""
    return df.withColumn("topic", F.concat(F.lit("topic-"), hash_int(0, n_topics - 1, seed, F.col(key)).cast("string")))


def packet_flows(flows: DataFrame, seed: int, node: str = "node_id", instance: str = "instance_id",
                 flow: str = "flow_id") -> DataFrame:
    """0..200 packets for each flow, as columns and as the CSV message ``value``.

    A flow of a few bytes makes up to 300 kB, so the flows are dealt to tasks by key and by a
    fixed number: one file of flows is one task's input, and small parts would be joined again.
    """
    who = [F.col(node), F.col(instance), F.col(flow)]
    n_parts = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = flows.repartition(n_parts, *who).withColumn("_n", hash_int(0, MAX_PACKETS, f"{seed}n", *who))
    packets = counted.filter("_n > 0").withColumn("pkt_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    keys = [*who, F.col("pkt_id")]
    port = F.get(F.lit(TARGET_PORTS), hash_int(0, len(TARGET_PORTS) - 1, f"{seed}d", *keys).cast("int"))
    sized = (packets.withColumn("src_port", hash_int(*SOURCE_PORTS, f"{seed}s", *keys))
                    .withColumn("dst_port", port)
                    .withColumn("payload_length", hash_int(1, MAX_PAYLOAD, f"{seed}l", *keys))
                    .withColumn("payload", hash_text(F.col("payload_length"), ALPHABET, f"{seed}p", *keys)))
    parts = [*who, F.col("pkt_id"), F.lit(SOURCE_IP), F.lit(TARGET_IP), F.lit(PROTOCOL), F.col("src_port"),
             F.col("dst_port"), F.col("payload_length"), F.col("payload")]
    return sized.drop("_n").withColumn("value", F.concat_ws(",", *[p.cast("string") for p in parts]))


def flow_starts(flows: DataFrame, seed: int, node: str = "node_id", instance: str = "instance_id",
                flow: str = "flow_id") -> DataFrame:
    """Add ``gap_s``, the pause after a flow, and ``start_s``, the time at which it begins."""
    gap = hash_poisson(FLOW_GAP_SECONDS, f"{seed}g", F.col(node), F.col(instance), F.col(flow))
    total = running_totals(flows.withColumn("gap_s", gap), [node, instance], [flow], "gap_s", "_total")
    return total.withColumn("start_s", F.col("_total") - F.col("gap_s")).drop("_total")


def rate_messages(spark: SparkSession, per_second: int, node: int, size: int) -> DataFrame:
    """An endless stream of fixed-width messages at a given rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    named = ticks.withColumn("node", F.lit(node))
    return fixed_messages(named, "node", "value", F.lit(size)).select("timestamp", "value")
