"""From produced and consumed messages to latency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.scalar import seconds_between
from streamjobs.operators.ordered import row_numbers

MESSAGE = ["prod_id", "msg_id", "topic_id"]
PACKET = ["node_id", "instance_id", "flow_id", "pkt_id"]


def last_receipts(cons: DataFrame, order: str = "line_key") -> DataFrame:
    """One receipt per consumer and message: the one logged last, whatever its time."""
    return cons.groupBy("consumer_id", *MESSAGE).agg(F.max_by("consumed_ts", order).alias("consumed_ts"))


def message_latency(prod: DataFrame, cons: DataFrame, order: str = "line_key") -> DataFrame:
    """One row per produced message, send time and consumer that got it.

    ``order`` is the column of ``cons`` that rises with the lines of a log.

    ``copies`` counts equal producer lines (same message and time). They are
    merged before the join, so repeated lines do not multiply the result;
    summaries weight by ``copies``.
    """
    sent = prod.groupBy(*MESSAGE, "produced_ts").agg(F.count(F.lit(1)).alias("copies"))
    joined = sent.join(last_receipts(cons, order), MESSAGE)
    return joined.select(*MESSAGE, "consumer_id", "produced_ts", "consumed_ts", "copies",
                         seconds_between(F.col("produced_ts"), F.col("consumed_ts")).alias("latency_s"))


def _micros() -> Column:
    return F.unix_micros("consumed_ts") - F.unix_micros("produced_ts")


def latency_summary(latency: DataFrame, by: Sequence[str] = (), threshold_s: float = 1.0) -> DataFrame:
    """Message count, mean seconds and the percentage slower than the threshold, to 2 decimals."""
    n = F.sum("copies")
    slow = F.sum(F.when(_micros() > int(threshold_s * 1e6), F.col("copies")).otherwise(0))
    return latency.groupBy(*by).agg(
        n.alias("n_messages"), (F.sum(_micros() * F.col("copies")) / n / 1e6).alias("mean_latency_s"),
        F.round(F.lit(100.0) * slow / n, 2).alias("slow_percent"))


def latency_sequence(latency: DataFrame, by: str = "consumer_id") -> DataFrame:
    """Number the messages of each consumer by send time, from 0."""
    return row_numbers(latency, [by], ["produced_ts", *[c for c in MESSAGE]], "sequence")


def _per_packet(df: DataFrame, ts: str, prefix: str) -> DataFrame:
    return df.groupBy(*PACKET).agg(F.count(ts).alias(f"{prefix}_n"),
                                   F.sum(F.unix_micros(ts).cast("decimal(38,0)")).alias(f"{prefix}_sum"))


def packet_latency(prod: DataFrame, cons: DataFrame) -> DataFrame:
    """Per packet: the number of (sent, received) pairs and their total latency in microseconds.

    Counts and time sums of each side are formed before the join. They give the
    sum over all pairs without forming the pairs, so a packet id that repeats a
    million times still is one row.
    """
    both = _per_packet(prod, "produced_ts", "p").join(_per_packet(cons, "consumed_ts", "c"), PACKET)
    total = F.col("p_n") * F.col("c_sum") - F.col("c_n") * F.col("p_sum")
    return both.select(*PACKET, (F.col("p_n") * F.col("c_n")).alias("n_pairs"), total.alias("total_us"))


def mean_packet_latency(prod: DataFrame, cons: DataFrame) -> DataFrame:
    """Mean end-to-end latency in ms over all matched packets; null without a match."""
    packets = packet_latency(prod, cons)
    return packets.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
                       F.try_divide(F.sum("total_us").cast("double"), F.sum("n_pairs") * 1000.0)
                       .alias("mean_latency_ms"))


def consumer_throughput(receipts: DataFrame) -> DataFrame:
    """Messages per second of each consumer between its first and its last line.

    ``receipts`` has ``consumer_id``, ``consumed_ts`` and the line order
    ``line_no``. A consumer whose lines share one time has no rate.
    """
    spans = receipts.groupBy("consumer_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min_by("consumed_ts", "line_no").alias("first_ts"),
        F.max_by("consumed_ts", "line_no").alias("last_ts"))
    seconds = seconds_between(F.col("first_ts"), F.col("last_ts"))
    return spans.select("consumer_id", "n_messages", seconds.alias("seconds"),
                        F.try_divide(F.col("n_messages"), seconds).alias("messages_per_s"))


def total_throughput(per_consumer: DataFrame) -> DataFrame:
    """Sum of the consumers' rates and all messages."""
    return per_consumer.agg(F.count(F.lit(1)).alias("n_consumers"), F.sum("n_messages").alias("n_messages"),
                            F.sum("messages_per_s").alias("messages_per_s"))
