"""Log lines of a message run, made of events, and the same facts in SQL.

Every event is a message: the producer node is ``user_id % 10 + 1``, the topic
the event type. Four consumers get it with a delay between 5 and 2504 ms, except
about a tenth of the (message, consumer) pairs; every 50th message is received
twice, and of these every other one has the later receipt logged first; every 20th
is not confirmed by the broker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.scalar import format_log_time, zero_pad

N_CONSUMERS = 4
CONSUMERS = [1, 2, 3, 4]
TYPES = ["click", "error", "purchase", "signup", "view"]


def _node():
    return (F.col("user_id") % 10 + 1).cast("int")


def _topic():
    return F.array_position(F.lit(TYPES), F.col("event_type")) - 1


def producer_lines(events: DataFrame) -> DataFrame:
    """Two lines per message: sent, and the broker's answer."""
    sent = F.concat(format_log_time(F.col("ts")), F.lit(" INFO:Topic-name: topic-"), _topic(), F.lit("; Message ID: "),
                    zero_pad(F.col("event_id"), 6), F.lit("; Message: "), "props")
    answered = F.when(F.col("event_id") % 20 == 3, F.concat(
        format_log_time(F.col("ts")), F.lit(" INFO:Message not produced. ID: "), zero_pad(F.col("event_id"), 6),
        F.lit("; Error: timed out"))).otherwise(F.concat(
            format_log_time(F.col("ts")), F.lit(" INFO:Produced message ID: "), zero_pad(F.col("event_id"), 6),
            F.lit("; Value: stored")))
    return events.select(_node().alias("node_id"), F.explode(F.array(sent, answered)).alias("value"))


def consumer_lines(events: DataFrame) -> DataFrame:
    """One line per receipt, in the order of ``line_key``."""
    got = (events.withColumn("node_id", F.explode(F.lit(CONSUMERS)))
                 .filter((F.col("event_id") * 31 + F.col("node_id") * 17) % 10 != 0))
    delay = (F.col("event_id") * 7919 + F.col("node_id") * 104729) % 2500 + 5
    repeats = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1000))).otherwise(F.array(F.lit(0)))
    got = got.withColumn("_extra", F.explode(repeats))
    sent = F.date_trunc("millisecond", F.col("ts"))
    when = F.timestamp_micros(F.unix_micros(sent) + (delay + F.col("_extra")) * 1000)
    line = F.concat(format_log_time(when), F.lit(" INFO:Prod ID: "), zero_pad(_node(), 2), F.lit("; Message ID: "),
                    zero_pad(F.col("event_id"), 6), F.lit("; Latest: True; Topic: topic-"), _topic(),
                    F.lit("; Offset: "), F.col("event_id"), F.lit("; Size: "), F.length("props") + 8)
    swapped = (F.col("_extra") > 0) != (F.col("event_id") % 100 == 0)
    key = F.col("event_id") * 2 + swapped.cast("long")
    return got.select("node_id", key.alias("line_key"), line.alias("value"))


FACTS = """prod AS (SELECT event_id, CAST(user_id % 10 + 1 AS INTEGER) AS node, printf('%02d', user_id % 10 + 1) AS prod_id,
            printf('%06d', event_id) AS msg_id,
            CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS VARCHAR) AS topic_id,
            date_trunc('milliseconds', ts) AS produced_ts FROM events),
   recv AS (SELECT prod.*, c AS consumer_id, produced_ts + to_microseconds(1000 * ((event_id * 7919 + c * 104729) % 2500 + 5 + x))
                   AS consumed_ts, event_id * 2 + CAST((x > 0) <> (event_id % 100 = 0) AS INTEGER) AS line_key
            FROM prod, (SELECT unnest([1, 2, 3, 4]) AS c), (SELECT unnest([0, 1000]) AS x)
            WHERE (event_id * 31 + c * 17) % 10 <> 0 AND (x = 0 OR event_id % 50 = 0)),
   lat AS (SELECT event_id, prod_id, msg_id, topic_id, CAST(consumer_id AS INTEGER) AS consumer_id, produced_ts,
                  arg_max(consumed_ts, line_key) AS consumed_ts, (epoch_us(arg_max(consumed_ts, line_key)) - epoch_us(produced_ts)) / 1e6 AS latency_s
           FROM recv GROUP BY event_id, prod_id, msg_id, topic_id, recv.consumer_id, produced_ts)"""
