"""Run logs as typed tables.

The ``parse_*`` functions take a table of lines in ``value``, so they work on
files, on a topic and on lines made by Spark; ``read_lines`` adds where a line
stands. All parsing is one pattern match per line inside the scan's stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamjobs.functions.parsing import match_groups, matched, unpack
from streamjobs.functions.scalar import duration_seconds, log_time

# Texts that mark the lines of interest.
TIME = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) "
PRODUCED = TIME + r"INFO:Topic-name: topic-([^;]*); Message ID: ([^;]*);"
RECEIVED = TIME + r"INFO:Prod ID: ([^;]*); Message ID: ([^;]*);.*?Topic: topic-([^;]*); Offset: ([^;]*);"
STORED = "Produced message"
ANSWER = r"INFO:(Produced message|Message not produced\.) ID: ([^;]*);"
COORDINATOR = r"INFO:Group coordinator for group.*nodeId='coordinator-([^']*)'"
NODE = r"node(\d+)-instance(\d+)"
LEADING = "LEADING - LEADER ELECTION TOOK "
PACKET_FIELDS = r" (-?\d+),(-?\d+),(-?\d+),(-?\d+)"
AGGREGATE = (r" Producer Node: (\d+) user: (\d+) flow ID: (\d+) destination Port: (\d+)"
             r" total packets: (\d+) packet IDs: ([\d,]+)")
LATENCY = (r"^Producer ID: (\S+) Message ID: (\S+) Topic ID: (\S+) Consumer ID: (\S+) "
           r"Production time: (\S+ \S+) Consumtion time: (\S+ \S+) Latency of this message: ([^\n]+)")
PHASES = {"add_batch": "addBatch", "get_batch": "getBatch", "latest_offset": "latestOffset",
          "query_planning": "queryPlanning", "trigger_execution": "triggerExecution", "wal_commit": "walCommit"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the node and instance in its name, and ``line_key``.

    ``line_key`` rises with the position in the file: start of the split, then
    the row's number in its task. It is not dense; number the rows by it where
    an ordinal is needed.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("line_key"))
    return with_node(lines, "file")


def with_node(lines: DataFrame, name: str) -> DataFrame:
    """Node and instance numbers out of a file name."""
    return lines.withColumns({"node_id": F.regexp_extract(name, NODE, 1).try_cast("int"),
                              "instance_id": F.regexp_extract(name, NODE, 2).try_cast("int")})


def _rows(lines: DataFrame, pattern: str, names: Sequence[str], keep: Sequence[str] = (), **convert) -> DataFrame:
    """Rows of the lines that match, one text column per group; ``convert`` changes some of them."""
    def fields(parts: Column) -> list[Column]:
        found = [F.get(parts, F.lit(i)) for i in range(1, len(names) + 1)]
        return [convert.get(n, lambda c: c)(c).alias(n) for n, c in zip(names, found)]

    n = len(names)
    return unpack(lines, match_groups(F.col("value"), pattern, n), fields, keep, matched(n))


def _long(c: Column) -> Column:
    return c.try_cast("long")


def parse_producer(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sent messages: time, topic and message id."""
    return _rows(lines, PRODUCED, ["produced_ts", "topic_id", "msg_id"], keep, produced_ts=log_time)


def parse_confirmations(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Broker answers: 1 for a message that was stored, 0 for one that was not."""
    rows = _rows(lines, ANSWER, ["_answer", "msg_id"], keep)
    return rows.select(*keep, "msg_id", (F.col("_answer") == STORED).cast("int").alias("confirmed"))


def parse_consumer(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Received messages: time, producer, message, topic and offset."""
    return _rows(lines, RECEIVED, ["consumed_ts", "prod_id", "msg_id", "topic_id", "offset"], keep,
                 consumed_ts=log_time, offset=_long)


def parse_message_ids(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Time and the text after ``Message ID: `` of each line that has one."""
    return _rows(lines, TIME + r"INFO.*?Message ID: ([^\n]*)", ["consumed_ts", "msg_id"], keep,
                 consumed_ts=log_time, msg_id=F.trim)


def parse_coordinators(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The coordinator named last in each log."""
    return (lines.filter(F.col("value").rlike(COORDINATOR))
                 .groupBy(*by).agg(F.max_by(F.regexp_extract("value", COORDINATOR, 1), order).alias("coordinator_id")))


def parse_packets(lines: DataFrame, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """Packets out of ``Message produced: `` or ``Message received: `` lines, by ``kind``."""
    ts = {"produced": "produced_ts", "received": "consumed_ts"}[kind]
    ids = ["node_id", "instance_id", "flow_id", "pkt_id"]
    return _rows(lines, TIME + f"INFO:Message {kind}:" + PACKET_FIELDS, [ts, *ids], keep,
                 **{ts: log_time, **dict.fromkeys(ids, _long)})


def parse_aggregates(lines: DataFrame) -> DataFrame:
    """Packets out of result lines with a list of packet ids; the earliest line of each packet counts."""
    flow = ["node_id", "instance_id", "flow_id", "port_id"]
    rows = _rows(lines, TIME + "INFO:.*?" + AGGREGATE, ["consumed_ts", *flow, "total_pkts", "ids"],
                 consumed_ts=log_time, **dict.fromkeys(flow, _long))
    packets = (rows.withColumn("_id", F.explode(F.split("ids", ",")))
                   .withColumn("pkt_id", F.col("_id").try_cast("long")))
    return (packets.filter(F.col("pkt_id").isNotNull())
                   .groupBy(*flow, "pkt_id").agg(F.min("consumed_ts").alias("consumed_ts")))


def parse_progress(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Phase times in ms out of logged progress; a phase that is not named is null."""
    durations = F.regexp_extract("value", r"'durationMs': \{([^}]*)\}", 1)
    phases = F.str_to_map(F.translate(durations, "' ", ""), F.lit(","), F.lit(":"))
    rows = lines.filter(F.col("value").contains("'durationMs': "))
    return unpack(rows, phases, lambda m: [_long(F.try_element_at(m, F.lit(key))).alias(n)
                                           for n, key in PHASES.items()], keep)


def parse_leaders(lines: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The host of the first election line: the text before ``>`` without its first character."""
    host = F.substr(F.substring_index("value", ">", 1), F.lit(2))
    return (lines.filter(F.col("value").contains(LEADING))
                 .groupBy(*by).agg(F.min_by(host, order).alias("leader")))


def parse_latency(lines: DataFrame, trunc: bool = False) -> DataFrame:
    """Reported latencies back out of a latency log."""
    names = ["prod_id", "msg_id", "topic_id", "consumer_id", "produced_ts", "consumed_ts", "latency_s"]
    return _rows(lines, LATENCY, names, produced_ts=log_time, consumed_ts=log_time,
                 latency_s=lambda c: duration_seconds(c, trunc))


COUNTERS = r"(\d+):\s*rx pkts=(\d+), bytes=(\d+)[\s\S]*?tx pkts=(\d+), bytes=(\d+)"


def parse_port_counters(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Port number and the four counters out of two-line records (receive line, then send line)."""
    counters = ["rx_pkts", "rx_bytes", "tx_pkts", "tx_bytes"]
    return _rows(records, COUNTERS, ["port", *counters], keep, port=lambda c: c.try_cast("int"),
                 **dict.fromkeys(counters, _long))


def read_port_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counter dumps ``bandwidth-log<switch>.txt``.

    The record separator keeps the two lines of a port together also where a
    large file is split. ``line_key`` orders the samples of a port.
    """
    records = (spark.read.option("lineSep", "port ").text(path)
               .select("value", F.col("_metadata.file_path").alias("file"),
                       F.struct(F.col("_metadata.file_block_start").alias("block"),
                                F.monotonically_increasing_id().alias("row")).alias("line_key")))
    switch = F.regexp_extract("file", r"bandwidth-log(\d+)", 1).try_cast("int")
    return parse_port_counters(records.withColumn("switch", switch), ["switch", "line_key"])


def parse_series(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The number in front of `` us``, or the whole line when it is a number."""
    return lines.select(*keep, F.substring_index("value", " us", 1).try_cast("double").alias("reading"))


def parse_process_metrics(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``<time>, CPU: x%, Memory: y MB`` lines."""
    return _rows(lines, r"^([^,]*), CPU: ([\d.]+)%, Memory: ([\d.]+) MB", ["ts", "cpu", "mem"], keep,
                 ts=lambda c: c.try_cast("timestamp"), cpu=lambda c: c.try_cast("double"),
                 mem=lambda c: c.try_cast("double"))


def parse_integers(lines: DataFrame, name: str = "broker") -> DataFrame:
    """One whole number per line."""
    return lines.select(F.trim("value").try_cast("int").alias(name)).filter(F.col(name).isNotNull())
