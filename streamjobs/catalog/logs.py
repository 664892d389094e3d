"""Log lines made of events and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.facts import FACTS, consumer_lines, producer_lines
from streamjobs.catalog.registry import K, plain, prop_k, query, table
from streamjobs.functions.scalar import duration_seconds, format_log_time, port_spec
from streamjobs.operators import network, progress
from streamjobs.operators.latency import message_latency
from streamjobs.operators.ordered import row_numbers
from streamjobs.operators.statistics import frequency
from streamjobs.plans import reports
from streamjobs.session import fresh_path
from streamjobs.sources import logs


@query(f"WITH {FACTS} SELECT prod_id, msg_id, topic_id, produced_ts FROM prod")
def log_producer(spark, sf):
    return plain(reports.producer_entries(producer_lines(table(spark, sf, "events"))))


@query(f"WITH {FACTS} SELECT prod_id, msg_id, topic_id, produced_ts FROM prod")
def log_producer_files(spark, sf):
    """The same through text files whose names carry node and instance."""
    path = fresh_path(spark, "logs")
    lines = producer_lines(table(spark, sf, "events"))
    named = lines.select(F.concat(F.lit("prod-node"), "node_id", F.lit("-instance1")).alias("log"), "value")
    named.write.partitionBy("log").text(path)
    return plain(reports.producer_entries(logs.read_lines(spark, path)))


@query(f"""WITH {FACTS} SELECT prod_id, msg_id, CAST(CASE WHEN event_id % 20 = 3 THEN 0 ELSE 1 END AS INTEGER) AS confirmed
           FROM prod""")
def log_confirmations(spark, sf):
    return reports.confirmation_entries(producer_lines(table(spark, sf, "events")))


@query(f"""WITH {FACTS} SELECT CAST(consumer_id AS INTEGER) AS consumer_id, consumed_ts, prod_id, msg_id, topic_id,
                  event_id AS "offset" FROM recv""")
def log_consumer(spark, sf):
    return plain(reports.consumer_entries(consumer_lines(table(spark, sf, "events"))).drop("line_key"))


_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')"


@query("""SELECT user_id, 'h' || max_by(event_id, event_id) AS coordinator_id FROM events
          WHERE event_type = 'error' GROUP BY user_id""")
def log_coordinators(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.concat(
        format_log_time(F.col("ts")), F.when(F.col("event_type") == "error", F.concat(
            F.lit(" INFO:Group coordinator for group-1 is BrokerMetadata(nodeId='coordinator-h"), "event_id",
            F.lit("', host='x')"))).otherwise(" INFO:Fetch")).alias("value"))
    return logs.parse_coordinators(events, ["user_id"], "event_id")


@query("""SELECT user_id, 'h' || min(event_id) || ':2181' AS leader FROM events WHERE event_type = 'view' GROUP BY user_id""")
def log_leaders(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.concat(
        F.lit("<h"), "event_id", F.lit(":2181> "), F.when(F.col("event_type") == "view",
                                                          "LEADING - LEADER ELECTION TOOK 20 ms")
        .otherwise("FOLLOWING")).alias("value"))
    return logs.parse_leaders(events, ["user_id"], "event_id")


def packet_lines(events, kind: str, delay_ms: int = 0):
    """Lines of produced or received packets: node, instance, flow, packet and a payload."""
    when = F.timestamp_micros(F.unix_micros(F.date_trunc("millisecond", F.col("ts"))) +
                              F.lit(delay_ms * 1000) + F.col("event_id") % 700 * (1000 if delay_ms else 0))
    return events.select("event_id", F.concat(
        format_log_time(when), F.lit(f" INFO:Message {kind}: "),
        F.concat_ws(",", F.col("user_id") % 3 + 1, F.col("user_id"), F.dayofmonth("ts"), "event_id", F.lit("10.0.0.1"),
                    "event_type")).alias("value"))


_PACKET = f"""SELECT user_id % 3 + 1 AS node_id, user_id AS instance_id, CAST(day(ts) AS BIGINT) AS flow_id,
                     event_id AS pkt_id"""


@query(f"{_PACKET}, date_trunc('milliseconds', ts) AS produced_ts FROM events")
def log_packets(spark, sf):
    return plain(logs.parse_packets(packet_lines(table(spark, sf, "events"), "produced"), "produced"))


def aggregate_lines(events):
    """Result lines of flows: three overlapping id lists per packet number, at different times."""
    ids = F.concat_ws(",", F.col("event_id"), F.col("event_id") + 1, F.col("event_id") + 2)
    return events.select(F.concat(
        format_log_time(F.col("ts")), F.lit(" INFO:Message received:  Producer Node: "), F.col("user_id") % 3 + 1,
        F.lit(" user: "), F.col("user_id") % 5, F.lit(" flow ID: "), F.dayofmonth("ts"), F.lit(" destination Port: "),
        F.lit(443), F.lit(" total packets: "), F.lit(3), F.lit(" packet IDs: "), ids).alias("value"))


@query("""SELECT user_id % 3 + 1 AS node_id, user_id % 5 AS instance_id, CAST(day(ts) AS BIGINT) AS flow_id,
                 CAST(443 AS BIGINT) AS port_id, event_id + d AS pkt_id, min(date_trunc('milliseconds', ts)) AS consumed_ts
          FROM events, (SELECT unnest([0, 1, 2]) AS d) GROUP BY ALL""")
def log_aggregates(spark, sf):
    return plain(logs.parse_aggregates(aggregate_lines(table(spark, sf, "events"))))


def progress_lines(events):
    """Progress of one query per user; three in four records planned a query."""
    k = prop_k()
    planned = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("'queryPlanning': "), k + 1, F.lit(", "))).otherwise("")
    return events.select(F.col("user_id").alias("query"), F.col("event_id").alias("batch_id"), F.concat(
        F.lit("2024-01-01 00:00:00,000 INFO:{'id': 'x', 'durationMs': {'addBatch': "), k * 3, F.lit(", 'getBatch': "), k % 5,
        F.lit(", 'latestOffset': "), k % 7, F.lit(", "), planned, F.lit("'triggerExecution': "), k * 5 + 100,
        F.lit(", 'walCommit': "), k % 11, F.lit("}, 'stateOperators': []}")).alias("value"))


_PROGRESS = f"""p AS (SELECT user_id AS query, event_id AS batch_id, CAST({K} * 3 AS BIGINT) AS add_batch,
       CAST({K} % 5 AS BIGINT) AS get_batch, CAST({K} % 7 AS BIGINT) AS latest_offset,
       CASE WHEN event_id % 4 <> 0 THEN CAST({K} + 1 AS BIGINT) END AS query_planning,
       CAST({K} * 5 + 100 AS BIGINT) AS trigger_execution, CAST({K} % 11 AS BIGINT) AS wal_commit FROM events)"""


@query(f"WITH {_PROGRESS} SELECT * FROM p")
def log_progress(spark, sf):
    return logs.parse_progress(progress_lines(table(spark, sf, "events")), ["query", "batch_id"])


@query(f"""WITH {_PROGRESS} SELECT query, count(*) AS n_triggers,
             CAST(sum(trigger_execution) - min_by(trigger_execution, batch_id) AS DOUBLE) / count(*) AS steady_ms_all,
             CASE WHEN count(*) > 1 THEN CAST(sum(trigger_execution) - min_by(trigger_execution, batch_id) AS DOUBLE)
                  / (count(*) - 1) END AS steady_ms
           FROM p GROUP BY query""")
def trigger_stats(spark, sf):
    return reports.trigger_report(progress_lines(table(spark, sf, "events")), ["query"], "batch_id")


@query(f"""WITH {_PROGRESS}, e AS (SELECT *, trigger_execution - wal_commit AS x,
               add_batch + get_batch + latest_offset + query_planning + trigger_execution + wal_commit AS total
               FROM p WHERE query_planning IS NOT NULL)
           SELECT query, count(*) AS n_triggers,
             CASE WHEN count(*) > 1 THEN CAST(sum(x) - min_by(x, batch_id) AS DOUBLE) / (count(*) - 1) END AS steady_exec_ms,
             CAST(sum(total) AS BIGINT) AS phases_ms FROM e GROUP BY query""")
def planning_stats(spark, sf):
    records = logs.parse_progress(progress_lines(table(spark, sf, "events")), ["query", "batch_id"])
    return progress.planning_stats(records, ["query"])


def counter_records(events):
    """Two-line counter records of three ports per switch."""
    k = prop_k()
    return events.select("event_id", (F.col("user_id") % 4 + 1).cast("int").alias("switch"), F.concat(
        F.lit("  port  "), F.col("user_id") % 3 + 1, F.lit(": rx pkts="), F.col("event_id") * 2, F.lit(", bytes="),
        F.col("event_id") * 100 + k, F.lit(", drop=0, errs=0, frame=0, over=0, crc=0\n           tx pkts="),
        F.col("event_id") * 3, F.lit(", bytes="), F.col("event_id") * 50 + k,
        F.lit(", drop=0, errs=0, coll=0\n")).alias("value"))


@query(f"""SELECT event_id, CAST(user_id % 4 + 1 AS INTEGER) AS switch, CAST(user_id % 3 + 1 AS INTEGER) AS port,
                  event_id * 2 AS rx_pkts, event_id * 100 + {K} AS rx_bytes, event_id * 3 AS tx_pkts,
                  event_id * 50 + {K} AS tx_bytes FROM events""")
def log_port_counters(spark, sf):
    return logs.parse_port_counters(counter_records(table(spark, sf, "events")), ["event_id", "switch"])


@query(f"""SELECT CAST(user_id % 4 + 1 AS INTEGER) AS switch, CAST(user_id % 3 + 1 AS INTEGER) AS port,
                  event_id * 2 AS rx_pkts, event_id * 100 + {K} AS rx_bytes, event_id * 3 AS tx_pkts,
                  event_id * 50 + {K} AS tx_bytes FROM events""")
def log_port_counter_files(spark, sf):
    """Through dump files named after the switch."""
    path = fresh_path(spark, "dumps")
    records = counter_records(table(spark, sf, "events"))
    named = records.select(F.concat(F.lit("bandwidth-log"), "switch").alias("dump"), "value")
    named.write.partitionBy("dump").text(path)
    return logs.read_port_counters(spark, path).drop("line_key")


@query("""SELECT event_id, ts, value AS cpu, CAST(user_id AS DOUBLE) + 0.5 AS mem FROM events""")
def log_process_metrics(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(", CPU: "), "value", F.lit("%, Memory: "),
        F.col("user_id") + F.lit(0.5), F.lit(" MB")).alias("value"))
    return plain(logs.parse_process_metrics(lines, ["event_id"]))


@query("""SELECT user_id, round(avg(value), 9) AS avg_cpu, avg(CAST(user_id AS DOUBLE)) + 0.5 AS avg_mem
          FROM events GROUP BY user_id""")
def resource_usage(spark, sf):
    lines = table(spark, sf, "events").select("user_id", F.concat(
        F.lit("2024-01-01 00:00:00, CPU: "), "value", F.lit("%, Memory: "), F.col("user_id") + F.lit(0.5),
        F.lit(" MB")).alias("value"))
    means = network.mean_resources(logs.parse_process_metrics(lines, ["user_id"]), ["user_id"])
    return means.withColumn("avg_cpu", F.round("avg_cpu", 9))


@query("""SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) * CAST(0.5 AS DOUBLE) AS time_s, value AS reading
          FROM events""")
def resource_series(spark, sf):
    lines = table(spark, sf, "events").select("user_id", "event_id", F.concat("value", F.lit(" us")).alias("value"))
    numbered = network.sample_numbers(lines, ["user_id"], ["event_id"], 0.5, start=1)
    return logs.parse_series(numbered, ["user_id", "time_s"])


@query("""SELECT user_id % 20 AS series, (row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id)) * CAST(0.5 AS DOUBLE) AS time_s,
             value AS reading FROM events""")
def resource_series_files(spark, sf):
    """A file of readings per series, numbered by the splits of the files."""
    path = fresh_path(spark, "series")
    lines = table(spark, sf, "events").select((F.col("user_id") % 20).alias("series"), "event_id", F.concat("value", F.lit(" us")).alias("value"))
    in_order = lines.repartition("series").sortWithinPartitions("series", "event_id").drop("event_id")
    in_order.write.partitionBy("series").text(path)
    found = reports.resource_series(spark, path)
    return found.select(F.regexp_extract("file", r"series=(\d+)", 1).cast("long").alias("series"), "time_s", "reading")


@query(f"""WITH {FACTS} SELECT prod_id, msg_id, topic_id, CAST(consumer_id AS VARCHAR) AS consumer_id, produced_ts,
                  consumed_ts, latency_s FROM lat""")
def log_latency(spark, sf):
    """Latency report written as text lines and read back."""
    events = table(spark, sf, "events")
    rows = message_latency(reports.producer_entries(producer_lines(events)),
                           reports.consumer_entries(consumer_lines(events)))
    return plain(logs.parse_latency(reports.latency_lines(rows)))


@query(f"""SELECT event_id, CAST((event_id * 37) % 100000 AS DOUBLE) + {K} / 100.0 AS exact_s,
                  CAST((event_id * 37) % 100000 AS DOUBLE) AS whole_s FROM events""")
def duration_text(spark, sf):
    seconds = F.col("event_id") * 37 % 100000
    text = F.concat(F.when(seconds >= 86400, "1 day, ").otherwise(""), F.floor(seconds % 86400 / 3600), F.lit(":"),
                    F.lpad(F.floor(seconds % 3600 / 60), 2, "0"), F.lit(":"), F.lpad(seconds % 60, 2, "0"), F.lit("."),
                    F.lpad(prop_k(), 2, "0"))
    return table(spark, sf, "events").select("event_id", duration_seconds(text).alias("exact_s"),
                                             duration_seconds(text, trunc=True).alias("whole_s"))


@query("""SELECT CAST(user_id % 12 AS INTEGER) AS broker, count(*) AS frequency FROM events GROUP BY 1""")
def leader_frequency(spark, sf):
    lines = table(spark, sf, "events").select((F.col("user_id") % 12).cast("string").alias("value"))
    return frequency(logs.parse_integers(lines), "broker")


@query("""SELECT event_id, CAST(user_id % 4 AS INTEGER) AS switch, CAST(user_id % 15 AS INTEGER) AS port FROM events""")
def port_specs(spark, sf):
    spec = F.concat(F.lit("S"), F.col("user_id") % 4, F.lit("-P"), F.col("user_id") % 15)
    switch, port = port_spec(spec)
    return table(spark, sf, "events").select("event_id", switch.alias("switch"), port.alias("port"))


@query(f"""WITH {FACTS} SELECT CAST(consumer_id AS INTEGER) AS consumer_id, msg_id, consumed_ts,
             row_number() OVER (PARTITION BY consumer_id ORDER BY consumed_ts, msg_id) - 1 AS line_no FROM recv""")
def log_message_ids(spark, sf):
    """Message ids of each consumer with their place in its log."""
    lines = consumer_lines(table(spark, sf, "events"))
    short = lines.select(F.col("node_id").alias("consumer_id"), F.concat(
        F.regexp_extract("value", r"^(\S+ \S+) ", 1), F.lit(" INFO:Message ID: "),
        F.regexp_extract("value", r"Message ID: (\d+)", 1)).alias("value"))
    ids = logs.parse_message_ids(short, ["consumer_id"])
    return plain(row_numbers(ids, ["consumer_id"], ["consumed_ts", "msg_id"], "line_no"))
