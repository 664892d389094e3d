"""Latency, delivery and throughput over the logged run."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.facts import FACTS, consumer_lines, producer_lines
from streamjobs.catalog.logs import aggregate_lines, packet_lines
from streamjobs.catalog.registry import plain, query, rounded, table
from streamjobs.operators import delivery, latency, statistics
from streamjobs.plans import reports
from streamjobs.session import fresh_path, written
from streamjobs.sources import logs
from streamjobs.streaming.sinks import write_partitioned


def _parts(spark, sf):
    events = table(spark, sf, "events")
    return (reports.producer_entries(producer_lines(events)), reports.consumer_entries(consumer_lines(events)))


def _once(spark, sf):
    """The latency table, for a report that reads it once."""
    return latency.message_latency(*_parts(spark, sf))


def _latency(spark, sf):
    """The latency table, written for a report that reads it several times."""
    return written(_once(spark, sf), "latency")


def _states(spark, sf, confirmed: bool = True):
    events = table(spark, sf, "events")
    prod, cons = _parts(spark, sf)
    return delivery.delivery_words(prod, cons, cons.select("consumer_id"),
                                   reports.confirmation_entries(producer_lines(events)) if confirmed else None)


@query(f"""WITH {FACTS} SELECT prod_id, msg_id, topic_id, consumer_id, produced_ts, consumed_ts, CAST(1 AS BIGINT) AS copies,
             latency_s FROM lat""")
def message_latency(spark, sf):
    return plain(latency.message_latency(*_parts(spark, sf)))


_SUMMARY = """count(*) AS n_messages, CAST(sum(epoch_us(consumed_ts) - epoch_us(produced_ts)) AS DOUBLE) / count(*) / 1e6
              AS mean_latency_s, round(100.0 * count(*) FILTER (latency_s > 1) / count(*), 2) AS slow_percent"""


@query(f"WITH {FACTS} SELECT consumer_id, {_SUMMARY} FROM lat GROUP BY consumer_id")
def latency_summary(spark, sf):
    return latency.latency_summary(_once(spark, sf), ["consumer_id"])


@query(f"WITH {FACTS} SELECT {_SUMMARY} FROM lat")
def slow_share(spark, sf):
    return latency.latency_summary(_once(spark, sf))


@query(f"""WITH {FACTS} SELECT consumer_id, msg_id, latency_s, row_number() OVER (PARTITION BY consumer_id
             ORDER BY produced_ts, prod_id, msg_id, topic_id) - 1 AS sequence FROM lat""")
def latency_sequence(spark, sf):
    return latency.latency_sequence(_once(spark, sf)).select("consumer_id", "msg_id", "latency_s", "sequence")


@query(f"""WITH {FACTS} SELECT topic_id, msg_id, consumer_id, row_number() OVER (PARTITION BY topic_id
             ORDER BY produced_ts, prod_id, msg_id, consumer_id) - 1 AS sequence FROM lat""")
def latency_sequence_by_topic(spark, sf):
    from streamjobs.operators.ordered import row_numbers
    numbered = row_numbers(_once(spark, sf), ["topic_id"], ["produced_ts", "prod_id", "msg_id", "consumer_id"], "sequence")
    return numbered.select("topic_id", "msg_id", "consumer_id", "sequence")


@query(f"""WITH {FACTS}, b AS (SELECT min(latency_s) AS lo, max(latency_s) AS hi, count(*) AS n FROM lat),
   c AS (SELECT least(floor((latency_s - lo) * 28 / (hi - lo)) + 1, 28) AS bin, count(*) AS k FROM lat, b GROUP BY 1),
   g AS (SELECT i AS bin, coalesce(k, 0) AS k, lo, hi, n FROM range(1, 29) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = i)
   SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * (hi - lo) / 28, 9) AS low, round(lo + bin * (hi - lo) / 28, 9) AS high,
          k AS n_rows, round(k / (n * (hi - lo) / 28), 9) AS density,
          round(CAST(sum(k) OVER (ORDER BY bin) AS DOUBLE) / n, 9) AS share FROM g""")
def latency_hist(spark, sf):
    return rounded(statistics.histogram(_latency(spark, sf), "latency_s"), 9, "low", "high", "density", "share")


@query(f"""WITH {FACTS}, c AS (SELECT latency_s, count(*) AS n_rows FROM lat GROUP BY 1)
   SELECT latency_s, n_rows, CAST(sum(n_rows) OVER (ORDER BY latency_s) AS DOUBLE) / sum(n_rows) OVER () AS share FROM c""")
def latency_cdf(spark, sf):
    return statistics.cdf(_once(spark, sf), "latency_s")


@query(f"""WITH {FACTS}, c AS (SELECT consumer_id, latency_s, count(*) AS n_rows FROM lat GROUP BY 1, 2)
   SELECT consumer_id, latency_s, n_rows, CAST(sum(n_rows) OVER (PARTITION BY consumer_id ORDER BY latency_s) AS DOUBLE)
          / sum(n_rows) OVER (PARTITION BY consumer_id) AS share FROM c""")
def latency_cdf_by_consumer(spark, sf):
    return statistics.cdf(_once(spark, sf), "latency_s", ["consumer_id"])


@query(f"""WITH {FACTS}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, min(latency_s) AS lo, max(latency_s) AS hi,
                stddev_samp(latency_s) * pow(count(*), -0.2) AS h FROM lat),
   v AS (SELECT latency_s AS v, count(*) AS k FROM lat GROUP BY 1),
   d AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 49 AS x,
                sum(k * exp(-0.5 * pow((lo + (hi - lo) * i / 49 - v) / h, 2)) / (h * sqrt(2 * pi()))) / max(n) AS density
         FROM v, s, range(50) r(i) GROUP BY i, lo, hi)
   SELECT point, round(x, 6) AS x, round(density, 6) AS density,
          round(sum(density) OVER (ORDER BY point) / sum(density) OVER (), 6) AS share FROM d""")
def latency_kde(spark, sf):
    return rounded(statistics.kde(_latency(spark, sf), "latency_s", 50, cumulative=True), 6, "x", "density", "share")


@query(f"""WITH {FACTS}, q AS (SELECT topic_id, count(*) AS n_rows, quantile_cont(latency_s, 0.25) AS q1,
                quantile_cont(latency_s, 0.5) AS median, quantile_cont(latency_s, 0.75) AS q3 FROM lat GROUP BY 1)
   SELECT topic_id, n_rows, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          min(latency_s) FILTER (latency_s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(latency_s) FILTER (latency_s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (NOT latency_s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
   FROM lat JOIN q USING (topic_id) GROUP BY ALL""")
def latency_box(spark, sf):
    return rounded(statistics.box_stats(_latency(spark, sf), "latency_s", ["topic_id"]), 6, "q1", "median", "q3")


@query("""WITH q AS (SELECT event_type, count(*) AS n_rows, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
   SELECT event_type, n_rows, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
   FROM events JOIN q USING (event_type) GROUP BY ALL""")
def value_box(spark, sf):
    return rounded(statistics.box_stats(table(spark, sf, "events"), "value", ["event_type"]), 6, "q1", "median", "q3")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
   SELECT event_type, value, count(*) AS n_rows FROM events JOIN q USING (event_type)
   WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def value_outliers(spark, sf):
    return statistics.outliers(table(spark, sf, "events"), "value", ["event_type"])


@query("""SELECT count(*) AS n_pairs, CAST(sum(700 + event_id % 700) AS DOUBLE) / count(*) AS mean_latency_ms FROM events""")
def packet_latency(spark, sf):
    events = table(spark, sf, "events")
    mean = reports.packet_latency(packet_lines(events, "produced"), packet_lines(events, "received", 700))
    return rounded(mean, 9, "mean_latency_ms").withColumn("n_pairs", F.col("n_pairs").cast("long"))


@query("""WITH p AS (SELECT user_id % 3 + 1 AS a, user_id AS b, day(ts) AS c, event_id AS e, date_trunc('milliseconds', ts) AS t
                     FROM events),
     g AS (SELECT user_id % 3 + 1 AS a, user_id % 5 AS b, day(ts) AS c, event_id + d AS e,
                  min(date_trunc('milliseconds', ts)) AS t
           FROM events, (SELECT unnest([0, 1, 2]) AS d) GROUP BY ALL)
   SELECT count(*) AS n_pairs, round(CAST(sum(epoch_us(g.t) - epoch_us(p.t)) AS DOUBLE) / (count(*) * 1000.0), 6) AS mean_latency_ms
   FROM p JOIN g USING (a, b, c, e)""")
def packet_latency_aggregated(spark, sf):
    events = table(spark, sf, "events")
    mean = reports.packet_latency(packet_lines(events, "produced"), aggregate_lines(events), aggregated=True)
    return rounded(mean, 6, "mean_latency_ms").withColumn("n_pairs", F.col("n_pairs").cast("long"))


@query("""WITH o AS (SELECT o_orderkey AS k, count(*) AS n, sum(epoch_us(o_orderdate)) AS s FROM orders GROUP BY 1),
     l AS (SELECT l_orderkey AS k, count(*) AS n, sum(epoch_us(l_shipdate)) AS s FROM lineitem GROUP BY 1)
   SELECT CAST(sum(o.n * l.n) AS BIGINT) AS n_pairs,
          round(CAST(sum(o.n * l.s - l.n * o.s) AS DOUBLE) / (sum(o.n * l.n) * 1000.0), 3) AS mean_latency_ms
   FROM o JOIN l USING (k)""")
def order_latency(spark, sf):
    """Order to shipment, with the order as the packet: many receipts per packet."""
    def packets(df, key, ts, name):
        zero = F.lit(0).cast("long")
        return df.select(zero.alias("node_id"), zero.alias("instance_id"), zero.alias("flow_id"),
                         F.col(key).alias("pkt_id"), F.col(ts).alias(name))

    mean = latency.mean_packet_latency(packets(table(spark, sf, "orders"), "o_orderkey", "o_orderdate", "produced_ts"),
                                       packets(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate", "consumed_ts"))
    return rounded(mean, 3, "mean_latency_ms").withColumn("n_pairs", F.col("n_pairs").cast("long"))


_RATE = f"""WITH {FACTS}, s AS (SELECT CAST(consumer_id AS INTEGER) AS consumer_id, count(*) AS n_messages,
      (epoch_us(max_by(consumed_ts, (consumed_ts, event_id))) - epoch_us(min_by(consumed_ts, (consumed_ts, event_id)))) / 1e6
      AS seconds FROM recv GROUP BY 1)"""


@query(f"{_RATE} SELECT *, n_messages / seconds AS messages_per_s FROM s")
def consumer_throughput(spark, sf):
    _, cons = _parts(spark, sf)
    return latency.consumer_throughput(cons.withColumn("line_no", F.struct("consumed_ts", "offset")))


@query(f"""{_RATE} SELECT count(*) AS n_consumers, CAST(sum(n_messages) AS BIGINT) AS n_messages,
             round(sum(n_messages / seconds), 9) AS messages_per_s FROM s""")
def total_throughput(spark, sf):
    _, cons = _parts(spark, sf)
    rates = latency.consumer_throughput(cons.withColumn("line_no", F.struct("consumed_ts", "offset")))
    total = latency.total_throughput(rates)
    return rounded(total, 9, "messages_per_s")


_CELLS = f"""WITH {FACTS}, cell AS (SELECT prod.*, CAST(c AS INTEGER) AS consumer_id,
       EXISTS (SELECT 1 FROM lat WHERE lat.event_id = prod.event_id AND lat.consumer_id = c) AS got,
       event_id % 20 = 3 AS unconfirmed FROM prod, (SELECT unnest([1, 2, 3, 4]) AS c))"""


@query(f"""{_CELLS} SELECT prod_id, msg_id, topic_id, consumer_id,
             CAST(CASE WHEN got OR unconfirmed THEN 255 ELSE 51 * topic_id::INTEGER END AS INTEGER) AS cell FROM cell""")
def delivery_matrix(spark, sf):
    return delivery.delivery_matrix(_states(spark, sf), 5)


@query(f"""{_CELLS} SELECT topic_id, consumer_id, count(*) AS n_sent, count(*) FILTER (got) AS n_received,
             count(*) FILTER (NOT got AND NOT unconfirmed) AS n_missing, count(*) FILTER (unconfirmed) AS n_unconfirmed
           FROM cell GROUP BY 1, 2""")
def delivery_counts(spark, sf):
    return delivery.delivery_counts(_states(spark, sf))


@query(f"{_CELLS} SELECT prod_id, msg_id, topic_id, consumer_id FROM cell WHERE NOT got AND NOT unconfirmed")
def undelivered(spark, sf):
    return delivery.undelivered(_states(spark, sf))


@query(f"{_CELLS} SELECT prod_id, msg_id, topic_id, consumer_id FROM cell WHERE NOT got")
def undelivered_unchecked(spark, sf):
    return delivery.undelivered(_states(spark, sf, confirmed=False))


@query(f"{_CELLS} SELECT prod_id, msg_id, topic_id, consumer_id FROM cell WHERE got AND unconfirmed")
def unconfirmed_received(spark, sf):
    return delivery.inconsistent(_states(spark, sf))


@query(f"{_CELLS} SELECT prod_id, msg_id, topic_id, consumer_id FROM cell WHERE NOT got AND NOT unconfirmed")
def failed_delivery_report(spark, sf):
    """The undelivered messages as a report with a folder per producer and consumer."""
    path = fresh_path(spark, "failed")
    write_partitioned(delivery.undelivered(_states(spark, sf)), path, ["prod_id", "consumer_id"])
    schema = "msg_id string, topic_id string, prod_id string, consumer_id int"
    return spark.read.schema(schema).parquet(path)


@query(f"""WITH {FACTS} SELECT prod_id, msg_id, topic_id, CAST(consumer_id AS VARCHAR) AS consumer_id, latency_s FROM lat""")
def latency_report(spark, sf):
    """The latency log with a folder per consumer, read back."""
    path = fresh_path(spark, "latency-log")
    write_partitioned(reports.latency_lines(latency.message_latency(*_parts(spark, sf))), path, ["consumer_id"])
    lines = spark.read.schema("value string, consumer_id int").parquet(path)
    return logs.parse_latency(lines).select("prod_id", "msg_id", "topic_id", "consumer_id", "latency_s")


@query(f"""WITH {FACTS} SELECT prod_id, msg_id, topic_id, produced_ts FROM prod
           WHERE event_id IN (SELECT o_custkey FROM orders)""")
def message_lookup(spark, sf):
    """The messages whose number is a customer's key."""
    from streamjobs.functions.scalar import zero_pad
    prod, _ = _parts(spark, sf)
    keys = table(spark, sf, "orders").select(zero_pad(F.col("o_custkey"), 6).alias("msg_id")).distinct()
    nodes = prod.select("prod_id", "msg_id").join(keys, "msg_id", "left_semi")
    return plain(delivery.message_lookup(nodes, prod))
