"""Port counters made of events: a running byte count per switch and port."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.registry import prop_k, query, rounded, table
from streamjobs.operators import network as net
from streamjobs.operators.ordered import running_totals
from streamjobs.plans import reports

_PORTS = r"""c AS (SELECT event_id, CAST(user_id % 3 + 1 AS INTEGER) AS switch, CAST(user_id % 4 + 1 AS INTEGER) AS port,
        CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) OVER (PARTITION BY user_id % 3, user_id % 4 ORDER BY event_id)
             AS BIGINT) AS rx_bytes,
        row_number() OVER (PARTITION BY user_id % 3, user_id % 4 ORDER BY event_id) - 1 AS sample FROM events),
   r AS (SELECT *, coalesce((rx_bytes - lag(rx_bytes) OVER (PARTITION BY switch, port ORDER BY sample)) / 5.0::DOUBLE, 0.0::DOUBLE)
         AS rate FROM c)"""
KEYS = ["switch", "port"]


def _steps(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 3 + 1).cast("int").alias("switch"),
        (F.col("user_id") % 4 + 1).cast("int").alias("port"), prop_k().cast("long").alias("step"))


def _counters(spark, sf):
    return running_totals(_steps(spark, sf), KEYS, ["event_id"], "step", "rx_bytes")


def _rates(spark, sf):
    numbered = net.sample_numbers(_counters(spark, sf), KEYS, ["event_id"])
    return net.counter_rate_by_sample(numbered, KEYS, "rx_bytes")


@query(f"WITH {_PORTS} SELECT event_id, switch, port, rx_bytes FROM c")
def running_counter(spark, sf):
    return _counters(spark, sf).drop("step")


@query(f"WITH {_PORTS} SELECT event_id, switch, port, rx_bytes, rate FROM r")
def counter_rate(spark, sf):
    return reports.bandwidth(_counters(spark, sf).drop("step"), "rx_bytes", ["event_id"])


@query(f"WITH {_PORTS} SELECT event_id, switch, port, sample, sample * 5.0::DOUBLE AS time_s, rx_bytes, rate FROM r")
def counter_rate_by_sample(spark, sf):
    return _rates(spark, sf).drop("step")


@query(f"""WITH {_PORTS} SELECT switch, port, round(avg(rate) / 1e6, 12) AS mean_mb_s, max(rate) AS max_rate, count(*) AS n_samples
           FROM r GROUP BY ALL""")
def port_bandwidth(spark, sf):
    return rounded(net.port_bandwidth(_rates(spark, sf), KEYS), 12, "mean_mb_s")


@query(f"WITH {_PORTS} SELECT sample, round(sum(rate), 6) AS rate FROM r GROUP BY sample")
def bandwidth_sum(spark, sf):
    return rounded(net.sum_series(_rates(spark, sf)), 6, "rate")


_LISTED = """(switch, port) IN ((1, 1), (2, 3), (3, 4))"""


@query(f"""WITH {_PORTS} SELECT sample, round(sum(rate), 6) AS rate FROM r
           WHERE {_LISTED} AND sample IN (SELECT sample FROM r WHERE switch = 1 AND port = 1) GROUP BY sample""")
def bandwidth_sum_listed(spark, sf):
    return rounded(net.sum_series(_rates(spark, sf), [(1, 1), (2, 3), (3, 4)]), 6, "rate")


@query(f"WITH {_PORTS} SELECT sample, rate FROM r WHERE switch = 1 AND port = 1")
def bandwidth_first_port(spark, sf):
    return net.sum_series(_rates(spark, sf), [(1, 1), (2, 3), (3, 4)], first_port_only=True)


@query(f"""WITH {_PORTS} SELECT sample, CAST(1000 * 30 * 12 / 1e6 AS DOUBLE) AS offered_mb_s, rate / 1e6 AS rate_mb_s
           FROM r WHERE switch = 1 AND port = 1""")
def offered_load(spark, sf):
    rates = net.sum_series(_rates(spark, sf), [(1, 1)])
    offered = net.offered_load(rates, 1000, 30.0, 12)
    return rates.join(offered, "sample").select("sample", "offered_mb_s", (F.col("rate") / 1e6).alias("rate_mb_s"))
