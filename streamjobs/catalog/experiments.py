"""Runs made of customers and their orders, and metric samples made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.registry import K, plain, prop_k, query, rounded, table
from streamjobs.functions.parsing import drop_blank, drop_text_none, to_doubles
from streamjobs.functions.rules import config_violations
from streamjobs.functions.scalar import after_last, option_code, option_name, rescale_knob, topic_colour
from streamjobs.operators import experiments as exp
from streamjobs.operators import sets, statistics
from streamjobs.operators.ordered import row_numbers
from streamjobs.plans import runs
from streamjobs.session import fresh_path, written
from streamjobs.sources.files import explode_catalogue, read_box_settings, read_experiments
from streamjobs.streaming.sinks import append_result, write_csv

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
OPTIONS = ["None", "gzip", "snappy", "lz4"]
METRICS = ["m_click", "m_view", "m_error_used", "m_purchase", "m_signup", "m_absent"]
GAUGES = ["click", "view", "error"]

_VALUE = f"CASE WHEN {K} % 10 = 0 THEN 0 WHEN {K} % 10 = 1 THEN NULL ELSE floor(value * 4) / 4 END"
_SAMPLES = f"""s AS (SELECT CAST(day(ts) AS INTEGER) AS run_index, 'h' || (user_id % 10 + 1) AS host, event_id, event_type,
     event_type IN ('click', 'view', 'error') AS gauge, {_VALUE} AS v FROM events),
   used AS (SELECT * FROM s WHERE v <> 0),
   st AS (SELECT run_index, host, """ + ", ".join(
    f"avg(v) FILTER (event_type = '{t}' AND v <> 0) AS m_{t}{'_used' if t == 'error' else ''}" for t in GAUGES) + ", " + ", ".join(
    f"max_by(v, event_id) FILTER (event_type = '{t}' AND v <> 0) AS m_{t}" for t in ("purchase", "signup")) + """,
     CAST(NULL AS DOUBLE) AS m_absent FROM s GROUP BY run_index, host)"""


def _samples(spark, sf):
    k = prop_k()
    value = F.when(k % 10 == 0, F.lit(0.0)).when(k % 10 == 1, None).otherwise(F.floor(F.col("value") * 4) / 4)
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("run_index"), F.concat(F.lit("h"), F.col("user_id") % 10 + 1).alias("host"),
        F.col("event_id").alias("ts"), F.concat(F.lit("m_"), "event_type").alias("metric"),
        F.when(F.col("event_type").isin(GAUGES), "gauge").otherwise("counter").alias("kind"),
        F.when(F.col("event_type") == "error", "used").alias("attribute_key"), value.alias("value"))


def _states(spark, sf):
    return exp.metrics_rollup(_samples(spark, sf), METRICS)


@query(f"""WITH {_SAMPLES} SELECT run_index, host, round(m_click, 6) AS m_click, round(m_view, 6) AS m_view,
             round(m_error_used, 6) AS m_error_used, m_purchase, m_signup, m_absent FROM st""")
def metrics_rollup(spark, sf):
    return rounded(_states(spark, sf), 6, "m_click", "m_view", "m_error_used")


def _results(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).cast("int").alias("run_index")).agg(
        (F.sum(F.col("o_orderkey")) / 4).alias("Throughput"), (F.count(F.lit(1)) / 8).alias("Latency"))


_RESULTS = """res AS (SELECT CAST(o_custkey % 40 AS INTEGER) AS run_index, round_even(CAST(sum(o_orderkey) AS DOUBLE) / 4, 2) AS
     "Throughput", round_even(count(*) / 8.0::DOUBLE, 2) AS "Latency" FROM orders GROUP BY 1)"""


@query(f"""WITH {_SAMPLES}, {_RESULTS}, m AS (SELECT run_index, """ + ", ".join(
    f"round_even(avg(floor({m} * 4) / 4), 2) AS {m}" for m in sorted(METRICS)) + """ FROM st GROUP BY run_index)
   SELECT m.*, "Throughput", "Latency" FROM m LEFT JOIN res USING (run_index)""")
def merge_metrics(spark, sf):
    """The hosts' tables go through CSV files with a header, one folder per host; one is missing."""
    path = fresh_path(spark, "states")
    states = _states(spark, sf).withColumns({m: F.floor(F.col(m) * 4) / 4 for m in METRICS})
    for part, hosts in (("a", ["h1", "h2", "h3"]), ("b", ["h4", "h5", "h6", "h7", "h8", "h9", "h10"])):
        write_csv(states.filter(F.col("host").isin(hosts)), f"{path}/{part}")
    frames = read_experiments(spark, [f"{path}/{p}" for p in ("a", "b", "none")])
    typed = [f.withColumns({m: F.col(m).try_cast("double") for m in METRICS}) for f in frames]
    return exp.merge_metrics(typed, _results(spark, sf))


def _schedule(spark, sf):
    return table(spark, sf, "customer").withColumnRenamed("c_custkey", "run_index")


def _done(spark, sf):
    return table(spark, sf, "orders").withColumnRenamed("o_custkey", "run_index")


@query("""SELECT c_custkey AS run_index, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
          WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_runs(spark, sf):
    return sets.missing_runs(_schedule(spark, sf), _done(spark, sf))


@query("""SELECT l_partkey AS run_index, count(*) AS n FROM lineitem
          WHERE l_partkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def missing_runs_reverse(spark, sf):
    parts = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "run_index")
    missing = sets.missing_runs(parts, _schedule(spark, sf))
    return missing.groupBy("run_index").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(a, b) AS run_index, CASE WHEN a IS NULL THEN 'second' WHEN b IS NULL THEN 'first' ELSE 'both' END AS side
          FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT l_partkey AS b FROM lineitem) ON a = b""")
def index_differences(spark, sf):
    return sets.index_differences(_schedule(spark, sf), table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "run_index"))


@query("""SELECT event_id AS run_index, event_type FROM events
          WHERE event_id > (SELECT coalesce(max(event_id), -1) FROM events WHERE ts < TIMESTAMP '2024-01-20')""")
def pending_runs(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_id").alias("run_index"), "event_type", "ts")
    done = runs.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    return sets.pending_runs(runs.drop("ts"), done)


@query("""WITH o AS (SELECT o_custkey AS run_index, count(*) AS n_orders FROM orders GROUP BY 1),
               p AS (SELECT l_suppkey * 7 AS run_index, count(*) AS n_items FROM lineitem GROUP BY 1)
          SELECT run_index, n_orders, n_items FROM o FULL JOIN p USING (run_index)""")
def aligned_runs(spark, sf):
    orders = _done(spark, sf).groupBy("run_index").agg(F.count(F.lit(1)).alias("n_orders"))
    items = (table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") * 7).alias("run_index"))
             .agg(F.count(F.lit(1)).alias("n_items")))
    return exp.align_runs(orders, items)


@query("""WITH t AS (SELECT o_custkey AS run_index, count(*) AS throughput FROM orders GROUP BY 1),
               l AS (SELECT o_custkey AS run_index, round(avg(l_quantity), 6) AS latency
                     FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
          SELECT c_custkey AS run_index, c_mktsegment, throughput, latency
          FROM customer LEFT JOIN t ON c_custkey = t.run_index LEFT JOIN l ON c_custkey = l.run_index""")
def run_summary(spark, sf):
    """One result row per run, appended to a table in two steps."""
    orders, items = _done(spark, sf), table(spark, sf, "lineitem")
    throughput = orders.groupBy("run_index").agg(F.count(F.lit(1)).alias("throughput"))
    latency = (orders.join(items, orders["o_orderkey"] == items["l_orderkey"]).groupBy("run_index")
               .agg(F.round(F.avg("l_quantity"), 6).alias("latency")))
    rows = exp.run_row(_schedule(spark, sf).select("run_index", "c_mktsegment"), throughput, latency)
    path = fresh_path(spark, "results")
    append_result(rows.filter(F.col("throughput").isNotNull()), path)
    append_result(rows.filter(F.col("throughput").isNull()), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("""SELECT o_orderkey, CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)
                 - 1 AS INTEGER) AS code, o_orderpriority AS name FROM orders""")
def encode_options(spark, sf):
    orders = table(spark, sf, "orders").withColumn("code", option_code(F.col("o_orderpriority"), PRIORITIES))
    return orders.select("o_orderkey", "code", option_name(F.col("code") + 1, PRIORITIES).alias("name"))


@query("""SELECT c_custkey AS run_index, CAST(c_custkey % 4 AS INTEGER) AS compression FROM customer""")
def prepare_schedule(spark, sf):
    named = F.element_at(F.array(*[F.lit(o) for o in ["none", "gzip", "snappy", "lz4"]]),
                         (F.col("c_custkey") % 4 + 1).cast("int"))
    schedule = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_index"), named.alias("compression"))
    return exp.prepare_schedule(schedule, "compression", OPTIONS)


@query("""SELECT o_orderkey, o_totalprice, half FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS half
          FROM orders)""")
def drop_constant_columns(spark, sf):
    """One column is the same throughout; one is either 1 or null, so it varies."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.lit("same").alias("constant"), (F.col("o_orderkey") * 0).alias("zero"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).alias("half"))
    return exp.drop_constant(orders)


@query("""SELECT l_suppkey AS run_index, max_by(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS quantity,
                 max(l_shipdate) AS l_shipdate
          FROM lineitem GROUP BY l_suppkey""")
def keep_last(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_index"), F.col("l_quantity").alias("quantity"), "l_shipdate",
        F.lit(7).alias("constant"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("line"))
    return plain(exp.prepare_states(rows, ["line"]).drop("line"))


@query("""SELECT l_suppkey, min_by(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS l_quantity
          FROM lineitem GROUP BY l_suppkey""")
def keep_first(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", *order)
    return sets.keep_first(rows, ["l_suppkey"], order).select("l_suppkey", "l_quantity")


@query(f"""SELECT event_id, user_id, event_type, k FROM (SELECT event_id, user_id, event_type, {K} % 5 AS k,
             row_number() OVER (PARTITION BY user_id, event_type, {K} % 5 ORDER BY event_id) AS n FROM events) WHERE n > 1""")
def duplicate_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", (prop_k() % 5).alias("k"))
    return sets.duplicate_rows(events, "event_id").select("event_id", "user_id", "event_type", "k")


@query(f"""SELECT avg_name AS state, knob, round(c, 6) AS corr FROM (
  SELECT 'l_extendedprice' AS avg_name, 'l_quantity' AS knob, corr(l_extendedprice, l_quantity) AS c FROM lineitem UNION ALL
  SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL
  SELECT 'l_tax', 'l_quantity', corr(l_tax, l_quantity) FROM lineitem UNION ALL
  SELECT 'l_tax', 'l_discount', corr(l_tax, l_discount) FROM lineitem)""")
def correlation(spark, sf):
    corr = statistics.cross_corr(table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], ["l_quantity", "l_discount"])
    return rounded(corr, 6, "corr")


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
        round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_tax"))


@query(_DESCRIBE)
def describe(spark, sf):
    return rounded(statistics.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 4,
                   "mean", "std", "q25", "q50", "q75")


_CONFIG = """c AS (SELECT o_orderkey, CAST(o_orderkey % 5 - 1 AS INTEGER) AS acks,
      ['None', 'gzip', 'snappy', 'lz4', 'zip'][o_orderkey % 5 + 1] AS compression, CAST(o_orderkey % 130 AS DOUBLE) AS message_rate,
      CAST(o_custkey * 1500 AS BIGINT) AS session_timeout_ms, CAST(o_custkey * 37 AS BIGINT) AS replica_max_wait_ms FROM orders)"""


@query(f"""WITH {_CONFIG} SELECT o_orderkey, concat_ws(',', CASE WHEN acks NOT IN (0, 1, 2) THEN 'acks' END,
     CASE WHEN compression NOT IN ('None', 'gzip', 'snappy', 'lz4') THEN 'compression' END,
     CASE WHEN message_rate > 100 THEN 'message_rate' END,
     CASE WHEN session_timeout_ms NOT BETWEEN 6000 AND 1800000 THEN 'session_timeout_ms' END,
     CASE WHEN replica_max_wait_ms >= 30000 THEN 'replica_max_wait_ms' END) AS broken FROM c""")
def config_rules(spark, sf):
    k = F.col("o_orderkey")
    config = table(spark, sf, "orders").select(
        k, (k % 5 - 1).cast("int").alias("acks"),
        F.element_at(F.lit(["None", "gzip", "snappy", "lz4", "zip"]), (k % 5 + 1).cast("int")).alias("compression"),
        (k % 130).cast("double").alias("message_rate"), (F.col("o_custkey") * 1500).alias("session_timeout_ms"),
        (F.col("o_custkey") * 37).alias("replica_max_wait_ms"))
    return config_violations(config).select("o_orderkey", F.concat_ws(",", "violations").alias("broken"))


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS number
          FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 11 <> 0)""")
def clean_values(spark, sf):
    """Blank names are dropped, the word None is dropped, and text that is no number becomes null."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k, "o_totalprice", F.when(k % 7 == 0, "").otherwise("x").alias("name"),
        F.when(k % 11 == 0, "None").otherwise("gzip").alias("option"),
        F.when(k % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("number"))
    kept = drop_text_none(drop_blank(rows, ["name"]), "option")
    return to_doubles(kept, ["number"]).select("o_orderkey", "o_totalprice", "number")


@query("""SELECT event_type, count(*) AS n FROM events WHERE value <> 0 GROUP BY event_type
          UNION ALL SELECT 'all', count(*) FROM events""")
def union_counts(spark, sf):
    """Counts of two tables whose columns differ, put together by name."""
    events = table(spark, sf, "events")
    by_type = events.filter(F.col("value") != 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = events.agg(F.count(F.lit(1)).alias("n"))
    return sets.union_by_name([by_type, total]).fillna("all", subset=["event_type"])


@query("""SELECT 'l_quantity' AS metric UNION ALL SELECT 'l_discount'""")
def nonzero_metrics(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("zero", F.lit(0)).withColumn("text", F.lit("n/a"))
    names = exp.nonzero_columns(items, ["l_quantity", "zero", "l_discount", "text"])
    return spark.range(1).select(F.explode(F.lit(names)).alias("metric"))


@query("""SELECT 'bean_' || user_id AS bean, 'o:' || user_id AS object_name, 'gauge' AS kind, event_type AS metric,
                 CAST(event_id AS VARCHAR) AS attribute FROM events""")
def metric_catalogue(spark, sf):
    """Nested catalogue entries, one bean per user, taken apart again."""
    values = F.collect_list(F.struct(F.lit("gauge").alias("Type"), F.col("event_type").alias("InstancePrefix"),
                                     F.col("event_id").cast("string").alias("Attribute"))).alias("Values")
    beans = (table(spark, sf, "events").withColumn("part", F.floor(F.col("event_id") / 1000))
             .groupBy("user_id", "part").agg(values)
             .select(F.concat(F.lit("bean_"), "user_id").alias("MBean"), F.concat(F.lit("o:"), "user_id").alias("ObjectName"),
                     "Values"))
    return explode_catalogue(beans)


@query("""SELECT setting, latency_s FROM (SELECT event_id, '100ms' AS setting, CAST(event_id % 60 AS DOUBLE) AS latency_s FROM events
            UNION ALL SELECT event_id, '500ms', CAST(event_id % 50 AS DOUBLE) + 0.5 FROM events)
          WHERE event_id % 9 <> 0""")
def box_settings(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(e % 9 != 0, F.concat(F.lit("0:00:"), e % 60)).alias("100ms"),
        F.concat(F.lit("0:00:"), e % 50 + F.lit(0.5)).alias("500ms"))
    return read_box_settings(rows)


@query("""SELECT event_id, CAST(event_id % 5 * 51 AS INTEGER) AS colour, event_type AS tail,
                 CAST(ceil((event_id % 100) / 100.0::DOUBLE * 262145) AS BIGINT) AS knob FROM events""")
def scalar_functions(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", topic_colour(F.col("event_id") % 5, 5).alias("colour"),
                         after_last(F.concat(F.lit("a:b:"), "event_type")).alias("tail"),
                         rescale_knob(F.col("event_id") % 100 / 100, F.lit(262145)).alias("knob"))


@query("""SELECT c_custkey AS run_index, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def knob_rows(spark, sf):
    """The settings of those runs that have a result."""
    return runs.rows_of(_schedule(spark, sf).select("run_index", "c_mktsegment"), _done(spark, sf))


@query("""WITH r AS (SELECT o_custkey AS run_index, count(*) AS n FROM orders GROUP BY 1)
          SELECT 'missing' AS kind, c_custkey AS run_index FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
          UNION ALL SELECT 'unplanned', run_index FROM r WHERE run_index NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'pending', c_custkey FROM customer WHERE c_custkey > (SELECT max(o_custkey) FROM orders)
          UNION ALL SELECT 'repeated', run_index FROM (SELECT run_index, row_number() OVER (PARTITION BY n ORDER BY run_index)
                                                       AS k FROM r) WHERE k > 1""")
def experiment_audit(spark, sf):
    """The runs that each part of the audit lists."""
    results = _done(spark, sf).groupBy("run_index").agg(F.count(F.lit(1)).alias("n"))
    tables = runs.audit(_schedule(spark, sf), results)
    return sets.union_by_name([t.select(F.lit(k).alias("kind"), "run_index") for k, t in tables.items()])


@query("""SELECT c_custkey AS run_index, row_number() OVER (ORDER BY c_custkey) AS place FROM customer
          WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_runs_ordered(spark, sf):
    """Runs without a result by index, each with its place in the written output."""
    results = _done(spark, sf).groupBy("run_index").agg(F.count(F.lit(1)).alias("n"))
    missing = runs.audit(_schedule(spark, sf), results)["missing"].select("run_index")
    # Sorted output comes in range partitions, so the id rises with the order.
    out = written(missing.withColumn("_at", F.monotonically_increasing_id()), "missing")
    return row_numbers(out, [], ["_at"], "place", 1).drop("_at")


@query("""SELECT p_partkey, CAST(1 AS BIGINT) AS in_range FROM part""")
def knob_schedule(spark, sf):
    """Settings per part, with one knob per line status and its range from the items; all lie in the range."""
    items = table(spark, sf, "lineitem")
    knobs = items.groupBy(F.concat(F.lit("knob_"), "l_linestatus").alias("knob")).agg(
        F.min(F.col("l_quantity").cast("int")).alias("min"), F.max(F.col("l_quantity").cast("int")).alias("max"))
    schedule = runs.knob_schedule(table(spark, sf, "part"), knobs, 5, use_min=True, index="p_partkey")
    names = [c for c in schedule.columns if c != "p_partkey"]
    ends = items.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    inside = F.lit(True)
    for n in names:
        inside = inside & F.col(n).between(low, high)
    return schedule.select("p_partkey", inside.cast("long").alias("in_range"))
