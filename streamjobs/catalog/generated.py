"""Synthetic messages, one set per row of a given table.

The random values come from digests of the row's key, so that SQL can compute
the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.registry import query, rounded, table
from streamjobs.functions.randoms import hash_uniform, poisson_law
from streamjobs.operators.sampling import balance, latin_hypercube, split_by_key, unit_hypercube
from streamjobs.sources import files, generators

# Knobs as (name, min, max), from a single value to a wide range, and the options of the named one.
KNOBS = [(f"knob_{i}", i % 2, 7 ** i + 1) for i in range(8)] + [("producer->compression_type", 1, 4)]
COMPRESSIONS = ["None", "gzip", "snappy", "lz4"]


def uniform_sql(seed, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def int_sql(low, high, seed, *keys: str) -> str:
    return f"(CAST(floor({uniform_sql(seed, *keys)} * (({high}) - ({low}) + 1)) AS BIGINT) + ({low}))"


@query("""SELECT text AS value, CAST(i AS INTEGER) AS round
          FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark), range(1, 4) r(i)""")
def line_topic(spark, sf):
    lines = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("value"))
    return files.repeat_lines(lines, 3)


@query("""SELECT source AS topic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS file_no,
                 text || ' Topic: ' || source || ' File: ' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS value
          FROM documents""")
def files_topic(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), F.col("text").alias("value"))
    return files.tag_messages(docs, "doc_id")


@query("""SELECT item_id, CAST(i AS INTEGER) AS copy, text || 'rrrr ' || i AS value FROM benchmark, range(1, 6) r(i)""")
def replay_messages(spark, sf):
    return files.number_copies(table(spark, sf, "benchmark"), 5, "text", keep=["item_id"])


@query("""SELECT event_id, (CASE WHEN user_id > 99 THEN user_id::VARCHAR ELSE printf('%02d', user_id) END)
                 || printf('%06d', event_id) || repeat('a', 16) AS value FROM events""")
def fixed_messages(spark, sf):
    events = table(spark, sf, "events")
    sized = generators.fixed_messages(events, "user_id", "event_id", generators.message_size(5, F.col("event_id"), fixed=20))
    return sized.select("event_id", "value")


@query(f"""SELECT event_id, greatest(CAST(trunc(50.0 + 20.0 * sqrt(-2.0 * ln(1.0 - {uniform_sql('5a', 'event_id')}))
                 * cos(2.0 * pi() * {uniform_sql('5b', 'event_id')})) AS INTEGER), 1) AS size FROM events""")
def gaussian_sizes(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", generators.message_size(5, F.col("event_id"), gaussian=(50.0, 20.0)).alias("size"))


@query(f"""SELECT page_id, regexp_replace(html, '[0-9]+', CAST({int_sql(1, 999, 9, 'page_id')} AS VARCHAR), 'g') AS html FROM pages""")
def xml_randomise(spark, sf):
    return generators.xml_messages(table(spark, sf, "pages"), "page_id", 9, text="html").select("page_id", "html")


@query(f"""WITH l AS (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages),
     i AS (SELECT page_id, parts, unnest(range(0, len(parts))) AS n FROM l)
   SELECT page_id, string_agg(regexp_replace(parts[n + 1], '[0-9]+', CAST({int_sql(1, 999, 9, 'page_id', 'n')} AS VARCHAR), 'g'),
                              chr(10) ORDER BY n) AS html FROM i GROUP BY page_id""")
def xml_randomise_lines(spark, sf):
    return generators.xml_messages(table(spark, sf, "pages"), "page_id", 9, per_line=True, text="html").select("page_id", "html")


@query(f"SELECT event_id, 'topic-' || {int_sql(0, 6, 3, 'event_id')} AS topic FROM events")
def random_topics(spark, sf):
    return generators.random_topic(table(spark, sf, "events"), "event_id", 7, 3).select("event_id", "topic")


def _flows(spark, sf):
    """A flow per supplier and nation; the suppliers are the nodes."""
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("node_id"), F.lit(1).alias("instance_id"),
                                               F.col("s_suppkey").alias("flow_id"))


_WHO = "s_nationkey", "1", "s_suppkey"


@query(f"""WITH f AS (SELECT s_nationkey, s_suppkey, {int_sql(0, 200, '11n', *_WHO)} AS n FROM supplier),
     p AS (SELECT s_nationkey, s_suppkey, unnest(range(1, n + 1)) AS pkt_id FROM f)
   SELECT s_nationkey AS node_id, CAST(1 AS INTEGER) AS instance_id, s_suppkey AS flow_id, pkt_id,
          {int_sql(49152, 65535, '11s', *_WHO, 'pkt_id')} AS src_port,
          ['20', '443', '25', '53'][{int_sql(0, 3, '11d', *_WHO, 'pkt_id')} + 1] AS dst_port,
          {int_sql(1, 1500, '11l', *_WHO, 'pkt_id')} AS payload_length FROM p""")
def packet_flows(spark, sf):
    packets = generators.packet_flows(_flows(spark, sf), 11)
    return packets.select("node_id", "instance_id", "flow_id", "pkt_id", "src_port", "dst_port", "payload_length")


_LETTERS = " || ".join(
    f"""substr('{generators.ALPHABET}', CAST(floor(CAST(CAST('0x' || substr(d, {i * 5 + 1}, 5) AS BIGINT) AS DOUBLE) / 1048576.0 * 62)
        AS BIGINT) + 1, 1)""" for i in range(12))


@query(f"""WITH f AS (SELECT s_nationkey, s_suppkey, {int_sql(0, 200, '11n', *_WHO)} AS n FROM supplier),
     p AS (SELECT s_nationkey, s_suppkey, unnest(range(1, n + 1)) AS pkt_id FROM f),
     q AS (SELECT *, {int_sql(1, 1500, '11l', *_WHO, 'pkt_id')} AS len FROM p),
     b AS (SELECT *, unnest(range(0, (len - 1) // 12 + 1)) AS block FROM q),
     d AS (SELECT *, sha256('11p|' || s_nationkey || '|1|' || s_suppkey || '|' || pkt_id || '|' || block) AS d FROM b),
     t AS (SELECT s_nationkey, s_suppkey, pkt_id, len, substr(string_agg({_LETTERS}, '' ORDER BY block), 1, len) AS payload
           FROM d GROUP BY s_nationkey, s_suppkey, pkt_id, len)
   SELECT s_suppkey AS flow_id, pkt_id, s_nationkey || ',1,' || s_suppkey || ',' || pkt_id || ',192.168.1.11,20.198.162.76,6,'
          || {int_sql(49152, 65535, '11s', *_WHO, 'pkt_id')} || ','
          || ['20', '443', '25', '53'][{int_sql(0, 3, '11d', *_WHO, 'pkt_id')} + 1] || ',' || len || ',' || payload AS value FROM t""")
def packet_flow_messages(spark, sf):
    return generators.packet_flows(_flows(spark, sf), 11).select("flow_id", "pkt_id", "value")


_CUMULATIVE = ", ".join(repr(c) for c in poisson_law(generators.FLOW_GAP_SECONDS))


@query(f"""WITH g AS (SELECT s_nationkey AS node_id, s_suppkey AS flow_id,
             len(list_filter([{_CUMULATIVE}], lambda c: c <= {uniform_sql('11g', *_WHO)})) AS gap_s FROM supplier)
   SELECT node_id, CAST(1 AS INTEGER) AS instance_id, flow_id, gap_s,
          CAST(sum(gap_s) OVER (PARTITION BY node_id ORDER BY flow_id) AS BIGINT) - gap_s AS start_s FROM g""")
def flow_starts(spark, sf):
    return generators.flow_starts(_flows(spark, sf), 11)


def _u_sql(dim: str) -> str:
    return f"""(row_number() OVER (ORDER BY {uniform_sql(7, f"'{dim}'", 'p_partkey')}, p_partkey) - 1
                + {uniform_sql('7i', f"'{dim}'", 'p_partkey')}) / (SELECT count(*) FROM part)"""


@query(f"""SELECT p_partkey, round({_u_sql('a')}, 9) AS a, round({_u_sql('b')}, 9) AS b FROM part""")
def unit_samples(spark, sf):
    return rounded(unit_hypercube(table(spark, sf, "part"), "p_partkey", ["a", "b"], 7), 9, "a", "b")


@query("SELECT p_partkey, " + ", ".join(
    (f"""['None', 'gzip', 'snappy', 'lz4'][CAST(ceil({_u_sql(k)} * {high}) AS BIGINT)] AS "{k}" """ if "compression" in k else
     f"""CAST(ceil({_u_sql(k)} * {high}) AS BIGINT) AS "{k}" """) for k, _, high in KNOBS) + " FROM part")
def knob_sampling(spark, sf):
    """One set of knobs per part."""
    return latin_hypercube(table(spark, sf, "part"), "p_partkey", KNOBS, 7,
                           options={"producer->compression_type": COMPRESSIONS})


@query("SELECT p_partkey, " + ", ".join(
    f"""greatest({low}, CAST(ceil({low} + {_u_sql(k)} * {high - low}) AS BIGINT)) AS "{k}" """ for k, low, high in KNOBS)
    + " FROM part")
def knob_sampling_from_min(spark, sf):
    return latin_hypercube(table(spark, sf, "part"), "p_partkey", KNOBS, 7, use_min=True)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem
           WHERE l_returnflag = 'R' OR {uniform_sql(123, 'l_orderkey', 'l_linenumber', 'l_partkey')} < 0.1""")
def class_balance(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                               (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return balance(rows, "label", 0.1, 123, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(f"""SELECT CASE WHEN {uniform_sql(5, 'o_orderkey')} < 0.7 THEN 'train' ELSE 'test' END AS part, count(*) AS n
           FROM orders GROUP BY 1""")
def train_test_split(spark, sf):
    train, test = split_by_key(table(spark, sf, "orders"), 0.7, 5, ["o_orderkey"])
    both = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id FROM events WHERE {uniform_sql(123, 'event_id')} < 0.01""")
def bernoulli_sample(spark, sf):
    return table(spark, sf, "events").filter(hash_uniform(123, F.col("event_id")) < 0.01).select("event_id")
