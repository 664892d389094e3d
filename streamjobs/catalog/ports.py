"""Packets made of events, and parsing of delimited messages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.catalog.registry import K, plain, prop_k, query, stream, table
from streamjobs.functions import parsing
from streamjobs.plans import port_statistics as ports
from streamjobs.streaming.runs import collect_append, collect_update

_PORT = """CASE event_type WHEN 'click' THEN '20' WHEN 'view' THEN '443' WHEN 'purchase' THEN '25' ELSE '53' END"""
_PACKETS = f"""WITH p AS (SELECT CAST(user_id % 3 + 1 AS INTEGER) AS nodeID, CAST(user_id % 20 AS INTEGER) AS prodInstanceID,
                  CAST(day(ts) AS INTEGER) AS flowCount, CAST(event_id AS INTEGER) AS pktCount, {_PORT} AS dstPort
             FROM events)"""
_STATS = """SELECT nodeID, prodInstanceID, flowCount, dstPort, count(*) AS totalPkts FROM p GROUP BY ALL"""
_IDS = """SELECT DISTINCT nodeID, prodInstanceID, flowCount, dstPort, pktCount FROM p"""
_FLOW = """' Producer Node: ' || nodeID || ' user: ' || prodInstanceID || ' flow ID: ' || flowCount
         || ' destination Port: ' || dstPort"""


def packet_messages(events):
    port = (F.when(F.col("event_type") == "click", "20").when(F.col("event_type") == "view", "443")
             .when(F.col("event_type") == "purchase", "25").otherwise("53"))
    return events.select(F.concat_ws(
        ",", F.col("user_id") % 3 + 1, F.col("user_id") % 20, F.dayofmonth("ts"), "event_id", F.lit("192.168.1.11"),
        F.lit("20.198.162.76"), F.lit("6"), F.lit(50000) + prop_k(), port, prop_k(), "event_type").alias("value"))


def _packets(events):
    return ports.packets(packet_messages(events))


@query(f"{_PACKETS} {_STATS}")
def port_statistics(spark, sf):
    return ports.statistics(_packets(table(spark, sf, "events")))


@query(f"{_PACKETS} {_IDS}")
def port_packet_ids(spark, sf):
    return ports.packet_ids(_packets(table(spark, sf, "events")))


@query(f"{_PACKETS}, s AS ({_STATS}) SELECT {_FLOW} || ' total packets: ' || totalPkts AS value FROM s")
def port_statistics_lines(spark, sf):
    return ports.lines(ports.statistics(_packets(table(spark, sf, "events"))))


@query(f"{_PACKETS}, s AS ({_IDS}) SELECT {_FLOW} || ' packet ID: ' || pktCount AS value FROM s")
def port_packet_lines_stream(spark, sf):
    return collect_append(ports.id_lines(ports.packet_ids(_packets(stream(spark, sf, "events")))))


@query(f"{_PACKETS} {_STATS}")
def port_statistics_stream(spark, sf):
    return collect_update(ports.running_statistics(_packets(stream(spark, sf, "events"))), ports.KEYS)


@query(f"""SELECT CAST(user_id % 3 + 1 AS INTEGER) AS "nodeID", CAST(event_id AS INTEGER) AS "pktCount",
                  CAST(50000 + {K} AS VARCHAR) AS "srcPort", CAST({K} AS INTEGER) AS "payloadLength",
                  event_type AS payload, ts
           FROM events""")
def from_csv_parse(spark, sf):
    events = table(spark, sf, "events")
    messages = events.select("ts", *[c.alias("value") for c in [_message(events)]])
    parsed = ports.packets(messages, keep=["ts"])
    return plain(parsed.select("nodeID", "pktCount", "srcPort", "payloadLength", "payload", "ts"))


def _message(events):
    return F.concat_ws(",", F.col("user_id") % 3 + 1, F.col("user_id") % 20, F.dayofmonth("ts"), "event_id", F.lit("a"),
                       F.lit("b"), F.lit("6"), F.lit(50000) + prop_k(), F.lit("20"), prop_k(), "event_type")


TYPED = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType()),
                      T.StructField("amount", T.DoubleType()), T.StructField("day", T.ShortType()),
                      T.StructField("bad", T.IntegerType()), T.StructField("absent", T.StringType())])


@query("""SELECT event_id, event_type AS kind, value AS amount, CAST(day(ts) AS SMALLINT) AS day,
                 CAST(NULL AS INTEGER) AS bad, CAST(NULL AS VARCHAR) AS absent FROM events""")
def csv_parse(spark, sf):
    messages = table(spark, sf, "events").select(
        F.concat_ws(",", "event_id", "event_type", "value", F.dayofmonth("ts"), "event_type").alias("value"))
    return parsing.parse_delimited(messages, TYPED)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS step, o_orderstatus AS type, CAST(NULL AS VARCHAR) AS missing
          FROM orders""")
def csv_positions(spark, sf):
    messages = table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("value"))
    return parsing.split_positions(messages, ["step", "type", "missing"])


@query("""SELECT text AS value, source AS topic, CAST(doc_id AS VARCHAR) AS file FROM documents""")
def tag_split(spark, sf):
    messages = table(spark, sf, "documents").select(
        F.concat("text", F.lit(" Topic: "), "source", F.lit(" File: "), "doc_id").alias("value"))
    return parsing.split_tags(messages, [(" File: ", "file"), (" Topic: ", "topic")])


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE text END AS content FROM documents""")
def file_tag_decode(spark, sf):
    docs = table(spark, sf, "documents")
    message = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" File: "), "doc_id")).otherwise(F.col("text"))
    return docs.select("doc_id", parsing.file_tag(message).alias("content"))


@query(r"""SELECT event_id, printf('%02d', user_id) AS prod_id, printf('%06d', event_id) AS msg_id,
                  CAST(8 + length(props) AS INTEGER) AS size FROM events WHERE user_id < 100
           UNION ALL
           SELECT event_id, substr(user_id::VARCHAR, 1, 2), substr(user_id::VARCHAR || printf('%06d', event_id), 3, 6),
                  CAST(9 + length(props) AS INTEGER) FROM events WHERE user_id BETWEEN 100 AND 999
           UNION ALL
           SELECT event_id, substr(user_id::VARCHAR, 1, 2), substr(user_id::VARCHAR || printf('%06d', event_id), 3, 6),
                  CAST(10 + length(props) AS INTEGER) FROM events WHERE user_id > 999""")
def fixed_width_decode(spark, sf):
    from streamjobs.functions.scalar import zero_pad
    events = table(spark, sf, "events").select("event_id", F.concat(
        zero_pad(F.col("user_id"), 2), zero_pad(F.col("event_id"), 6), "props").alias("value"))
    return parsing.decode_fixed_width(events).drop("value")
