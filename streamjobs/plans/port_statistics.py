"""Packets per flow and destination port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.parsing import parse_csv_ddl

PACKET = ("nodeID INT, prodInstanceID INT, flowCount INT, pktCount INT, srcIP STRING, dstIP STRING, proto INT, "
          "srcPort STRING, dstPort STRING, payloadLength INT, payload STRING")
KEYS = ["nodeID", "prodInstanceID", "flowCount", "dstPort"]


def packets(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return parse_csv_ddl(messages, PACKET, keep=keep or [])


def statistics(pkts: DataFrame) -> DataFrame:
    """Packets of each flow and port; one row per flow, in a batch as on a stream."""
    return pkts.groupBy(*KEYS).agg(F.count("pktCount").alias("totalPkts"))


def running_statistics(pkts: DataFrame, ts: str | None = None, late: str | None = None, size: str = "1 day") -> DataFrame:
    """The same on a stream. With ``ts`` and ``late`` flows count per window of ``size``, and the state of a window goes."""
    if not (ts and late):
        return statistics(pkts)
    window = F.window(ts, size).alias("window")
    return (pkts.withWatermark(ts, late).groupBy(window, *KEYS).agg(F.count("pktCount").alias("totalPkts"))
                .select(F.col("window.start").alias("window_start"), *KEYS, "totalPkts"))


def packet_ids(pkts: DataFrame) -> DataFrame:
    """The packets of each flow and port, one row per distinct id; on a stream the state holds all ids."""
    return pkts.filter(F.col("pktCount").isNotNull()).select(*KEYS, "pktCount").dropDuplicates([*KEYS, "pktCount"])


def _flow(*more: Column) -> Column:
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    return F.concat(F.lit(" Producer Node: "), text("nodeID"), F.lit(" user: "), text("prodInstanceID"),
                    F.lit(" flow ID: "), text("flowCount"), F.lit(" destination Port: "), text("dstPort"), *more)


def lines(stats: DataFrame) -> DataFrame:
    """The totals as text messages, one per flow."""
    return stats.select(_flow(F.lit(" total packets: "), F.col("totalPkts").cast("string")).alias("value"))


def id_lines(ids: DataFrame) -> DataFrame:
    """The packets as text messages, one per packet."""
    return ids.select(_flow(F.lit(" packet ID: "), F.col("pktCount").cast("string")).alias("value"))
