"""Ships per destination, ship type and time window, from position reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.parsing import extract_json
from streamjobs.operators.aggregates import (items_per_window, running_distinct_counts, running_items, windowed_distinct_approx,
                                             windowed_items)

# The fields of a report.
FIELDS = [
    "class", "device", "repeat", "mmsi", "type", "lat", "lon", "scaled", "status", "status_text", "turn", "speed",
    "accuracy", "course", "heading", "second", "maneuver", "raim", "radio", "reserved", "regional", "cs", "display",
    "dsc", "band", "msg22", "imo", "ais_version", "callsign", "shipname", "shiptype", "shiptype_text", "to_bow",
    "to_stern", "to_port", "to_starboard", "epfd", "epfd_text", "eta", "draught", "destination", "dte", "aid_type",
    "aid_type_text", "name", "off_position", "virtual_aid",
]

# Fixed value: the report type that carries the voyage data.
VOYAGE_REPORT = 5

GROUP = ["destination", "shiptype"]


def voyage_reports(messages: DataFrame, ts: str | None = None) -> DataFrame:
    """Voyage fields of the type-5 reports. Without ``ts`` the time is that of arrival."""
    keep = [ts] if ts else []
    reports = extract_json(messages, FIELDS, keep=keep)
    voyages = reports.filter(F.col("type").try_cast("int") == VOYAGE_REPORT)
    when = F.col(ts) if ts else F.current_timestamp()
    return voyages.select(when.alias("timestamp"), "destination", "shiptype", "shiptype_text", "mmsi")


def ship_ids(reports: DataFrame, size: str = "1 minute") -> DataFrame:
    """The ships of each group, one row each."""
    return windowed_items(reports, "timestamp", size, GROUP, "mmsi")


def ship_counts(ids: DataFrame) -> DataFrame:
    """Exact number of ships per group, from ``ship_ids`` or a stream of ``running_ship_ids``."""
    return items_per_window(ids, GROUP).withColumnRenamed("n_items", "numberOfShips")


def ships(reports: DataFrame, size: str = "1 minute") -> DataFrame:
    """Exact number of ships per window and group, one row each."""
    return ship_counts(ship_ids(reports, size))


def ships_approx(reports: DataFrame, size: str = "1 minute") -> DataFrame:
    """Approximate counts, from a state of fixed size per group."""
    return windowed_distinct_approx(reports, "timestamp", size, GROUP, "mmsi")


def running_ships(reports: DataFrame, size: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """``ships`` of a stream in one append query, with state that is forgotten (see ``running_distinct_counts``)."""
    return running_distinct_counts(reports, "timestamp", size, GROUP, "mmsi", late).withColumnRenamed("n_items", "numberOfShips")


def running_ship_ids(reports: DataFrame, size: str = "1 minute", late: str | None = None) -> DataFrame:
    """``ship_ids`` of a stream; ``late`` bounds the state (see ``running_items``)."""
    return running_items(reports, "timestamp", size, GROUP, "mmsi", late)
