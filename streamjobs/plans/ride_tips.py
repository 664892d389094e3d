"""Average tip per neighbourhood, from taxi rides and fares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.functions.geo import in_box
from streamjobs.functions.parsing import parse_delimited
from streamjobs.operators.aggregates import sliding_avg
from streamjobs.operators.joins import Regions, interval_join

FARES = T.StructType([
    T.StructField("rideId", T.LongType()), T.StructField("taxiId", T.LongType()),
    T.StructField("driverId", T.LongType()), T.StructField("startTime", T.TimestampType()),
    T.StructField("paymentType", T.StringType()), T.StructField("tip", T.FloatType()),
    T.StructField("tolls", T.FloatType()), T.StructField("totalFare", T.FloatType()),
])
RIDES = T.StructType([
    T.StructField("rideId", T.LongType()), T.StructField("isStart", T.StringType()),
    T.StructField("endTime", T.TimestampType()), T.StructField("startTime", T.TimestampType()),
    T.StructField("startLon", T.FloatType()), T.StructField("startLat", T.FloatType()),
    T.StructField("endLon", T.FloatType()), T.StructField("endLat", T.FloatType()),
    T.StructField("passengerCnt", T.ShortType()), T.StructField("taxiId", T.LongType()),
    T.StructField("driverId", T.LongType()),
])

# West, east, south, north of the covered area and of the inner district.
CITY = (-74.05, -73.7, 40.5, 41.0)
DISTRICT = (-74.0489866963, -73.8265135518, 40.681530375, 40.9548628598)

MAX_RIDE_SECONDS = 2 * 3600
DELAY = "30 minutes"


def fares(messages: DataFrame) -> DataFrame:
    parsed = parse_delimited(messages, FARES)
    return parsed.select("rideId", "startTime", "totalFare", "tip")


def finished_rides(messages: DataFrame) -> DataFrame:
    """Rides that ended, inside the covered area at both ends."""
    parsed = parse_delimited(messages, RIDES)
    return clean_rides(parsed).select("rideId", "endTime", "driverId", "taxiId", "startLon", "startLat",
                                      "endLon", "endLat")


def clean_rides(rides: DataFrame, box: tuple[float, float, float, float] = CITY) -> DataFrame:
    inside = in_box(F.col("startLon"), F.col("startLat"), *box) & in_box(F.col("endLon"), F.col("endLat"), *box)
    return rides.filter(inside & (F.col("isStart") == "END"))


def paid_rides(fare_rows: DataFrame, ride_rows: DataFrame, upper_seconds: int = MAX_RIDE_SECONDS,
               watermark: str | None = DELAY) -> DataFrame:
    """Each finished ride with its fare."""
    return interval_join(fare_rows, ride_rows, ["rideId"], "startTime", "endTime", upper_seconds, watermark)


def with_neighbourhoods(rides: DataFrame, regions: DataFrame,
                        box: tuple[float, float, float, float] | None = DISTRICT) -> DataFrame:
    ready = Regions(regions)
    stop = ready.assign(rides, "endLon", "endLat", "stopNbhd", box=box)
    return ready.assign(stop, "startLon", "startLat", "startNbhd", box=box)


def tips(rides: DataFrame, size: str = "30 minutes", slide: str = "10 minutes") -> DataFrame:
    return sliding_avg(rides, "endTime", "tip", ["stopNbhd"], size, slide, "avg_tip")
