"""Fares made of orders and rides made of line items, as CSV messages; neighbourhoods made of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.registry import plain, query, stream, table
from streamjobs.operators.aggregates import sliding_avg as average
from streamjobs.operators.joins import assign_region, assign_region_by_cell
from streamjobs.plans import ride_tips as rides
from streamjobs.streaming.runs import collect_append

DAY = 86400
UPPER = 120 * DAY


def _text(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _later(day, seconds):
    return day + F.make_interval(secs=seconds)


def fare_messages(orders):
    start = _later(F.col("o_orderdate"), F.col("o_orderkey") % DAY)
    return orders.select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_custkey", _text(start), "o_orderpriority",
                                     (F.col("o_orderkey") % 80) * 0.25, F.lit(0.0), "o_totalprice").alias("value"))


def ride_messages(lineitem):
    """Positions on a grid of 1/256 degree, some of them outside the covered area."""
    end = _later(F.col("l_shipdate"), F.col("l_partkey") % DAY)
    lon = F.lit(-74.0625) + (F.col("l_partkey") % 100) / 256
    lat = F.lit(40.4375) + ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 160) / 256
    end_lon = F.lit(-74.0625) + (F.col("l_suppkey") % 97) / 256
    end_lat = F.lit(40.4375) + ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 150) / 256
    return lineitem.select(F.concat_ws(
        ",", "l_orderkey", F.when(F.col("l_linenumber") % 4 == 0, "START").otherwise("END"), _text(end),
        _text(F.col("l_shipdate")), lon, lat, end_lon, end_lat, "l_linenumber", "l_suppkey",
        "l_partkey").alias("value"))


def neighbourhoods(nation):
    """An L-shaped polygon per nation; neighbours overlap, so that the order matters."""
    x, y = F.lit(-74.0) + (F.col("n_nationkey") % 5) * 0.03125, F.lit(40.6875) + F.floor(F.col("n_nationkey") / 5) * 0.046875
    w, h = 0.0390625, 0.0546875
    corners = [(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)]
    return nation.select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"),
                         F.array(*[F.array(a, b) for a, b in corners]).alias("coord"))


_RIDES = """fares AS (SELECT o_orderkey AS rideId, o_orderdate + to_seconds(o_orderkey % 86400) AS startTime,
                   CAST(o_totalprice AS FLOAT) AS totalFare, (o_orderkey % 80) * 0.25 AS tip FROM orders),
  rides AS (SELECT l_orderkey AS rideId, l_shipdate + to_seconds(l_partkey % 86400) AS endTime, l_partkey AS driverId,
                   l_suppkey AS taxiId, -74.0625 + (l_partkey % 100) / 256.0 AS startLon,
                   40.4375 + ((l_suppkey * 7 + l_linenumber * 13) % 160) / 256.0 AS startLat,
                   -74.0625 + (l_suppkey % 97) / 256.0 AS endLon,
                   40.4375 + ((l_partkey * 3 + l_linenumber) % 150) / 256.0 AS endLat
            FROM lineitem WHERE l_linenumber % 4 <> 0),
  clean AS (SELECT * FROM rides WHERE startLon BETWEEN -74.05 AND -73.7 AND startLat BETWEEN 40.5 AND 41.0
                                  AND endLon BETWEEN -74.05 AND -73.7 AND endLat BETWEEN 40.5 AND 41.0),
  paid AS (SELECT * FROM fares JOIN clean USING (rideId)
           WHERE endTime > startTime AND endTime <= startTime + INTERVAL 120 DAY),
  nbhd AS (SELECT n_nationkey AS k, n_name AS name, -74.0 + (n_nationkey % 5) * 0.03125 AS x,
                  40.6875 + (n_nationkey // 5) * 0.046875 AS y, 0.0390625 AS w, 0.0546875 AS h FROM nation)"""


def _inside(lon: str, lat: str) -> str:
    return f"""({lon} >= -74.0489866963 AND {lon} < -73.8265135518 AND {lat} >= 40.681530375 AND {lat} < 40.9548628598
       AND {lon} >= x AND {lat} >= y AND (({lat} < y + h / 2 AND {lon} < x + w)
                                          OR ({lat} >= y + h / 2 AND {lat} < y + h AND {lon} < x + w / 2)))"""


_PAID = f"""WITH {_RIDES} SELECT rideId, startTime, totalFare, CAST(tip AS FLOAT) AS tip, endTime, driverId, taxiId,
     CAST(startLon AS FLOAT) AS startLon, CAST(startLat AS FLOAT) AS startLat, CAST(endLon AS FLOAT) AS endLon,
     CAST(endLat AS FLOAT) AS endLat FROM paid"""


def _both(read, spark, sf):
    return rides.fares(fare_messages(read(spark, sf, "orders"))), \
        rides.finished_rides(ride_messages(read(spark, sf, "lineitem")))


def _with_places(spark, sf):
    fares, ends = _both(table, spark, sf)
    paid = rides.paid_rides(fares, ends, UPPER, watermark=None)
    return rides.with_neighbourhoods(paid, neighbourhoods(table(spark, sf, "nation")))


@query(_PAID)
def rides_interval_join(spark, sf):
    fares, ends = _both(table, spark, sf)
    return plain(rides.paid_rides(fares, ends, UPPER, watermark=None))


@query(_PAID)
def rides_interval_join_stream(spark, sf):
    fares, ends = _both(stream, spark, sf)
    return plain(collect_append(rides.paid_rides(fares, ends, UPPER)))


_TIPS = f"""WITH {_RIDES},
  stops AS (SELECT paid.*, coalesce((SELECT min_by(name, k) FROM nbhd WHERE {_inside('endLon', 'endLat')}), 'Other')
                   AS stopNbhd FROM paid),
  slid AS (SELECT stopNbhd, tip, time_bucket(INTERVAL '10 days', endTime, TIMESTAMP '1970-01-01')
                  - to_days(CAST(10 * i AS INTEGER)) AS window_start FROM stops, range(3) r(i))
  SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, stopNbhd, avg(CAST(tip AS DOUBLE)) AS avg_tip
  FROM slid GROUP BY ALL"""


@query(_TIPS)
def ride_tips(spark, sf):
    return plain(rides.tips(_with_places(spark, sf), "30 days", "10 days"))


# A window is final once the time of the slower input, less the allowed delay, is a whole ride past its end.
@query(f"""SELECT t.* FROM ({_TIPS}) t WHERE window_end <= (SELECT least(
             (SELECT max(o_orderdate + to_seconds(o_orderkey % 86400)) FROM orders),
             (SELECT max(l_shipdate + to_seconds(l_partkey % 86400)) FROM lineitem
              WHERE l_linenumber % 4 <> 0 AND -74.0625 + (l_partkey % 100) / 256.0 BETWEEN -74.05 AND -73.7
                AND 40.4375 + ((l_suppkey * 7 + l_linenumber * 13) % 160) / 256.0 BETWEEN 40.5 AND 41.0
                AND -74.0625 + (l_suppkey % 97) / 256.0 BETWEEN -74.05 AND -73.7
                AND 40.4375 + ((l_partkey * 3 + l_linenumber) % 150) / 256.0 BETWEEN 40.5 AND 41.0))
             - INTERVAL 30 MINUTE - INTERVAL 120 DAY)""")
def ride_tips_stream(spark, sf):
    fares, ends = _both(stream, spark, sf)
    paid = rides.paid_rides(fares, ends, UPPER)
    placed = rides.with_neighbourhoods(paid, neighbourhoods(table(spark, sf, "nation")))
    return plain(collect_append(rides.tips(placed, "30 days", "10 days")))


_POINTS = f"""WITH {_RIDES.split(',' + chr(10) + '  paid AS')[0]},
   nbhd AS {_RIDES.split('nbhd AS ')[1]},
   r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -74.0625 + (l_suppkey % 97) / 256.0 AS lon,
                40.4375 + ((l_partkey * 3 + l_linenumber) % 150) / 256.0 AS lat FROM lineitem)
   SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          coalesce((SELECT min_by(name, k) FROM nbhd WHERE {_inside('lon', 'lat')}), 'Other') AS region FROM r"""


def _points(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    lon = F.lit(-74.0625) + (F.col("l_suppkey") % 97) / 256
    lat = F.lit(40.4375) + ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 150) / 256
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lon.alias("lon"), lat.alias("lat"))


@query(_POINTS)
def point_in_polygon(spark, sf):
    regions = neighbourhoods(table(spark, sf, "nation"))
    return assign_region(_points(spark, sf), "lon", "lat", regions, box=rides.DISTRICT).drop("lon", "lat")


@query(f"""WITH {_RIDES.split(',' + chr(10) + '  paid AS')[0]}, nbhd AS {_RIDES.split('nbhd AS ')[1]},
   e AS (SELECT event_id, -74.0625 + (user_id % 97) / 256.0 AS lon, 40.4375 + (event_id % 150) / 256.0 AS lat FROM events)
   SELECT event_id, coalesce((SELECT min_by(name, k) FROM nbhd WHERE {_inside('lon', 'lat')}), 'Other') AS region FROM e""")
def point_in_polygon_by_cell(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", (F.lit(-74.0625) + (F.col("user_id") % 97) / 256).alias("lon"),
        (F.lit(40.4375) + (F.col("event_id") % 150) / 256).alias("lat"))
    regions = neighbourhoods(table(spark, sf, "nation"))
    return assign_region_by_cell(events, "lon", "lat", regions, salts=4).drop("lon", "lat")


@query("""WITH s AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents,
                time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') - to_minutes(10 * i) AS window_start
              FROM events, range(3) r(i))
          SELECT window_start, window_start + INTERVAL 30 MINUTE AS window_end, event_type,
                 CAST(sum(cents) AS DOUBLE) / count(*) AS avg_value FROM s GROUP BY ALL""")
def sliding_avg(spark, sf):
    events = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return plain(average(events, "ts", "cents", ["event_type"]))
