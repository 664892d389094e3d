"""Position reports made of events: one JSON message per event."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from streamjobs.catalog.registry import K, plain, prop_k, query, stream, table
from streamjobs.functions.envelope import schema_envelope
from streamjobs.functions.parsing import extract_json
from streamjobs.operators.aggregates import merged_counts, windowed_sketches
from streamjobs.plans import vessel_traffic as vessels
from streamjobs.session import fresh_path, written
from streamjobs.streaming.runs import arrivals, collect_append, collect_complete, collect_update
from streamjobs.streaming.sinks import enveloped, file_sink, start, start_foreach_batch

SIZE = "6 hours"


def reports(df):
    """JSON text and time of each report."""
    k = prop_k()
    return df.select(F.col("ts").alias("sent"), F.to_json(F.struct(
        F.lit("AIS").alias("class"), (k % 3 + 3).alias("type"), F.col("user_id").alias("mmsi"),
        F.upper("event_type").alias("destination"), (F.col("user_id") % 4 * 10).alias("shiptype"),
        F.when(k % 2 == 0, F.lit("even")).alias("shiptype_text"), (F.col("event_id") % 2 == 0).alias("accuracy"),
        k.alias("maneuver"))).alias("value"), "event_id")


_VOYAGES = f"""WITH v AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start,
                    upper(event_type) AS destination, CAST(user_id % 4 * 10 AS VARCHAR) AS shiptype,
                    CAST(user_id AS VARCHAR) AS mmsi FROM events WHERE {K} % 3 + 3 = 5)"""


@query(f"""SELECT event_id, 'AIS' AS class, CAST({K} % 3 + 3 AS VARCHAR) AS type, CAST(user_id AS VARCHAR) AS mmsi,
                  upper(event_type) AS destination, CAST(user_id % 4 * 10 AS VARCHAR) AS shiptype,
                  CASE WHEN {K} % 2 = 0 THEN 'even' END AS shiptype_text,
                  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS accuracy,
                  CAST({K} AS VARCHAR) AS maneuver, CAST(NULL AS VARCHAR) AS callsign
           FROM events""")
def json_fields(spark, sf):
    fields = extract_json(reports(table(spark, sf, "events")), vessels.FIELDS, keep=["event_id"])
    return fields.select("event_id", "class", "type", "mmsi", "destination", "shiptype", "shiptype_text", "accuracy",
                         "maneuver", "callsign")


_SHIPS = """ SELECT window_start, window_start + INTERVAL '6 hours' AS window_end, destination, shiptype,
                 count(DISTINCT mmsi) AS "numberOfShips" FROM v GROUP BY ALL"""
_SHIP_IDS = """ SELECT DISTINCT window_start, window_start + INTERVAL '6 hours' AS window_end, destination, shiptype, mmsi FROM v"""


def _voyages(df):
    return vessels.voyage_reports(reports(df), "sent")


@query(_VOYAGES + _SHIPS)
def traffic_tumbling(spark, sf):
    return plain(vessels.ships(_voyages(table(spark, sf, "events")), SIZE))


@query(_VOYAGES + _SHIP_IDS)
def traffic_ships(spark, sf):
    return plain(vessels.ship_ids(_voyages(table(spark, sf, "events")), SIZE))


def _approximate(counts, spark, sf):
    """Groups whose approximate number lies more than 10 percent, or 1, beside the exact one."""
    exact = vessels.ships(_voyages(table(spark, sf, "events")), SIZE)
    keys = ["window_start", "window_end", *vessels.GROUP]
    far = F.abs(F.col("n_items") - F.col("numberOfShips")) > F.greatest(F.lit(1.0), F.col("numberOfShips") * 0.1)
    both = counts.join(exact, keys, "full")
    return plain(both.select(*keys, F.coalesce(~far, F.lit(False)).alias("close")))


_CLOSE = """ SELECT DISTINCT window_start, window_start + INTERVAL '6 hours' AS window_end, destination, shiptype,
                 true AS close FROM v"""


@query(_VOYAGES + _CLOSE)
def traffic_tumbling_approx(spark, sf):
    """Every group has an approximate number close to the exact one."""
    return _approximate(vessels.ships_approx(_voyages(table(spark, sf, "events")), SIZE), spark, sf)


@query(_VOYAGES + _CLOSE)
def traffic_tumbling_approx_stream(spark, sf):
    running = vessels.ships_approx(_voyages(stream(spark, sf, "events")), SIZE)
    return _approximate(collect_complete(running), spark, sf)


@query(f"""WITH v AS (SELECT ts, upper(event_type) AS destination, user_id FROM events WHERE {K} % 3 + 3 = 5),
    h AS (SELECT 'hour' AS level, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, * FROM v
          UNION ALL SELECT 'day', time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'), * FROM v)
  SELECT level, window_start, destination, count(DISTINCT user_id) AS n_ships FROM h GROUP BY ALL
  UNION ALL SELECT 'day, all destinations', window_start, NULL, count(DISTINCT user_id) FROM h WHERE level = 'day' GROUP BY ALL""")
def traffic_merged(spark, sf):
    """Ships per hour, per day, and per day over all destinations, from sketches per minute that were stored once."""
    voyages = _voyages(table(spark, sf, "events"))
    stored = written(windowed_sketches(voyages, "timestamp", "1 minute", ["destination"], "mmsi"), "sketches")

    def level(name, size, by):
        counts = merged_counts(stored, size, by)
        destination = F.col("destination") if by else F.lit(None).cast("string").alias("destination")
        return counts.select(F.lit(name).alias("level"), "window_start", destination, F.col("n_items").alias("n_ships"))

    return plain(level("hour", "1 hour", ["destination"]).unionByName(level("day", "1 day", ["destination"]))
                 .unionByName(level("day, all destinations", "1 day", [])))


def _running_ids(spark, sf):
    """The stream's ships as files, from which a second stream counts."""
    path = fresh_path(spark, "ships")
    ids = vessels.running_ship_ids(_voyages(stream(spark, sf, "events")), SIZE)
    start(ids, file_sink(path), "append", available_now=True).awaitTermination()
    return spark.readStream.schema(ids.schema).parquet(path)


@query(_VOYAGES + _SHIPS)
def traffic_tumbling_stream(spark, sf):
    """Exact numbers on a stream: distinct ships first, counted by a second query."""
    counts = vessels.ship_counts(_running_ids(spark, sf))
    return plain(collect_update(counts, ["window_start", "window_end", *vessels.GROUP]))


_LAST = "2034-01-01"


@query(_VOYAGES + _SHIPS)
def traffic_tumbling_one_stream(spark, sf):
    """Exact numbers from one append query over five arrivals of six days; a report from later on closes the last windows."""
    voyages = _voyages(table(spark, sf, "events"))
    closing = voyages.limit(1).withColumn("timestamp", F.lit(_LAST).cast("timestamp"))
    part = F.when(F.col("timestamp") == F.lit(_LAST).cast("timestamp"), 5).otherwise(F.floor((F.dayofmonth("timestamp") - 1) / 6))
    arriving = arrivals(voyages.unionByName(closing), part, 6)
    return plain(collect_append(vessels.running_ships(arriving, SIZE, "12 hours")))


@query(_VOYAGES + _SHIP_IDS)
def traffic_ships_stream(spark, sf):
    return plain(collect_append(vessels.running_ship_ids(_voyages(stream(spark, sf, "events")), SIZE)))


def _field(name):
    return '{"field":"' + name + '","type":"string","optional":true}'


def _head(*names):
    return '{"schema":{"type":"struct","optional":false,"version":1,"fields":[' + ",".join(map(_field, names)) + ']},"payload":'


_GROUP_FIELDS = ["window_start", "window_end", "destination", "shiptype"]
_PAYLOAD = """ || '{"window_start":"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.000Z') || '","window_end":"'
               || strftime(window_end, '%Y-%m-%dT%H:%M:%S.000Z') || '","destination":"' || destination
               || '","shiptype":"' || shiptype || '",'"""


@query(_VOYAGES + f", s AS ({_SHIPS}) SELECT '{_head(*_GROUP_FIELDS, 'numberOfShips')}'" + _PAYLOAD
       + """ || '"numberOfShips":' || "numberOfShips" || '}}' AS value FROM s""")
def traffic_envelope(spark, sf):
    """Window, group and number of ships, one message per group."""
    return schema_envelope(vessels.ships(_voyages(table(spark, sf, "events")), SIZE)
                           .select(*_GROUP_FIELDS, "numberOfShips"))


@query(_VOYAGES + f", s AS ({_SHIP_IDS}) SELECT '{_head(*_GROUP_FIELDS, 'mmsi')}'" + _PAYLOAD
       + """ || '"mmsi":"' || mmsi || '"}}' AS value FROM s""")
def traffic_envelope_stream(spark, sf):
    """Window, group and ship into the envelope sink, one message per ship."""
    path = fresh_path(spark, "envelope")
    ids = vessels.running_ship_ids(_voyages(stream(spark, sf, "events")), SIZE).select(*_GROUP_FIELDS, "mmsi")
    handle = enveloped(lambda batch, batch_id: batch.write.mode("overwrite").text(f"{path}/b={batch_id}"))
    start_foreach_batch(ids, handle, "append", available_now=True).awaitTermination()
    return spark.read.schema("value string").text(f"{path}/*")


@query(_VOYAGES + """ SELECT destination, shiptype, count(DISTINCT mmsi) AS "numberOfShips", true AS one_minute, true AS now FROM v GROUP BY ALL""")
def traffic_on_arrival_stream(spark, sf):
    """One-minute windows on the time of arrival: a stream's ships, whether all windows last a minute and are those of the run."""
    begun = datetime.now(timezone.utc)
    ids = collect_append(vessels.running_ship_ids(vessels.voyage_reports(reports(stream(spark, sf, "events"))), "1 minute"))
    minute = F.unix_seconds("window_end") - F.unix_seconds("window_start") == 60
    now = (F.col("window_end") > F.lit(begun)) & (F.col("window_start") <= F.current_timestamp())
    return ids.groupBy("destination", "shiptype").agg(F.countDistinct("mmsi").alias("numberOfShips"),
                                                      F.every(minute).alias("one_minute"), F.every(now).alias("now"))


@query(_VOYAGES + """ SELECT destination, shiptype, count(DISTINCT mmsi) AS "numberOfShips" FROM v GROUP BY ALL""")
def traffic_on_arrival(spark, sf):
    """Windows on the time of arrival, so long that all reports arrive in one."""
    arrived = vessels.voyage_reports(reports(table(spark, sf, "events")))
    return vessels.ships(arrived, "36500 days").select("destination", "shiptype", "numberOfShips")
