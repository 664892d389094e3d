"""Distinct messages, topic copies and sinks."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from streamjobs.catalog.ports import packet_messages
from streamjobs.catalog.registry import plain, query, stream, table
from streamjobs.functions.envelope import schema_envelope
from streamjobs.session import fresh_path
from streamjobs.sources.files import read_csv, read_json_lines
from streamjobs.sources.topics import file_source
from streamjobs.plans.word_count import topic_copy as copy
from streamjobs.streaming.dedup import distinct_messages
from streamjobs.streaming.ledger import BatchLedger
from streamjobs.streaming.progress import ProgressRecorder, observed, progress_table
from streamjobs.streaming.runs import arrivals, collect_append
from streamjobs.streaming.sinks import enveloped, file_sink, run_for, single_file, start, start_foreach_batch

_IDS = """SELECT DISTINCT user_id % 10 AS prod_id, day(ts) * 10 + user_id % 7 AS msg_id, event_type AS topic FROM events"""


def _ids(events):
    return events.select((F.col("user_id") % 10).alias("prod_id"),
                         (F.dayofmonth("ts") * 10 + F.col("user_id") % 7).alias("msg_id"),
                         F.col("event_type").alias("topic"), "ts")


KEYS = ["prod_id", "msg_id", "topic"]


@query(_IDS)
def dedup_messages(spark, sf):
    return distinct_messages(_ids(table(spark, sf, "events")), KEYS).select(*KEYS)


@query(_IDS)
def dedup_messages_stream(spark, sf):
    """All repeats of a message fall within a day, well inside the 40 days of memory."""
    return collect_append(distinct_messages(_ids(stream(spark, sf, "events")), KEYS, "ts", "40 days").select(*KEYS))


@query("""SELECT CAST(user_id % 3 + 1 AS VARCHAR) || ',' || CAST(user_id % 20 AS VARCHAR) || ',' || day(ts) || ',' || event_id
                 || ',192.168.1.11,20.198.162.76,6,' || (50000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) || ','
                 || CASE event_type WHEN 'click' THEN '20' WHEN 'view' THEN '443' WHEN 'purchase' THEN '25' ELSE '53' END || ','
                 || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS VARCHAR) || ',' || event_type AS value
          FROM events""")
def topic_copy(spark, sf):
    """Messages written as text files, then copied by a stream."""
    first, second = fresh_path(spark, "topic"), fresh_path(spark, "topic")
    packet_messages(table(spark, sf, "events")).write.text(first)
    copy(spark, file_source(first, "text"), file_sink(second, "text"), available_now=True).awaitTermination()
    return spark.read.text(second)


@query("""SELECT event_id, event_type, ts FROM events""")
def csv_sink_stream(spark, sf):
    """Appended to CSV files by a named query, and read back by schema."""
    path = fresh_path(spark, "csv")
    rows = stream(spark, sf, "events").select("event_id", "event_type", "ts")
    sink = file_sink(path, "csv", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    start(rows, sink, "append", name="events", available_now=True).awaitTermination()
    back = spark.read.schema("event_id long, event_type string, ts timestamp")
    return plain(back.option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


@query("""SELECT '{"schema":{"type":"struct","optional":false,"version":1,"fields":[{"field":"event_id","type":"int64","optional":true},'
                 || '{"field":"event_type","type":"string","optional":true}]},"payload":{"event_id":' || event_id
                 || ',"event_type":"' || event_type || '"}}' AS value FROM events""")
def envelope_sink_stream(spark, sf):
    """Every row of every batch in a typed schema envelope."""
    path = fresh_path(spark, "envelope")
    rows = stream(spark, sf, "events").select("event_id", "event_type")
    handle = enveloped(lambda batch, batch_id: batch.write.mode("overwrite").text(f"{path}/b={batch_id}"), typed=True)
    start_foreach_batch(rows, handle, "append", available_now=True).awaitTermination()
    return spark.read.schema("value string").text(f"{path}/*")


@query("""SELECT '{"schema":{"type":"struct","optional":false,"version":1,"fields":[{"field":"n_name","type":"string","optional":true},'
                 || '{"field":"n_regionkey","type":"string","optional":true}]},"payload":{"n_name":"' || n_name
                 || '","n_regionkey":' || n_regionkey || '}}' AS value FROM nation""")
def envelope(spark, sf):
    return schema_envelope(table(spark, sf, "nation").select("n_name", "n_regionkey"))


@query("""SELECT event_id, event_type, value FROM events""")
def csv_scan(spark, sf):
    """CSV files without a header, written and read by schema."""
    path, rows = fresh_path(spark, "csv"), table(spark, sf, "events").select("event_id", "event_type", "value")
    rows.write.csv(path)
    return read_csv(spark, path, rows.schema)


@query("""SELECT event_id, event_type FROM events""")
def json_lines_scan(spark, sf):
    path = fresh_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type").write.json(path)
    return read_json_lines(spark, path)


@query("""SELECT event_id, event_type FROM events""")
def ledger_sink_stream(spark, sf):
    """Three batches into a ledger; one fails before its entry is there, one after it, and the query is started again."""
    rows = table(spark, sf, "events").select("event_id", "event_type")
    arriving, checkpoint = arrivals(rows, F.col("event_id") % 3, 3), fresh_path(spark, "progress")
    ledger, failures = BatchLedger(spark, fresh_path(spark, "ledger")), []

    def handle(batch, batch_id):
        first = batch_id not in failures
        if first and batch_id == 1:
            failures.append(batch_id)
            batch.limit(3).write.parquet(fresh_path(spark, "ledger-left-over"))
            raise RuntimeError("before the entry")
        ledger.write(batch, "events", batch_id)
        if first and batch_id == 2:
            failures.append(batch_id)
            raise RuntimeError("after the entry")

    for _ in range(3):
        query_ = start_foreach_batch(arriving, handle, "append", checkpoint, available_now=True)
        try:
            query_.awaitTermination()
        except StreamingQueryException:
            continue
    return ledger.rows(rows.schema)


@query("""WITH p AS (SELECT *, (day(ts) - 1) // 6 AS own FROM events),
    d AS (SELECT *, CASE WHEN event_id % 50 = 0 AND own + 3 <= 4 THEN own + 3 ELSE own END AS part FROM p)
  SELECT part AS batch_id, count(*) AS n_produced, count(*) FILTER (event_type <> 'error') AS n_kept,
    count(*) FILTER (event_type <> 'error' AND part <> own) AS n_late FROM d GROUP BY 1""")
def observed_stream(spark, sf):
    """Rows produced, kept and too late per trigger, as the running query reports them; every 50th event comes 18 days late,
    as rows are judged by the watermark of the trigger before."""
    own = F.floor((F.dayofmonth("ts") - 1) / 6)
    part = F.when((F.col("event_id") % 50 == 0) & (own + 3 <= 4), own + 3).otherwise(own)
    arriving = observed(arrivals(table(spark, sf, "events").select("event_id", "event_type", "ts"), part, 5), "events",
                        produced=F.lit(True), kept=F.col("event_type") != "error")
    kept = distinct_messages(arriving.filter("event_type <> 'error'"), ["event_id"], "ts", "1 day")
    with ProgressRecorder.on(spark) as recorder:
        query_ = start(kept, file_sink(fresh_path(spark, "observed")), "append", available_now=True)
        query_.awaitTermination()
        records = progress_table(recorder, query_).filter("input_rows > 0")
    return records.select("batch_id", F.col("observed")["events.produced"].alias("n_produced"),
                          F.col("observed")["events.kept"].alias("n_kept"), F.col("late_rows").alias("n_late"))


@query("""SELECT event_id, event_type FROM events""")
def timed_trigger_stream(spark, sf):
    """A query with a processing-time trigger, stopped when it has taken all its input."""
    path, rows = fresh_path(spark, "timed"), stream(spark, sf, "events").select("event_id", "event_type")
    query_ = start(rows, file_sink(path), "append", every="1 second")
    query_.processAllAvailable()
    run_for(query_, 0.1)
    return spark.read.schema(rows.schema).parquet(path)


@query("""SELECT event_type, count(*) AS n, CAST(1 AS BIGINT) AS n_files FROM events GROUP BY event_type""")
def single_file_report(spark, sf):
    """A small report in one file."""
    path = fresh_path(spark, "single")
    report = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    single_file(report).write.parquet(path)
    back = spark.read.parquet(path).select("event_type", "n", F.col("_metadata.file_path").alias("_file"))
    files = back.agg(F.countDistinct("_file")).scalar()
    return back.select("event_type", "n", files.alias("n_files"))
