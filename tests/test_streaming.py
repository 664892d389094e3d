"""Streams give what the batch gives; sinks, progress and late rows."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamjobs.operators.aggregates import running_distinct_counts, sliding_avg, word_count
from streamjobs.operators.progress import trigger_stats
from streamjobs.plans import port_statistics as ports
from streamjobs.plans import vessel_traffic as vessels
from streamjobs.sources.topics import file_source, kafka_source, read_source, read_topic
from streamjobs.streaming import progress, runs, sinks
from streamjobs.streaming.dedup import distinct_messages
from streamjobs.streaming.ledger import BatchLedger


@pytest.fixture()
def topic(spark, tmp_path):
    """A topic of text messages in three files, to be read one file at a time."""
    path = tmp_path / "topic"
    path.mkdir()
    for i, body in enumerate(["a b\na\n", "b c\n", "a\n"]):
        (path / f"{i}.txt").write_text(body)
    return str(path)


def one_by_one(path, **options):
    return file_source(path, "text", maxFilesPerTrigger="1", **options)


def test_word_count_over_batches(spark, topic):
    counts = word_count(read_topic(spark, one_by_one(topic)))
    assert rows(runs.collect_complete(counts)) == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(runs.collect_update(counts, ["word"])) == [("a", 3), ("b", 2), ("c", 1)]


def test_append_and_progress(spark, topic, tmp_path):
    with progress.ProgressRecorder.on(spark, every=1) as recorder:
        out = str(tmp_path / "out")
        query = sinks.start(read_topic(spark, one_by_one(topic)), sinks.file_sink(out, "text"), name="copy", available_now=True,
                            checkpoint=str(tmp_path / "check"))
        sinks.run_for(query, 60)
        assert sorted(r[0] for r in spark.read.text(out).collect()) == ["a", "a", "a b", "b c"]
        table = progress.progress_table(recorder, query)
        assert table.agg(F.sum("input_rows")).first()[0] == 4
        assert table.filter("trigger_execution IS NOT NULL").count() == table.count() >= 3


def test_no_progress_record_is_lost(spark, tmp_path):
    """More triggers than Spark itself keeps, in the order of the batches, without the first one in the mean."""
    for i in range(130):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i:03d}.txt").write_text(f"line {i}\n")
    with progress.ProgressRecorder.on(spark) as recorder:
        query = sinks.start(read_topic(spark, one_by_one(str(tmp_path / "in"))), sinks.file_sink(str(tmp_path / "out"), "text"),
                            available_now=True)
        query.awaitTermination()
        table = progress.progress_table(recorder, query).cache()
        assert rows(table.filter("input_rows > 0").select("batch_id")) == sorted([(i,) for i in range(130)], key=repr)
        stats, spans = trigger_stats(table).first(), [r[0] for r in table.orderBy("batch_id").select("trigger_execution").collect()]
        assert stats["n_triggers"] == len(spans) and abs(stats["steady_ms"] - sum(spans[1:]) / (len(spans) - 1)) < 1e-6


def test_restart_goes_on_from_the_checkpoint(spark, topic, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for extra in (None, "new\n"):
        if extra:
            (tmp_path / "topic" / "9.txt").write_text(extra)
        sinks.start(read_topic(spark, one_by_one(topic)), sinks.file_sink(out, "text"), checkpoint=check,
                    available_now=True).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["a", "a", "a b", "b c", "new"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    # A row is late against the watermark that the batch before the last one has left behind.
    for i, (key, second) in enumerate([("a", 100_000), ("b", 200_000), ("b", 200_000), ("late", 100_000), ("c", 300_000)]):
        file = path / f"{i}.json"
        file.write_text(json.dumps({"key": key, "s": second}))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)  # files are read in the order of their times
    source = file_source(str(path), "json", spark.createDataFrame([], "key string, s long").schema, maxFilesPerTrigger="1")
    events = read_source(spark, source).withColumn("ts", F.timestamp_seconds("s")).withWatermark("ts", "10 minutes")
    averaged = sliding_avg(events, "ts", "s", ["key"], "30 minutes", "10 minutes")
    with progress.ProgressRecorder.on(spark) as recorder:
        query = sinks.start(averaged, sinks.file_sink(str(tmp_path / "out")), checkpoint=str(tmp_path / "c"), available_now=True)
        query.awaitTermination()
        assert progress.progress_table(recorder, query).agg(F.sum("late_rows")).first()[0] > 0
    keys = {r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert keys == {"a", "b"}


def test_distinct_messages(spark, tmp_path):
    df = spark.createDataFrame([("01", "1", 10), ("01", "1", 20), ("01", "2", 30), ("02", "1", 10)], "p string, m string, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    assert distinct_messages(df, ["p", "m"]).count() == 3
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = runs.collect_append(distinct_messages(stream, ["p", "m"], "ts", "1 hour").select("p", "m"))
    assert rows(got) == [("01", "1"), ("01", "2"), ("02", "1")]


def test_port_statistics_of_a_large_flow(spark):
    lines = [f"1,1,1,{i % 25_000},a,b,6,1,443,1,x" for i in range(30_000)] + ["bad"]
    pkts = ports.packets(spark.createDataFrame([(v,) for v in lines], "value string"))
    for stats in (ports.statistics(pkts), ports.running_statistics(pkts)):
        assert rows(ports.lines(stats.filter("nodeID = 1"))) == [
            (" Producer Node: 1 user: 1 flow ID: 1 destination Port: 443 total packets: 30000",)]
    ids = ports.packet_ids(pkts)
    assert ids.count() == 25_000
    assert ports.id_lines(ids.filter("pktCount = 7")).first()["value"].endswith(" destination Port: 443 packet ID: 7")


def test_state_of_old_windows_goes(spark, tmp_path):
    """Flows of past days leave the state of a stream with a watermark, and one total comes per flow."""
    for day in range(1, 6):
        lines = [(f"1,{u},1,{i},a,b,6,1,443,1,x", f"2024-01-{day:02d} 10:00:00") for u in range(20) for i in range(3)]
        df = spark.createDataFrame(lines, "value string, t string").withColumn("t", F.to_timestamp("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = ports.running_statistics(ports.packets(stream, ["t"]), "t", "1 hour")
    with progress.ProgressRecorder.on(spark) as recorder:
        sinks.start(counts, sinks.file_sink(str(tmp_path / "out")), "append", name="flows", available_now=True).awaitTermination()
        state = [r["state_rows"] for r in progress.progress_table(recorder, "flows").orderBy("batch_id").collect()]
    assert max(state) <= 40 and spark.read.parquet(str(tmp_path / "out")).filter("totalPkts <> 3").isEmpty()


def test_vessel_reports(spark):
    messages = ['{"type":5,"mmsi":7,"destination":"X","shiptype":60}', '{"type":5,"mmsi":7,"destination":"X","shiptype":60}',
                '{"type":"5","mmsi":8,"destination":"X","shiptype":60}', '{"type":1,"mmsi":9}', '{"type":"text"}', "broken"]
    df = spark.createDataFrame([(m, 0) for m in messages], "value string, s long").withColumn("t", F.timestamp_seconds("s"))
    got = vessels.ships(vessels.voyage_reports(df, "t"))
    assert rows(got.select("destination", "shiptype", "numberOfShips")) == [("X", "60", 2)]
    ids = vessels.running_ship_ids(vessels.voyage_reports(df, "t"))
    assert sorted(r["mmsi"] for r in ids.collect()) == ["7", "8"]
    assert vessels.ships_approx(vessels.voyage_reports(df, "t")).first()["n_items"] == 2
    now = vessels.voyage_reports(df)
    assert now.count() == 3 and dict(now.dtypes)["timestamp"] == "timestamp"
    assert len(vessels.FIELDS) == 47


def test_kafka_options():
    source = kafka_source("h:9092", topics="a,b", starting="latest")
    assert source.options == {"kafka.bootstrap.servers": "h:9092", "startingOffsets": "latest", "failOnDataLoss": "false",
                              "subscribe": "a,b"}
    assert kafka_source("h:9092", pattern="topic-.*").options["subscribePattern"] == "topic-.*"
    with pytest.raises(ValueError):
        kafka_source("h:9092")


def test_rate_messages(spark):
    from streamjobs.sources.generators import rate_messages

    stream = rate_messages(spark, 10, 3, 12)
    assert stream.isStreaming and stream.columns == ["timestamp", "value"]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from streamjobs import session

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    monkeypatch.setattr(Session.conf, "get", staticmethod(lambda key, default: "s3://bucket/check/"))
    assert session.shared_dir(Session()) == "s3://bucket/check"


def test_a_batch_counts_once(spark, tmp_path):
    ledger = BatchLedger(spark, str(tmp_path / "l"))
    one, two = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(2,)], "i int")
    assert ledger.rows(one.schema).count() == 0 and ledger.last(one.schema, "a").count() == 0
    ledger.write(one, "a", 0)
    ledger.write(two, "a", 0)  # run again with other rows
    ledger.write(two, "a", 10)
    ledger.write(one, "b", 2)
    two.write.parquet(str(tmp_path / "l/rows/a/11-left"))  # a failed attempt without an entry
    assert rows(ledger.rows(one.schema)) == [(1,), (1,), (2,)] and rows(ledger.last(one.schema, "a")) == [(2,)]
    assert not ledger.commit("a", 10, "rows/elsewhere") and [e[:2] for e in ledger.entries()] == [("a", 0), ("a", 10), ("b", 2)]


def test_state_of_two_steps_falls(spark):
    """Distinct items per window in one append query: each closed window leaves both states."""
    data = [(f"2024-01-{d:02d} {h:02d}:00:00", "g", f"s{h % 5}") for d in range(1, 9) for h in range(24) for _ in range(2)]
    df = spark.createDataFrame(data, "t string, g string, ship string").withColumn("ts", F.to_timestamp("t"))
    stream = runs.arrivals(df, F.dayofmonth("ts") - 1, 8)
    counts = running_distinct_counts(stream, "ts", "6 hours", ["g"], "ship", "1 hour")
    with progress.ProgressRecorder.on(spark) as recorder:
        query = sinks.start(counts, sinks.Sink("noop"), available_now=True)
        query.awaitTermination()
        state = [r.state_rows for r in progress.progress_table(recorder, query).orderBy("batch_id").collect()]
    assert len(state) >= 8 and max(state) <= 4 * 6 * 2 and state[-1] < max(state)
    got = runs.collect_append(counts).collect()
    assert {r.n_items for r in got} == {5} and len(got) >= 30


def test_counts_are_observed_while_rows_pass(spark, topic):
    lines = progress.observed(read_topic(spark, one_by_one(topic)), "lines", all=F.lit(True), with_b=F.col("value").contains("b"))
    with progress.ProgressRecorder.on(spark, every=1) as recorder:
        query = sinks.start(lines, sinks.Sink("noop"), available_now=True)
        query.awaitTermination()
        found = [(r.observed["lines.all"], r.observed["lines.with_b"]) for r in
                 progress.progress_table(recorder, query).filter("input_rows > 0").orderBy("batch_id").collect()]
    assert sorted(found) == [(1, 0), (1, 1), (2, 1)]
