import random

from conftest import rows
from pyspark.sql import functions as F

from streamjobs.operators import aggregates, delivery, experiments, latency, network, progress, sets
from streamjobs.operators.sampling import balance, latin_hypercube, unit_hypercube


def test_every_item_once(spark):
    data = [("hot", i % 700) for i in range(3000)] + [("small", 1), ("small", 1), ("small", None), (None, 4)]
    df = spark.createDataFrame(data, "k string, i int")
    got = aggregates.distinct_items(df, ["k"], "i").collect()
    assert sorted(r["i"] for r in got if r["k"] == "hot") == list(range(700))
    assert sorted(map(repr, ((r["k"], r["i"]) for r in got if r["k"] != "hot"))) == sorted(map(repr, [("small", 1), (None, 4)]))


def test_sets(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", None), (4, "b", None), (5, "c", 1)], "i int, s string, n int")
    assert [r[0] for r in rows(sets.duplicate_rows(df, "i"))] == [2, 4]
    assert rows(sets.keep_last(df, ["s"], ["i"])) == [(2, "a", 1), (4, "b", None), (5, "c", 1)]
    assert [r[0] for r in rows(sets.keep_first(df, ["s"], ["i"]))] == [1, 3, 5]
    other = spark.createDataFrame([(1,), (9,), (9,)], "i int")
    assert [r[0] for r in rows(sets.missing_runs(df, other, "i"))] == [2, 3, 4, 5]
    assert rows(sets.index_differences(df, other, "i")) == [(1, "both"), (2, "first"), (3, "first"), (4, "first"),
                                                            (5, "first"), (9, "second")]
    assert [r[0] for r in rows(sets.pending_runs(df, other.filter("i < 2"), "i"))] == [2, 3, 4, 5]
    assert sets.pending_runs(df, other.limit(0), "i").count() == 5


def test_mostly_one_copied_row(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("v"))
    assert sets.duplicate_rows(df, "id").count() == 2499


def test_message_latency(spark):
    prod = spark.createDataFrame([("01", "1", "0", 10.0), ("01", "1", "0", 10.0), ("01", "2", "0", 11.0), ("01", "3", "0", 12.0)],
                                 "prod_id string, msg_id string, topic_id string, s double").select(
        "prod_id", "msg_id", "topic_id", F.timestamp_seconds("s").alias("produced_ts"))
    cons = spark.createDataFrame([(1, "01", "1", "0", 10.5), (1, "01", "1", "0", 13.0), (2, "01", "1", "0", 10.25),
                                  (1, "01", "1", "0", 10.75), (1, "01", "2", "9", 99.0), (1, "02", "3", "0", 99.0)],
                                 "consumer_id int, prod_id string, msg_id string, topic_id string, s double").coalesce(1).select(
        F.monotonically_increasing_id().alias("line_key"), "consumer_id", "prod_id", "msg_id", "topic_id", F.timestamp_seconds("s").alias("consumed_ts"))
    got = latency.message_latency(prod, cons)
    assert rows(got.select("consumer_id", "copies", "latency_s")) == [(1, 2, 0.75), (2, 2, 0.25)]
    summary = latency.latency_summary(got).first()
    assert tuple(summary) == (4, 0.5, 0.0)
    assert latency.latency_summary(got.limit(0)).first()["mean_latency_s"] is None


def test_packet_pairs_are_counted_not_formed(spark):
    packet = "node_id int, instance_id int, flow_id int, pkt_id int, s double"
    prod = spark.createDataFrame([(1, 1, 1, 1, 0.0), (1, 1, 1, 1, 1.0), (1, 1, 1, 2, 5.0)], packet).select(
        *latency.PACKET, F.timestamp_seconds("s").alias("produced_ts"))
    cons = spark.createDataFrame([(1, 1, 1, 1, 2.0), (1, 1, 1, 1, 3.0), (1, 1, 1, 1, 4.0), (1, 1, 1, 7, 4.0)], packet).select(
        *latency.PACKET, F.timestamp_seconds("s").alias("consumed_ts"))
    pairs = [c - p for p in (0, 1) for c in (2, 3, 4)]
    got = latency.mean_packet_latency(prod, cons).first()
    assert (got["n_pairs"], got["mean_latency_ms"]) == (6, 1000 * sum(pairs) / 6)
    none = latency.mean_packet_latency(prod, cons.limit(0)).first()
    assert (none["n_pairs"], none["mean_latency_ms"]) == (0, None)


def test_throughput_of_one_line(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 2.0, 2), (1, 4.0, 3), (2, 5.0, 1)], "consumer_id int, s double, line_no int")
    df = df.withColumn("consumed_ts", F.timestamp_seconds("s"))
    got = latency.consumer_throughput(df)
    assert rows(got.select("consumer_id", "n_messages", "messages_per_s")) == [(1, 3, 0.75), (2, 1, None)]
    assert tuple(latency.total_throughput(got).first()) == (2, 4, 0.75)


def test_delivery_with_many_consumers(spark):
    consumers = list(range(1, 151))
    prod = spark.createDataFrame([("01", "000000", "1"), ("01", "000001", "2"), ("01", "000002", "0")],
                                 "prod_id string, msg_id string, topic_id string")
    got = [("01", "000000", c) for c in consumers if c % 3] + [("01", "000000", 1)] * 4 + [("01", "000002", 150), ("09", "000000", 3)]
    cons = spark.createDataFrame(got, "prod_id string, msg_id string, consumer_id int")
    conf = spark.createDataFrame([("01", "000002", 0), ("01", "000000", 1)], "prod_id string, msg_id string, confirmed int")
    everyone = spark.createDataFrame([(c,) for c in consumers] + [(7,), (None,)], "consumer_id int")
    words = delivery.delivery_words(prod, cons, everyone, conf)
    missing = rows(delivery.undelivered(words))
    assert missing == sorted([("01", "000000", "1", c) for c in consumers if c % 3 == 0] + [("01", "000001", "2", c) for c in consumers], key=repr)
    assert rows(delivery.inconsistent(words)) == [("01", "000002", "0", 150)]
    assert delivery.undelivered(words, max_index=1).count() == 50
    matrix = delivery.delivery_matrix(words, 3)
    assert matrix.count() == 450
    cells = {(r["msg_id"], r["consumer_id"]): r["cell"] for r in matrix.collect()}
    assert (cells["000000", 1], cells["000000", 3], cells["000001", 9], cells["000002", 9]) == (255, 85, 170, 255)
    counts = {(r["topic_id"], r["consumer_id"]): tuple(r)[2:] for r in delivery.delivery_counts(words).collect()}
    assert (counts["1", 3], counts["1", 4], counts["0", 150], counts["0", 149]) == ((1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 0, 1), (1, 0, 0, 1))


def test_delivery_of_ids_of_every_form(spark):
    """Words of 64 keep first and last bit, zeros in front, letters and ids without digits apart; a message counts for one topic."""
    rng = random.Random(6)
    ids = [*map(str, range(130)), *(f"{i:04d}" for i in range(0, 300, 7)), "a1", "a63", "a64", "b", "", "9" * 15, "x" + "1" * 20]
    sent = [(p, m, t) for p in ("p", "q") for m in ids for t in rng.sample(["3", "1", "x"], rng.randint(1, 2))] + [(None, "1", "1"), ("p", None, "1")]
    got = [(p, m, c) for p in ("p", "q") for m in ids for c in (1, 2, 3) if rng.random() < 0.6]
    prod = spark.createDataFrame(sent, "prod_id string, msg_id string, topic_id string")
    cons = spark.createDataFrame(got * 2, "prod_id string, msg_id string, consumer_id int")
    topics = {}
    for p, m, t in sent:
        if p and m is not None:
            topics.setdefault((p, m), []).append(t)
    topic = {k: min((t for t in v if t != "x"), default=None) for k, v in topics.items()}
    want = [(*k, t, c) for k, t in topic.items() for c in (1, 2, 3) if (*k, c) not in set(got)]
    words = delivery.delivery_words(prod, cons, cons)
    assert rows(delivery.undelivered(words)) == sorted(want, key=repr)
    assert delivery.delivery_matrix(words, 5).count() == 3 * len(topic)
    assert delivery.delivery_words(prod.limit(0), cons, cons).count() == 0 and delivery.inconsistent(words).count() == 0


def test_sketches_merge(spark):
    """Hours and all groups from the sketches of minutes; few items exactly, many within four standard errors."""
    few = [(t, g, f"{g}{t % 97}") for g in "ab" for t in range(0, 7200, 9)]
    many = spark.range(40_000).select((F.col("id") % 3600).alias("t"), F.lit("m").alias("g"), (F.col("id") % 30_000).cast("string").alias("i"))
    df = spark.createDataFrame(few, "t long, g string, i string").union(many).withColumn("ts", F.timestamp_seconds("t"))
    sketches = aggregates.windowed_sketches(df, "ts", "1 minute", ["g"], "i")
    hours = {(r["window_start"].hour, r["g"]): r["n_items"] for r in aggregates.merged_counts(sketches, "1 hour", ["g"]).collect()}
    assert {k: v for k, v in hours.items() if k[1] != "m"} == {
        (h, g): len({i for t, k, i in few if k == g and t // 3600 == h}) for g in "ab" for h in (0, 1)}
    assert abs(hours[0, "m"] / 30_000 - 1) < 4 * 1.04 / 2 ** 7
    assert {r["n_items"] for r in aggregates.merged_counts(sketches.filter("g <> 'm'"), "1 day", []).collect()} == {194}


def test_message_lookup_takes_the_first(spark):
    prod = spark.createDataFrame([("01", "000001", "5", 2.0), ("01", "000001", "4", 1.0)],
                                 "prod_id string, msg_id string, topic_id string, s double").select(
        "prod_id", "msg_id", "topic_id", F.timestamp_seconds("s").alias("produced_ts"))
    wanted = spark.createDataFrame([("01", "000001"), ("01", "000009")], "prod_id string, msg_id string")
    assert delivery.message_lookup(wanted, prod).select("topic_id").collect() == [("4",)]


def test_bandwidth(spark):
    df = spark.createDataFrame([(1, 1, 0, 100), (1, 1, 1, 600), (1, 1, 2, 1100), (2, 1, 0, 50), (2, 1, 1, 100), (3, 1, 0, 7)],
                               "switch int, port int, sample int, rx_bytes long")
    rates = network.counter_rate(df, ["switch", "port"], ["sample"], "rx_bytes")
    want = [(1, 1, 0, 100, 0.0), (1, 1, 1, 600, 100.0), (1, 1, 2, 1100, 100.0), (2, 1, 0, 50, 0.0), (2, 1, 1, 100, 10.0),
            (3, 1, 0, 7, 0.0)]
    assert rows(rates) == want
    assert rows(network.counter_rate_by_sample(df, ["switch", "port"], "rx_bytes").select(*rates.columns)) == want
    assert rows(network.sum_series(rates, [(1, 1), (2, 1)])) == [(0, 0.0), (1, 110.0), (2, 100.0)]
    assert rows(network.sum_series(rates, [(2, 1), (1, 1)])) == [(0, 0.0), (1, 110.0)]
    assert rows(network.sum_series(rates, [(1, 1), (2, 1)], first_port_only=True)) == [(0, 0.0), (1, 100.0), (2, 100.0)]
    assert network.port_bandwidth(rates, ["switch"]).filter("switch = 1").first()["max_rate"] == 100.0


def test_trigger_statistics(spark):
    df = spark.createDataFrame([(0, 900, 100, 5), (1, 100, 10, None), (2, 200, 20, 7)],
                               "batch_id int, trigger_execution int, wal_commit int, query_planning int")
    df = df.withColumns({c: F.lit(1) for c in ("add_batch", "get_batch", "latest_offset")})
    assert tuple(progress.trigger_stats(df).first()) == (3, 100.0, 150.0)
    # Two planning triggers: 900+100+5+3 and 200+20+7+3 ms in all phases; 200-20 ms without the first.
    assert tuple(progress.planning_stats(df).first()) == (2, 180.0, 1008 + 230)
    assert progress.trigger_stats(df.limit(1)).first()["steady_ms"] is None


def test_metrics(spark):
    samples = spark.createDataFrame(
        [(1, "h1", 1, "cpu", "gauge", None, 2.0), (1, "h1", 2, "cpu", "gauge", None, 4.0), (1, "h1", 3, "cpu", "gauge", None, 0.0),
         (1, "h1", 1, "gc", "counter", None, 5.0), (1, "h1", 2, "gc", "counter", None, 9.0), (1, "h1", 3, "gc", "counter", None, None),
         (1, "h1", 1, "heap", "gauge", "used", 7.0), (2, "h1", 1, "cpu", "gauge", None, 0.0)],
        "run_index int, host string, ts int, metric string, kind string, attribute_key string, value double")
    got = experiments.metrics_rollup(samples, ["cpu", "gc", "heap_used", "none"])
    assert rows(got) == [(1, "h1", 3.0, 9.0, 7.0, None), (2, "h1", None, None, None, None)]
    kept = experiments.metrics_rollup(samples, ["cpu"], drop_zero=False)
    assert rows(kept) == [(1, "h1", 2.0), (2, "h1", 0.0)]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5, None, 1, "x"), (2, 5, None, None, "x")], "run_index int, same int, allnull int, half int, s string")
    assert experiments.drop_constant(df).columns == ["run_index", "allnull", "half"]
    assert experiments.drop_constant(df, keep=["s"]).columns == ["run_index", "allnull", "half", "s"]
    assert experiments.nonzero_columns(df, ["same", "allnull", "s"]) == ["same"]
    assert experiments.drop_constant(df.limit(0)).columns == []


def test_hypercube_has_one_point_per_stratum(spark):
    n = 500
    unit = unit_hypercube(spark.range(n).repartition(5), "id", ["a", "b"], 3).collect()
    for d in ("a", "b"):
        assert sorted(int(r[d] * n) for r in unit) == list(range(n))
    assert [r["a"] for r in unit] != [r["b"] for r in unit]
    knobs = latin_hypercube(spark.range(40), "id", [("size", 1, 8), ("kind", 1, 4)], 3, options={"kind": ["None", "gzip", "snappy", "lz4"]})
    counts = knobs.groupBy("kind").count().collect()
    assert sorted(r["count"] for r in counts) == [10] * 4
    assert sorted(r["count"] for r in knobs.groupBy("size").count().collect()) == [5] * 8


def test_balance_keeps_all_positives(spark):
    df = spark.range(10_000).withColumn("label", (F.col("id") % 100 == 0).cast("int"))
    got = balance(df, "label", 0.05, 1, ["id"])
    assert got.filter("label = 1").count() == 100
    assert 400 < got.filter("label = 0").count() < 600
    assert rows(got) == rows(balance(df.repartition(7), "label", 0.05, 1, ["id"]))
