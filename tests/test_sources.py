import random
from hashlib import sha256

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from streamjobs.functions.randoms import hash_text
from streamjobs.functions.scalar import format_log_time
from streamjobs.operators import tree_training
from streamjobs.operators.ml import fit_state_models, test_r2 as r2_table
from streamjobs.plans import fraud, reports
from streamjobs.plans import ride_tips as rides
from streamjobs.sources import files, generators, logs
from streamjobs.streaming.sinks import write_csv, write_partitioned


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


T = "2024-01-01 00:00:0"


def test_producer_and_confirmations(spark):
    df = lines(spark, T + "0,001 INFO:Topic-name: topic-3; Message ID: 000007; Message: a; Topic-name: x",
               T + "1,000 INFO:Produced message ID: 000007; Value: 1", T + "1,000 INFO:Message not produced. ID: 000008; Error: e",
               "garbage", "", T + "0,001 INFO:Topic-name: topic")
    got = logs.parse_producer(df).withColumn("t", format_log_time(F.col("produced_ts"))).drop("produced_ts")
    assert rows(got) == [("3", "000007", T + "0,001")]
    assert rows(logs.parse_confirmations(df)) == [("000007", 1), ("000008", 0)]


def test_consumer(spark):
    df = lines(spark, T + "2,500 INFO:Prod ID: 01; Message ID: 000007; Latest: True; Topic: topic-3; Offset: 12; Size: 20",
               T + "2,500 WARNING:ProdID 01 MSG 000007 Topic topic-3 already read. Not logging.")
    got = logs.parse_consumer(df)
    assert rows(got.drop("consumed_ts")) == [("01", "000007", "3", 12)]
    assert got.first()["consumed_ts"].microsecond == 500000


def test_coordinator_and_leader(spark):
    df = spark.createDataFrame([
        (1, "x INFO:Group coordinator for group-1 is BrokerMetadata(nodeId='coordinator-2', host='h')"),
        (2, "x INFO:Group coordinator for group-1 is BrokerMetadata(nodeId='coordinator-5', host='h')"), (3, "other"),
        (4, "<h7:1> LEADING - LEADER ELECTION TOOK 3 ms"), (5, "<h8:1> LEADING - LEADER ELECTION TOOK 3 ms")], "n int, value string")
    assert rows(logs.parse_coordinators(df, [], "n")) == [("5",)]
    assert rows(logs.parse_leaders(df, [], "n")) == [("h7:1",)]


def test_packets_and_aggregates(spark):
    df = lines(spark, T + "1,000 INFO:Message produced: 1,2,3,4,10.0.0.1,x", T + "2,000 INFO:Message received: 1,2,3,4,x")
    assert rows(logs.parse_packets(df, "produced").drop("produced_ts")) == [(1, 2, 3, 4)]
    df = lines(spark, T + "5,000 INFO:Message received:  Producer Node: 1 user: 2 flow ID: 3 destination Port: 443 total packets: 2 packet IDs: 4,5",
               T + "3,000 INFO:Message received:  Producer Node: 1 user: 2 flow ID: 3 destination Port: 443 total packets: 1 packet IDs: 4")
    got = logs.parse_aggregates(df)
    assert [(r["pkt_id"], r["consumed_ts"].second) for r in got.orderBy("pkt_id").collect()] == [(4, 3), (5, 5)]
    sent = lines(spark, T + "1,000 INFO:Message produced: 1,2,3,4,x", T + "1,000 INFO:Message produced: 1,2,3,5,x")
    assert tuple(reports.packet_latency(sent, df, aggregated=True).first()) == (2, 3000.0)


def test_progress(spark):
    df = lines(spark, "x INFO:{'durationMs': {'addBatch': 1, 'getBatch': 2, 'latestOffset': 3, 'queryPlanning': 4, "
                      "'triggerExecution': 50, 'walCommit': 6}, 'y': 1}", "{'durationMs': {'triggerExecution': 7}}", "none")
    assert rows(logs.parse_progress(df)) == [(1, 2, 3, 4, 50, 6), (None, None, None, None, 7, None)]


def test_port_counter_files(spark, tmp_path):
    dump = ("OFPST_PORT reply (xid=0x2): 3 ports\n"
            "  port LOCAL: rx pkts=1, bytes=2, drop=0\n           tx pkts=3, bytes=4, drop=0\n")
    for i in range(3):
        for port in (1, 12):
            dump += (f"  port {port:2d}: rx pkts={10 * i + port}, bytes={1000 * i}, drop=0, errs=0\n"
                     f"           tx pkts={i}, bytes={500 * i}, drop=0\n")
    (tmp_path / "bandwidth-log4.txt").write_text(dump)
    got = reports.bandwidth_report(spark, str(tmp_path / "bandwidth-log*.txt"))
    assert rows(got.select("switch", "port", "sample", "rx_pkts", "rate")) == [
        (4, 1, 0, 1, 0.0), (4, 1, 1, 11, 200.0), (4, 1, 2, 21, 200.0),
        (4, 12, 0, 12, 0.0), (4, 12, 1, 22, 200.0), (4, 12, 2, 32, 200.0)]


def test_series_and_process_metrics(spark, tmp_path):
    (tmp_path / "1-1-cpu.log").write_text("1.5 us\n2.5 us\n3\n")
    got = reports.resource_series(spark, str(tmp_path / "*.log"))
    assert rows(got.select("time_s", "reading")) == [(0.5, 1.5), (1.0, 2.5), (1.5, 3.0)]
    got = logs.parse_process_metrics(lines(spark, "2024-01-01 00:00:00.5, CPU: 12.5%, Memory: 33.25 MB", "x"))
    assert rows(got.select("cpu", "mem")) == [(12.5, 33.25)]
    assert rows(logs.parse_integers(lines(spark, "3", " 4 ", "x", ""))) == [(3,), (4,)]


def test_latency_round_trip(spark, tmp_path):
    for name, text in (("prod/prod-node1-instance1.log", T + "1,000 INFO:Topic-name: topic-0; Message ID: 000000; Message: a\n"),
                       ("cons/cons-node3-instance1.log", T + "0,500 INFO:Prod ID: 01; Message ID: 000000; Latest: True; Topic: "
                                                             "topic-0; Offset: 1; Size: 9\n"),
                       ("cons/cons-node4-instance1.log", "2024-01-02 02:00:01,250 INFO:Prod ID: 01; Message ID: 000000; Latest: True; "
                                                         "Topic: topic-0; Offset: 1; Size: 9\n")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    got = reports.message_latency(spark, str(tmp_path / "prod"), str(tmp_path / "cons"))
    assert rows(got.select("consumer_id", "latency_s")) == [(3, -0.5), (4, 93600.25)]
    text = reports.latency_lines(got)
    assert any(r["value"].endswith("Latency of this message: 26:00:00.250000") for r in text.collect())
    back = logs.parse_latency(text.select("value"))
    assert rows(back.select("consumer_id", "latency_s")) == [("3", -0.5), ("4", 93600.25)]
    assert rows(logs.parse_latency(text.select("value"), trunc=True).select("latency_s")) == [(-0.0,), (93600.0,)]


def test_message_sources(spark, tmp_path):
    for i, body in enumerate(["x", "y\nz"]):
        (tmp_path / f"f{i}.txt").write_text(body)
    got = files.files_to_messages(spark, str(tmp_path / "f*.txt"), "t")
    assert rows(got.select("value")) == [("x Topic: t File: 1",), ("y\nz Topic: t File: 2",)]
    assert files.lines_to_messages(spark, str(tmp_path / "f1.txt"), 3).count() == 6
    assert rows(files.replay_file(spark, str(tmp_path / "f0.txt"), 2)) == [(1, "xrrrr 1"), (2, "xrrrr 2")]


def test_experiment_files(spark, tmp_path):
    df = spark.createDataFrame([(4, "gzip", 1.5), (5, None, None)], "index int, kind string, v double")
    write_csv(df, str(tmp_path / "a"))
    found = files.read_experiments(spark, [str(tmp_path / "a"), str(tmp_path / "missing")])
    assert len(found) == 1 and rows(found[0]) == [(4, "gzip", 1.5), (5, None, None)]
    assert found[0].columns == ["run_index", "kind", "v"]
    write_partitioned(df, str(tmp_path / "p"), ["kind"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    (tmp_path / "c.json").write_text('[{"MBean":"b","ObjectName":"o","Values":[{"Type":"gauge","InstancePrefix":"m","Table":false,'
                                     '"Attribute":"A"},{"Type":"counter","InstancePrefix":"n","Table":false,"Attribute":"B"}]}]')
    assert rows(files.metric_catalogue(spark, str(tmp_path / "c.json"))) == [("b", "o", "counter", "n", "B"), ("b", "o", "gauge", "m", "A")]
    box = spark.createDataFrame([("0:00:01.5", "0:00:02"), (None, "0:00:03")], "`100ms` string, `500ms` string")
    assert rows(files.read_box_settings(box)) == [("100ms", 1.5), ("500ms", 2.0)]


def test_plain_scans(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,T,2.5,a,1,1,b,1,1,0,0\nx,T,bad,a,1,1,b,1,1,0,0\n")
    got = files.read_csv(spark, str(tmp_path / "p.csv"), fraud.PAYMENT)
    assert rows(got.select("step", "amount")) == [(1, 2.5), (None, None)]
    (tmp_path / "n.jsonl").write_text('{"name":"a","coord":[[1,2.5],[3,4]]}\n')
    got = files.read_json_lines(spark, str(tmp_path / "n.jsonl"))
    assert got.first()["coord"] == [[1.0, 2.5], [3.0, 4.0]]


def test_runs(spark):
    from streamjobs.plans import runs

    knobs = spark.createDataFrame([("a", 1, 10), (runs.COMPRESSION_KNOB, 1, 4)], "knob string, min int, max int")
    schedule = runs.knob_schedule(spark.range(20).withColumnRenamed("id", "run_index"), knobs, 3)
    assert schedule.count() == 20 and schedule.agg(F.min("a"), F.max("a")).first() == (1, 10)
    results = spark.createDataFrame([(0, 1.0), (1, 1.0), (25, 2.0)], "run_index long, v double")
    audit = {k: [r["run_index"] for r in t.collect()] for k, t in runs.audit(schedule, results).items()}
    assert audit == {"missing": list(range(2, 20)), "unplanned": [25], "repeated": [1], "pending": []}
    states = spark.createDataFrame([(0, 1, 5, 1.0), (0, 2, 5, 2.0), (1, 1, 5, 3.0)], "run_index long, t int, same int, v double")
    coded, last = runs.prepare(schedule, states, ["t"])
    assert {r[0] for r in coded.select(f"`{runs.COMPRESSION_KNOB}`").distinct().collect()} == {0, 1, 2, 3}
    assert rows(last) == [(0, 2, 2.0), (1, 1, 3.0)]
    assert runs.rows_of(schedule, results).count() == 2


def test_generators(spark):
    xml = spark.createDataFrame([(i, "<a>12</a>\n<b>3 45</b>") for i in range(50)], "id int, value string")
    whole = [r["value"] for r in generators.xml_messages(xml, "id", 1).collect()]
    per_line = [r["value"] for r in generators.xml_messages(xml, "id", 1, per_line=True).collect()]
    import re
    assert all(len(set(re.findall(r"\d+", v))) == 1 for v in whole) and len(set(whole)) > 10
    assert any(len(set(re.findall(r"\d+", v))) == 2 for v in per_line)
    assert all(1 <= int(n) <= 999 for v in whole + per_line for n in re.findall(r"\d+", v))
    sized = generators.fixed_messages(spark.range(3), "id", "id", generators.message_size(1, F.col("id"), fixed=2))
    assert [r["value"] for r in sized.collect()] == ["00000000", "01000001", "02000002"]
    flows = spark.range(60).select(F.lit(1).alias("node_id"), F.lit(2).alias("instance_id"), F.col("id").alias("flow_id"))
    packets = generators.packet_flows(flows, 5)
    per_flow = [r["count"] for r in packets.groupBy("flow_id").count().collect()]
    assert max(per_flow) <= 200 and 60 < sum(per_flow) / 60 < 140
    r = packets.first()
    assert r["value"].split(",")[:4] == ["1", "2", str(r["flow_id"]), str(r["pkt_id"])] and len(r["payload"]) == r["payload_length"]
    starts = generators.flow_starts(flows, 5).orderBy("flow_id").collect()
    assert starts[0]["start_s"] == 0 and all(b["start_s"] == a["start_s"] + a["gap_s"] for a, b in zip(starts, starts[1:]))


def test_packets_of_one_file_of_flows_are_made_by_many_tasks(spark):
    flows = spark.range(64).select((F.col("id") % 5).alias("node_id"), F.lit(1).alias("instance_id"), F.col("id").alias("flow_id"))
    packets = generators.packet_flows(flows.coalesce(1), 5)
    per_task = packets.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per_task) > 4 and max(r["n"] for r in per_task) < sum(r["n"] for r in per_task) / 2
    letters = generators.ALPHABET
    for r in packets.filter("pkt_id <= 3").collect():
        text = ""
        for block in range((r["payload_length"] - 1) // 12 + 1):
            digest = sha256(f"5p|{r['node_id']}|1|{r['flow_id']}|{r['pkt_id']}|{block}".encode()).hexdigest()
            text += "".join(letters[int(digest[i * 5:i * 5 + 5], 16) * len(letters) >> 20] for i in range(12))
        assert r["payload"] == text[:r["payload_length"]] and r["value"].endswith(f",{r['payload_length']},{r['payload']}")
    lengths = spark.createDataFrame([(None,), (-1,), (0,), (1,), (13,)], "n int")
    assert [len(r[0]) for r in lengths.select(hash_text(F.col("n"), "äb", 1, F.col("n"))).collect()] == [0, 0, 0, 1, 13]


def test_rides(spark):
    fare = lines(spark, "1,5,6,2020-01-01 00:00:00,CSH,2.5,0,10", "2,5,6,2020-01-01 00:00:00,CSH,x,0,10")
    ride = lines(spark, "1,END,2020-01-01 01:59:59,2020-01-01 00:00:00,-73.9,40.7,-73.9,40.7,1,5,6",
                 "1,START,2020-01-01 01:59:59,2020-01-01 00:00:00,-73.9,40.7,-73.9,40.7,1,5,6",
                 "2,END,2020-01-01 02:00:01,2020-01-01 00:00:00,-73.9,40.7,-73.9,40.7,1,5,6",
                 "1,END,2020-01-01 01:00:00,2020-01-01 00:00:00,-80.0,40.7,-73.9,40.7,1,5,6")
    paid = rides.paid_rides(rides.fares(fare), rides.finished_rides(ride), watermark=None)
    square = spark.createDataFrame([(1, "here", [[-74.0, 40.6], [-73.8, 40.6], [-73.8, 40.8], [-74.0, 40.8]])],
                                   "ordinal int, name string, coord array<array<double>>")
    placed = rides.with_neighbourhoods(paid, square)
    assert rows(placed.select("rideId", "stopNbhd", "startNbhd", "tip")) == [(1, "here", "here", 2.5)]
    got = rides.tips(placed)
    assert rows(got.select("stopNbhd", "avg_tip")) == [("here", 2.5)] * 3


def test_fraud(spark, tmp_path):
    from streamjobs.operators.ml import confusion, load_model, save_model

    rng = random.Random(2)
    data = []
    for i in range(600):
        bad = i % 10 == 0
        data.append((1, "T", 900.0 + rng.random() if bad else rng.random() * 100, f"o{i}", 50.0, 1.0, f"d{i}", 2.0, 3.0, int(bad), 0))
    payments = spark.createDataFrame(data, fraud.PAYMENT)
    model, held = fraud.train(payments, negative_share=0.5, max_iter=20)
    save_model(model, str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))
    messages = payments.select(F.concat_ws(",", *fraud.PAYMENT.names).alias("value"))
    bad = lines(spark, "too,few", "1,T,x,o,1,1,d,1,1,0,0")
    scored = fraud.predictions(messages.union(bad), loaded)
    assert rows(confusion(scored)) == [(0.0, 0.0, 540), (1.0, 1.0, 60)]
    assert rows(fraud.lines(scored).distinct()) == [("isFraud:  0.0  prediction:  0.0",), ("isFraud:  1.0  prediction:  1.0",)]
    assert held.count() > 0


def test_state_models(spark):
    rng = random.Random(2)
    data = [(i, x := rng.random(), rng.random(), 10 * x, 0.0, None if i % 50 == 0 else "5") for i in range(150)]
    df = spark.createDataFrame(data, "run_index int, a double, b double, load double, idle double, text string")
    fitted = fit_state_models(df, "run_index", ["a", "b"], ["load", "idle", "text"], repeats=2, folds=2, trees=5, tree_depth=4, rounds=4)
    assert list(fitted.models) == ["load", "text"]
    r2 = {r["target"]: r["test_r2"] for r in r2_table(fitted.tested).collect()}
    assert r2["load"] > 0.8
    assert 20 < fitted.tested.count() < 120 and fitted.tested.first()["cv_std"] >= 0
    scores = fitted.scores.collect()
    assert {(r.target, r.model, r.n_scores) for r in scores if r.target == "load"} == {("load", "boosting", 4), ("load", "forest", 4)}
    assert sorted(r.target for r in scores if r.chosen) == ["load", "text"]
    assert all(r.cv_r2 == max(s.cv_r2 for s in scores if s.target == r.target) for r in scores if r.chosen)


def test_best_cuts_against_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(30):
        bins, label = rng.integers(0, 5, (40, 3)).astype(np.uint8), rng.random(40)
        weight = rng.integers(0, 3, (1, 40)).astype(float)
        feature, cut, mean, left, right = tree_training.best_cuts(
            *tree_training.histograms(bins, np.zeros((1, 40), int), 0, weight, label, 5))
        w = weight[0]

        def error(rows):
            held = w[rows]
            return (held * (label[rows] - np.average(label[rows], weights=held)) ** 2).sum() if held.sum() else None

        options = {(j, c): error(bins[:, j] <= c) + error(bins[:, j] > c) for j in range(3) for c in range(4)
                   if w[bins[:, j] <= c].sum() and w[bins[:, j] > c].sum()}
        assert np.isclose(options[feature[0, 0], cut[0, 0]], min(options.values()))
        side = bins[:, feature[0, 0]] <= cut[0, 0]
        assert np.allclose([mean[0, 0], left[0, 0], right[0, 0]],
                           [np.average(label, weights=w), np.average(label[side], weights=w[side]), np.average(label[~side], weights=w[~side])])


def test_chunks_and_kept_rounds_do_not_change_the_trees(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b), [float(a + (b > 0.5)), float(b)], [i % 3, i // 3 % 3]) for i, (a, b) in enumerate(rng.random((120, 2)))]
    rows = spark.createDataFrame(data, "key long, a double, b double, labels array<double>, folds array<int>")
    cuts, sizes = [np.linspace(0.1, 0.9, 7)] * 2, tree_training.Sizes(trees=6, tree_depth=3, rounds=5, round_depth=2, bins=8)

    def trained():
        training = tree_training.Training(rows, ["a", "b"], cuts, tree_training.Fits(2, 2, 3), sizes, 4)
        training.grow()
        return training

    one = trained()
    for name, value in (("CHUNK_ROWS", 25), ("ROUNDS_KEPT", 2), ("TREES_AT_A_TIME", 4), ("PAIRED_BINS", 0)):
        monkeypatch.setattr(tree_training, name, value)
    other = trained()
    assert one.n_chunks == 1 and other.n_chunks > 3 and other.kept == 4
    for a, b in ((one.boosting, other.boosting), (one.forest, other.forest)):
        assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)
    monkeypatch.setattr(tree_training, "PAIRED_BINS", 160)
    third = trained()
    assert (one.boosting.feature == third.boosting.feature).all() and np.allclose(one.boosting.value, third.boosting.value)
    mine, theirs = ({(k, f): r for k, f, r in t.scores()} for t in (one, other))
    assert mine.keys() == theirs.keys() and len(mine) == 24 and all(np.isclose(mine[k], theirs[k]) for k in mine)
    assert min(r for (kind, f), r in mine.items() if f < 6) > 0.5
    model = one.model("forest", 0, ["a", "b"])
    model.save(spark, str(tmp_path / "m"))
    loaded = tree_training.TreeModel.load(spark, str(tmp_path / "m"))
    values = np.array([[a, b] for _, a, b, *_ in data])
    assert np.allclose(loaded.predict(values), model.predict(values))
    bins = np.stack([np.searchsorted(cuts[0], values[:, j]) for j in range(2)], 1)
    leaf = tree_training.descend(bins, one.forest.feature[6], one.forest.cut[6], 3)
    assert np.allclose(model.predict(values), np.take_along_axis(one.forest.value[6], leaf, 1).mean(0), atol=1e-6)
    assert np.allclose([r.prediction for r in loaded.transform(rows).orderBy("key").collect()], model.predict(values))


def test_whole_tables_are_trained_in_as_many_jobs_whatever_the_rounds(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(a), [float(2 * a)], [i % 2]) for i, a in enumerate(rng.random(60))]
    rows = spark.createDataFrame(data, "key long, a double, labels array<double>, folds array<int>")
    context, jobs = spark.sparkContext, []
    for rounds in (2, 30):
        training = tree_training.Training(rows, ["a"], [np.linspace(0.1, 0.9, 7)], tree_training.Fits(1, 1, 2),
                                          tree_training.Sizes(trees=3, tree_depth=3, rounds=rounds, round_depth=2, bins=8), 4)
        context.setJobGroup(f"rounds-{rounds}", "training")
        training.grow()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] and (training.boosting.feature[:, :, 0] == 0).all()


def test_chunks_of_few_cells_are_trained_in_as_many_jobs_whatever_the_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, float(a), float(b), [float(a + (b > 0.5)), float(b)], [i % 3, i // 3 % 3]) for i, (a, b) in enumerate(rng.random((1500, 2)))]
    rows = spark.createDataFrame(data, "key long, a double, b double, labels array<double>, folds array<int>")
    context, cuts = spark.sparkContext, [np.linspace(0.1, 0.9, 7)] * 2

    def trained(rounds):
        sizes = tree_training.Sizes(trees=7, tree_depth=3, rounds=rounds, round_depth=2, bins=8)
        training = tree_training.Training(rows, ["a", "b"], cuts, tree_training.Fits(2, 2, 3), sizes, 4)
        context.setJobGroup(f"cells-{training.n_chunks}-{rounds}", "training")
        training.grow()
        context.setLocalProperty("spark.jobGroup.id", None)
        return training, len(context.statusTracker().getJobIdsForGroup(f"cells-{training.n_chunks}-{rounds}"))

    (one, _), _ = trained(20), monkeypatch.setattr(tree_training, "CHUNK_ROWS", 600)
    monkeypatch.setattr(tree_training, "MERGED_CELLS", 20)
    (other, jobs), (_, few) = trained(20), trained(2)
    assert one.n_chunks == 1 and other.n_chunks >= 3 and jobs == few
    for a, b in ((one.boosting, other.boosting), (one.forest, other.forest)):
        assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)
    assert np.allclose(one.base, other.base) and (one.forest.feature[:, :, 0] >= 0).all()
    mine, theirs = ({(k, f): r for k, f, r in t.scores()} for t in (one, other))
    assert mine.keys() == theirs.keys() and len(mine) == 24 and all(np.isclose(mine[k], theirs[k]) for k in mine)


def test_trees_of_cells_are_the_trees_of_their_rows():
    rng = np.random.default_rng(6)
    bins, label, keys = rng.integers(0, 5, (3000, 3)).astype(np.uint8), rng.random(3000), rng.integers(-2 ** 63, 2 ** 63, 3000)
    cells, place = tree_training.distinct(bins)
    assert len(cells) == len({tuple(b) for b in bins}) == 125 and (cells[place] == bins).all()
    drawn = tree_training.bootstrap(keys, 4, range(3))
    seeds = np.array([4 * 1_000_003 + t for t in range(3)], np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = keys.view(np.uint64) ^ seeds
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    assert (drawn == np.searchsorted(tree_training._LAW, (x >> np.uint64(11)) / 2.0 ** 53, "right")).all()
    sums = tree_training.drawn_sums(place, len(cells), label, keys, 4, range(3))
    for tree in range(3):
        by_rows, by_cells = tree_training.Trees(1, 1, 4), tree_training.Trees(1, 1, 4)
        ends = tree_training.grow_tree(by_rows, 0, bins, drawn[tree], drawn[tree] * label, 5)
        of_cells = tree_training.grow_tree(by_cells, 0, cells, sums[0, tree], sums[1, tree], 5)
        assert (by_rows.feature == by_cells.feature).all() and np.allclose(by_rows.value, by_cells.value)
        met = drawn[tree] > 0
        assert (ends[met] == of_cells[place][met]).all() and (by_rows.feature[0, 0] >= 0).sum() > 8
        assert (ends[met] == tree_training.descend(bins[met], by_rows.feature[0], by_rows.cut[0], 4)[0]).all()
    low, high = slice(0, 1000), slice(1000, 3000)
    parts = []
    for some in (low, high):
        its, at = tree_training.distinct(bins[some])
        parts.append((its, *tree_training.drawn_sums(at, len(its), label[some], keys[some], 4, range(3))))
    both = tree_training.merged(parts)
    assert (both[0] == cells).all() and np.allclose(both[1], sums[0]) and np.allclose(both[2], sums[1])


def test_state_models_make_their_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = random.Random(7)
    df = spark.createDataFrame([(i, x := rng.random(), 3 * x) for i in range(90)], "run_index int, a double, load double")
    fitted = fit_state_models(df.mapInArrow(counted, df.schema), "run_index", ["a"], ["load"], repeats=1, folds=2, trees=2,
                              tree_depth=2, rounds=2)
    assert made.value == 90 and 0 < fitted.tested.count() < 90 and made.value == 90


def test_folders_of_many_rows_are_written_by_as_many_tasks(spark, tmp_path):
    from collections import Counter

    rows_of = [*[("a", i) for i in range(600)], *[("b", i) for i in range(590)], *[(f"s{k}", k) for k in range(5)], (None, 7), (None, 7)]
    df = spark.createDataFrame(rows_of, "kind string, n int")
    write_partitioned(df, str(tmp_path / "p"), ["kind"], rows_per_file=200)
    back = spark.read.schema("n int, kind string").parquet(str(tmp_path / "p"))
    assert Counter((r["kind"], r["n"]) for r in back.collect()) == Counter(rows_of)
    per_task = back.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per_task) == 6 and max(r["n"] for r in per_task) < 300
    write_partitioned(df.limit(0), str(tmp_path / "e"), ["kind"])
    assert spark.read.schema("n int, kind string").parquet(str(tmp_path / "e")).count() == 0
