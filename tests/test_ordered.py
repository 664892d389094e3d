"""Distributed numbering, running sums and quantiles, with one key that holds most rows."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamjobs.operators import ordered, statistics
from streamjobs.operators.ranks import values_at_ranks


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small test tables would be put into a single part otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows in one key, many equal times."""
    rng = random.Random(4)
    data = [("hot" if i % 3 else f"k{rng.randrange(40)}", rng.randrange(50), i, float(rng.randrange(100)))
            for i in range(6000)]
    return data, spark.createDataFrame(data, "key string, t int, id int, v double").repartition(8)


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_row_numbers(hot):
    data, df = hot
    want = {r[2]: i for g in by_key(data).values() for i, r in enumerate(g)}
    got = {r["id"]: r["n"] for r in ordered.row_numbers(df, ["key"], ["t", "id"], "n").collect()}
    assert got == want


def test_row_numbers_without_key(hot):
    data, df = hot
    want = {r[2]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}
    got = {r["id"]: r["n"] for r in ordered.row_numbers(df, [], ["t", "id"], "n", start=1).collect()}
    assert got == want


def test_null_key_is_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "key string, id int")
    assert rows(ordered.row_numbers(df, ["key"], ["id"], "n")) == [("a", 1, 0), (None, 1, 0), (None, 2, 1)]


def test_previous_values(hot):
    data, df = hot
    want = {}
    for g in by_key(data).values():
        for before, row in zip([None, *g], g):
            want[row[2]] = before[3] if before else None
    got = {r["id"]: r["p"] for r in ordered.previous_values(df, ["key"], ["t", "id"], "v", "p").collect()}
    assert got == want


def test_previous_value_may_be_null(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(40)], "id int, v int").repartition(8)
    got = {r["id"]: r["p"] for r in ordered.previous_values(df, [], ["id"], "v", "p").collect()}
    assert got == {i: None if i == 0 or (i - 1) % 2 else i - 1 for i in range(40)}


def test_running_totals(hot):
    data, df = hot
    want = {}
    for g in by_key(data).values():
        total = 0.0
        for row in g:
            total += row[3]
            want[row[2]] = total
    got = {r["id"]: r["s"] for r in ordered.running_totals(df, ["key"], ["t", "id"], "v", "s").collect()}
    assert got == want


def test_hot_key_is_cut_into_parts(hot):
    _, df = hot
    parts = ordered.range_parts(df, ["key", "t", "id"])
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 6000 / 2


def test_quantiles(hot):
    data, df = hot
    got = {r["key"]: r for r in statistics.quantiles(df, "v", {"a": 0.25, "b": 0.9}, ["key"]).collect()}
    for key, group in by_key(data).items():
        values = [r[3] for r in group]
        assert got[key]["a"] == pytest.approx(np.quantile(values, 0.25))
        assert got[key]["b"] == pytest.approx(np.quantile(values, 0.9))
        assert got[key]["n_rows"] == len(values)


def test_histogram_against_numpy(hot):
    data, df = hot
    values = [r[3] for r in data]
    counts, edges = np.histogram(values, 28)
    density, _ = np.histogram(values, 28, density=True)
    got = statistics.histogram(df, "v").orderBy("bin").collect()
    assert [r["n_rows"] for r in got] == list(counts)
    assert [r["low"] for r in got] == pytest.approx(list(edges[:-1]))
    assert [r["density"] for r in got] == pytest.approx(list(density))
    assert got[-1]["share"] == 1.0


def test_histogram_of_one_value_and_of_none(spark):
    one = statistics.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), "v", 4)
    assert [r["n_rows"] for r in one.orderBy("bin").collect()] == [0, 0, 2, 0]
    assert statistics.histogram(spark.createDataFrame([], "v double"), "v", 4).count() == 0


def test_kde_against_numpy(hot):
    data, df = hot
    values = np.array([r[3] for r in data])
    h = values.std(ddof=1) * len(values) ** -0.2
    got = statistics.kde(df, "v", 20).orderBy("point").collect()
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want)


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("b", None)], "s string, v double")
    a, b = statistics.box_stats(df, "v", ["s"]).orderBy("s").collect()
    assert (a["median"], a["whisker_low"], a["whisker_high"], a["n_outliers"], a["n_rows"]) == (3.5, 1.0, 5.0, 1, 6)
    assert (b["q1"], b["q3"], b["n_outliers"]) == (7.0, 7.0, 0)


def test_numbers_by_split(spark, tmp_path):
    """Lines of split files, of which some are dropped, are numbered in the order of the file."""
    from streamjobs.sources import logs

    for f in (1, 2):
        (tmp_path / f"s{f}.log").write_text("".join(f"{i} {'x' * (i % 70)}\n" for i in range(2000 * f)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "15000")
    try:
        lines = logs.read_lines(spark, str(tmp_path)).withColumn("i", F.split("value", " ")[0].cast("long")).filter("i % 3 <> 1")
        numbered = ordered.numbers_by_split(lines, ["file"], "n", start=1)
        assert "rangepartitioning" not in numbered._jdf.queryExecution().toString()
        got = {(r["file"][-6:-4], r["i"]): r["n"] for r in numbered.collect()}
        assert lines.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"s{f}", i): n for f in (1, 2) for n, i in enumerate((i for i in range(2000 * f) if i % 3 != 1), 1)}


def test_outliers(spark):
    df = spark.createDataFrame([(None, v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 100.0, None, float("nan"))], "s string, v double")
    assert rows(statistics.outliers(df, "v", ["s"])) == []
    df = spark.createDataFrame([(None, v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0, 100.0, None)], "s string, v double")
    assert rows(statistics.outliers(df, "v", ["s"])) == [(None, 100.0, 2)]


@pytest.mark.parametrize("kind", ["crowded", "huge", "tiny", "equal", "infinite", "even"])
def test_values_at_ranks(spark, kind):
    rng = np.random.default_rng(7)
    values = {"crowded": [1e300, -1e300, *rng.random(500)], "huge": [*(10.0 ** rng.integers(-300, 300, 400)), -1e308, 1.7e308],
              "tiny": [5e-324, 1e-323, 0.0, -0.0, 1e-300, 1.0, *(rng.random(200) * 1e-310)], "equal": [3.5] * 900,
              "infinite": [float("inf"), float("inf"), float("-inf"), 1.7976931348623157e308, 1.0, 2.0], "even": list(map(float, range(3000)))}[kind]
    ranks = {f"r{k}": k for k in {0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1}}
    df = spark.createDataFrame([("g", float(v)) for v in values] + [(None, 1.0), (None, None), ("e", None), ("n", float("nan"))], "k string, v double")
    found = {r["k"]: r for r in values_at_ranks(df.repartition(5), "v", ["k"], {n: F.least(F.lit(k), F.col("n_rows") - 1) for n, k in ranks.items()}).collect()}
    assert set(found) == {"g", None} and found[None]["r0"] == 1.0
    assert [found["g"][n] for n in ranks] == [sorted(map(float, values))[k] for k in ranks.values()] and found["g"]["n_rows"] == len(values)


def test_quantiles_sort_no_rows(spark, hot):
    plan = statistics.quantiles(hot[1], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
    assert statistics.quantiles(hot[1].limit(0), "v", {"m": 0.5}).count() == 0
    assert statistics.quantiles(hot[1], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median([r[3] for r in hot[0]]))


def test_cdf(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (4.0,), (None,)], "v double")
    assert rows(statistics.cdf(df, "v")) == [(1.0, 2, 0.5), (3.0, 1, 0.75), (4.0, 1, 1.0)]


def test_describe_and_correlation(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "a int, b double")
    got = {r["column"]: r for r in statistics.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["q50"], got["a"]["std"]) == (3, 2.0, 2.0, 1.0)
    assert (got["b"]["n"], got["b"]["q25"]) == (2, 2.5)
    assert statistics.cross_corr(df, ["a"], ["b"]).first()["corr"] == pytest.approx(1.0)


def test_line_order_of_a_split_file(spark, tmp_path):
    from streamjobs.sources import logs

    path = tmp_path / "cons-node3-instance1.log"
    path.write_text("".join(f"line {i} {'x' * 50}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3
        numbered = ordered.row_numbers(lines, ["file"], ["line_key"], "n")
        got = {r["n"]: r["value"].split(" ")[1] for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: str(i) for i in range(3000)}
    assert lines.select("node_id", "instance_id").first() == (3, 1)
