import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from streamjobs.operators.joins import assign_region, assign_region_by_cell, interval_join, region_cells
from streamjobs.streaming.runs import collect_append

START = 1_700_000_000

REGIONS = [(1, "triangle", [[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]]),
           (2, "star", [[2.0, 5.0], [2.6, 3.2], [4.5, 3.2], [3.0, 2.1], [3.6, 0.2], [2.0, 1.4], [0.4, 0.2],
                        [1.0, 2.1], [-0.5, 3.2], [1.4, 3.2]]),
           (3, "square", [[3.0, 3.0], [6.0, 3.0], [6.0, 6.0], [3.0, 6.0], [3.0, 3.0]]),
           (4, "empty", [])]


def contains(x, y, corners):
    """Number of edges crossed by a ray to the right is odd."""
    crossed = 0
    for (x1, y1), (x2, y2) in zip(corners, corners[-1:] + corners[:-1]):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            crossed += 1
    return crossed % 2 == 1


def first_region(x, y):
    return next((n for _, n, c in REGIONS if contains(x, y, c)), "Other")


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-2, 7), rng.uniform(-2, 7)) for _ in range(800)]
    # corners, edges and a grid that meets both
    pts += [(float(a), float(b)) for _, _, c in REGIONS for a, b in c] + [(i / 2, j / 2) for i in range(-2, 14) for j in range(-2, 14)]
    data = [(i, x, y) for i, (x, y) in enumerate(pts)] + [(10_000, None, 1.0)]
    return data, spark.createDataFrame(data, "id int, x double, y double")


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame(REGIONS, "ordinal int, name string, coord array<array<double>>")


def expected(data):
    return {i: "Other" if x is None else first_region(x, y) for i, x, y in data}


def test_assign_region(points, regions):
    data, df = points
    got = {r["id"]: r["region"] for r in assign_region(df, "x", "y", regions).collect()}
    assert got == expected(data)


def test_assign_region_inside_box(points, regions):
    data, df = points
    got = {r["id"]: r["region"] for r in assign_region(df, "x", "y", regions, box=(1.0, 3.0, 1.0, 3.0)).collect()}
    want = {i: r if data_x is not None and 1 <= data_x < 3 and 1 <= y < 3 else "Other"
            for (i, data_x, y), r in zip(data, expected(data).values())}
    assert got == want


@pytest.mark.parametrize("salts, per_row", [(1, 1000), (5, 1)])
def test_assign_region_by_cell(points, regions, salts, per_row):
    data, df = points
    got = {r["id"]: r["region"] for r in assign_region_by_cell(df, "x", "y", regions, salts=salts, per_row=per_row).collect()}
    assert got == expected(data)


def ray_test(x, y, corners):
    odd = False
    for (hx, hy), (tx, ty) in zip(corners, corners[-1:] + corners[:-1]):
        if (hy > y) != (ty > y) and x < hx + (tx - hx) * (y - hy) / (ty - hy):
            odd = not odd
    return odd


def star(rng, cx, cy, size, n):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [[cx + size * r * math.cos(a), cy + size * r * math.sin(a)] for a in angles for r in [0.3 + rng.random()]]


def test_regions_of_very_different_sizes(spark):
    """One polygon is ten thousand times as wide as the others, one a hundred times; all overlap."""
    rng = random.Random(4)
    shapes = [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), 0.05, 7) for _ in range(150)]
    shapes += [star(rng, 0, 0, 500, 11), star(rng, 1, 1, 5, 40), [[3.0, 3.0]], [], [[0.5, 0.5], [0.5, 0.5], [0.5, 0.5]], shapes[0],
               [[-2, 0], [2, 0], [2, 0.25], [-2, 0.25]]]
    order = rng.sample(range(150), 150) + list(range(150, len(shapes)))
    regions = spark.createDataFrame([(o, f"r{o}", [list(map(float, c)) for c in s]) for o, s in zip(order, shapes)],
                                    "ordinal int, name string, coord array<array<double>>")
    data = [(i, rng.gauss(0, s), rng.gauss(0, s)) for i in range(1500) for s in [rng.choice([1, 2, 4, 300])]]
    data += [(2000 + i, c[0], c[1]) for i, c in enumerate(sum(shapes[:30], []))] + [(5000, None, 1.0), (5001, 1e9, -1e9)]
    df = spark.createDataFrame(data, "id int, x double, y double")
    got = {r["id"]: r["region"] for r in assign_region_by_cell(df, "x", "y", regions, salts=2).collect()}
    by_order = sorted(zip(order, shapes))
    want = {i: next((f"r{o}" for o, s in by_order if x is not None and ray_test(x, y, s)), "Other") for i, x, y in data}
    assert got == want and len(set(got.values())) > 40
    cells = region_cells(regions)
    sizes = {r["ordinal"]: r["count"] for r in cells.groupBy("ordinal").count().collect()}
    assert max(sizes.values()) < 66 * 66 * 256 and sizes[order[150]] < 10 * max(sizes[o] for o in order[:150])
    assert cells.filter("inside").count() > 0 and cells.select("_level").distinct().count() >= 4


def test_no_regions_and_too_many(points, regions):
    _, df = points
    assert {r["region"] for r in assign_region(df, "x", "y", regions.limit(0)).collect()} == {"Other"}
    many = assign_region(df, "x", "y", regions, max_regions=2).collect()
    assert {r["id"]: r["region"] for r in many} == {r["id"]: r["region"] for r in assign_region(df, "x", "y", regions).collect()}
    assert {r["region"] for r in assign_region_by_cell(df, "x", "y", regions.limit(0)).collect()} == {"Other"}


def sides(spark):
    rng = random.Random(3)
    left = [(rng.randrange(4), rng.randrange(40_000), f"l{i}") for i in range(150)]
    right = [(rng.randrange(4), rng.randrange(40_000), f"r{i}") for i in range(150)]
    left += [(1, 0, "edge"), (None, 5, "null")]
    right += [(1, 7200, "at the limit"), (1, 7201, "beyond"), (1, 0, "same time"), (None, 6, "null")]
    frame = "k int, s long, {n} string"
    lf = spark.createDataFrame(left, frame.format(n="a")).select("k", F.timestamp_seconds(F.col("s") + START).alias("t0"), "a")
    rf = spark.createDataFrame(right, frame.format(n="b")).select("k", F.timestamp_seconds(F.col("s") + START).alias("t1"), "b")
    want = sorted((a, b) for k, s, a in left for k2, s2, b in right if k is not None and k == k2 and s < s2 <= s + 7200)
    return lf, rf, want


@pytest.mark.parametrize("spread", [True, False])
def test_interval_join(spark, spread):
    left, right, want = sides(spark)
    assert rows(interval_join(left, right, ["k"], "t0", "t1", spread=spread).select("a", "b")) == want


@pytest.mark.parametrize("spread", [True, False])
def test_interval_join_on_streams(spark, tmp_path, spread):
    left, right, want = sides(spark)
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    streams = [spark.readStream.schema(d.schema).parquet(str(tmp_path / n)) for d, n in ((left, "l"), (right, "r"))]
    joined = interval_join(*streams, ["k"], "t0", "t1", watermark="30 minutes", spread=spread)
    assert rows(collect_append(joined.select("a", "b"))) == want
