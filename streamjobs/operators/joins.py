"""Interval join and point-to-region assignment."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamjobs.functions.geo import point_in_polygon
from streamjobs.session import written


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
                  upper_seconds: int = 7200, watermark: str | None = None, spread: bool = False) -> DataFrame:
    """Inner join on ``keys`` where right comes after left, by at most ``upper_seconds``.

    ``spread``, for keys that repeat very often, also joins on the time slot of the left row, with each right row
    offered to its own and the preceding slot. A pair is still found exactly
    once, and a key that holds much of the data is spread over its time slots.
    With ``watermark`` both sides get one, so that a stream can drop old state.
    """
    if watermark:
        left = left.withWatermark(left_ts, watermark)
        right = right.withWatermark(right_ts, watermark)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = (F.col(right_ts) > F.col(left_ts)) & \
         (F.col(right_ts) <= F.col(left_ts) + F.make_interval(secs=F.lit(upper_seconds)))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_right_{k}"))
    if spread:
        def slot(ts: str) -> Column:
            return F.floor(F.unix_micros(ts) / F.lit(upper_seconds * 1_000_000))

        left = left.withColumn("_slot", slot(left_ts))
        renamed = renamed.withColumn("_right_slot", F.explode(F.array(slot(right_ts), slot(right_ts) - 1)))
        on = on & (F.col("_slot") == F.col("_right_slot"))
    joined = left.join(renamed, on)
    return joined.drop("_slot", "_right_slot", *[f"_right_{k}" for k in keys])


def _with_bounds(regions: DataFrame) -> DataFrame:
    """Bounding box of each region's corners."""
    xs = F.transform("coord", lambda p: F.get(p, F.lit(0)))
    ys = F.transform("coord", lambda p: F.get(p, F.lit(1)))
    return regions.select("ordinal", "name", "coord", F.array_min(xs).alias("west"), F.array_max(xs).alias("east"),
                          F.array_min(ys).alias("south"), F.array_max(ys).alias("north"))


def assign_region(points: DataFrame, lon: str, lat: str, regions: DataFrame, name: str = "region",
                  default: str = "Other", box: tuple[float, float, float, float] | None = None,
                  max_regions: int = 1000, max_corners: int = 200_000) -> DataFrame:
    """First region, by ``ordinal``, whose polygon contains the point, else ``default``.

    ``regions`` has ``ordinal``, ``name`` and ``coord``; ``box`` is an outer
    (west, east, south, north) limit, its east and north ends excluded as for a
    polygon. A set of regions within the checked limits
    becomes one array value, and the test is row-local: no shuffle, and it works
    on a stream. A larger set goes to ``assign_region_by_cell``.
    """
    return Regions(regions, max_regions, max_corners).assign(points, lon, lat, name, default, box)


class Regions:
    """Regions made ready once, to assign any number of points to them (see ``assign_region``)."""

    def __init__(self, regions: DataFrame, max_regions: int = 1000, max_corners: int = 200_000):
        self.regions = regions
        bounded = _with_bounds(regions).filter("west IS NOT NULL AND south IS NOT NULL")
        self.rows, corners = bounded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("coord")), F.lit(0))).first()
        self.few = self.rows <= max_regions and corners <= max_corners
        self.listed = bounded.orderBy("ordinal").collect() if self.few else []

    def assign(self, points: DataFrame, lon: str, lat: str, name: str = "region", default: str = "Other",
               box: tuple[float, float, float, float] | None = None) -> DataFrame:
        if self.rows == 0:
            return points.withColumn(name, F.lit(default))
        x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
        if self.few:
            grid = _Grid(self.listed)
            shapes = F.from_json(F.lit(json.dumps([{"n": r["name"], "c": r["coord"]} for r in self.listed])),
                                 "array<struct<n:string,c:array<array<double>>>>")
            inside = F.filter(grid.candidates(x, y), lambda i: point_in_polygon(x, y, F.get(shapes, i)["c"]))
            found = points.withColumn(name, F.coalesce(F.get(shapes, F.get(inside, F.lit(0)))["n"], F.lit(default)))
        else:
            found = assign_region_by_cell(points, lon, lat, self.regions, name, default)
        if box is None:
            return found
        west, east, south, north = box
        outside = ~((x >= west) & (x < east) & (y >= south) & (y < north))
        return found.withColumn(name, F.when(outside, F.lit(default)).otherwise(F.col(name)))


class _Grid:
    """Which regions' bounding boxes touch a cell of an even grid over all of them."""

    def __init__(self, listed, side: int = 32):
        self.side = side
        self.x = min(r["west"] for r in listed), max(r["east"] for r in listed)
        self.y = min(r["south"] for r in listed), max(r["north"] for r in listed)
        self.cells: list[list[int]] = [[] for _ in range(side * side)]
        for i, r in enumerate(listed):
            for cy in range(self._cell(r["south"], self.y), self._cell(r["north"], self.y) + 1):
                for cx in range(self._cell(r["west"], self.x), self._cell(r["east"], self.x) + 1):
                    self.cells[cy * side + cx].append(i)

    def _cell(self, value: float, ends: tuple[float, float]) -> int:
        low, high = ends
        return min(int((value - low) / (high - low) * self.side), self.side - 1) if high > low else 0

    def _cell_column(self, value: Column, ends: tuple[float, float]) -> Column:
        low, high = ends
        if high <= low:
            return F.lit(0)
        place = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(self.side)))
        return F.least(place, F.lit(self.side - 1)).cast("int")

    def candidates(self, x: Column, y: Column) -> Column:
        """Positions of the regions that may contain the point, in order; null outside all of them."""
        cells = F.from_json(F.lit(json.dumps(self.cells)), "array<array<int>>")
        at = self._cell_column(y, self.y) * self.side + self._cell_column(x, self.x)
        return F.when(x.between(*self.x) & y.between(*self.y), F.get(cells, at))


#: Each level of cells is so many times wider than the one below.
FAN = 16


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(FAN)), level.cast("double"))


def _edge_in_box(polygon: Column, x: Column, y: Column, half: Column) -> Column:
    """Whether an edge of the polygon meets the box around a point, or comes so near that rounding decides."""
    n = F.size(polygon)
    reach = half * (1 + 1e-9) + F.greatest(F.abs(x), F.abs(y)) * 1e-12

    def meets(i: Column) -> Column:
        here, there = F.get(polygon, i), F.get(polygon, F.pmod(i + n - 1, n))
        hx, hy, tx, ty = F.get(here, F.lit(0)), F.get(here, F.lit(1)), F.get(there, F.lit(0)), F.get(there, F.lit(1))
        dx, dy, mx, my = tx - hx, ty - hy, (hx + tx) / 2 - x, (hy + ty) / 2 - y
        return ((F.abs(mx) <= F.abs(dx) / 2 + reach) & (F.abs(my) <= F.abs(dy) / 2 + reach)
                & (F.abs(mx * dy - my * dx) <= reach * (F.abs(dx) + F.abs(dy))))

    return F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(meets(i), F.lit(True)))


def _touched_cells(regions: DataFrame, level: Column, xs: Column, ys: Column) -> DataFrame:
    """The cells in ranges of columns and rows that a region covers (``inside``) or that hold a part of its edge."""
    cells = (regions.withColumn("_level", level).withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
                    .withColumn("_half", _width(F.col("_level")) / 2))
    x, y = (F.col("_cx") * 2 + 1) * F.col("_half"), (F.col("_cy") * 2 + 1) * F.col("_half")
    # Without an edge in it, all of a cell lies on the side of its centre.
    touched = (cells.withColumn("_edge", _edge_in_box(F.col("coord"), x, y, F.col("_half")))
                    .withColumn("inside", ~F.col("_edge") & point_in_polygon(x, y, F.col("coord")))
                    .filter("_edge OR inside").drop("_half", "_edge"))
    # Written: each cell is tested once, and the optimizer does not carry the tests, which have lambdas, through the union.
    return written(touched, "touched-cells")


def region_cells(regions: DataFrame) -> DataFrame:
    """Regions as cells of two sizes that go with their own: ``_level, _cx, _cy, ordinal, name, coord, inside``.

    The wider cells are between a 64th and a quarter of the region's longer side, so at most
    66 x 66 touch it; those on its edge are listed as the narrower cells in them, 16 to a side. A region has
    a bounded number of cells, whatever its size and that of the others. Regions without an
    extent contain no point and have none.
    """
    bounded = _with_bounds(regions).filter("west IS NOT NULL AND south IS NOT NULL AND (east > west OR north > south)")
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.floor(F.log(side / 4) / F.log(F.lit(float(FAN)))).cast("int")
    sized = bounded.withColumn("_level", level)

    def span(low: str, high: str, width: Column) -> Column:
        return F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))

    wide = _touched_cells(sized, F.col("_level"), *(span(a, b, _width(F.col("_level"))) for a, b in (("west", "east"), ("south", "north"))))

    def part(cell: str, low: str, high: str) -> Column:
        """The narrower cells of a cell that the region's box reaches; none where rounding puts the box beside the cell."""
        narrow = _width(F.col("_above") - 1)
        first = F.greatest(F.col(cell) * FAN, F.floor(F.col(low) / narrow) - 1)
        last = F.least(F.col(cell) * FAN + FAN - 1, F.floor(F.col(high) / narrow) + 1)
        return F.when(first <= last, F.sequence(first, last))

    edges = wide.filter(~F.col("inside")).withColumnsRenamed({"_level": "_above", "_cx": "_wx", "_cy": "_wy"}).drop("inside")
    narrow = _touched_cells(edges, F.col("_above") - 1, part("_wx", "west", "east"), part("_wy", "south", "north"))
    columns = ["_level", "_cx", "_cy", "ordinal", "name", "coord", "inside"]
    return wide.filter("inside").select(*columns).unionByName(narrow.select(*columns))


def assign_region_by_cell(points: DataFrame, lon: str, lat: str, regions: DataFrame, name: str = "region", default: str = "Other",
                          salts: int = 8, per_row: int = 1000) -> DataFrame:
    """The same assignment for any number of regions of any sizes, as equi-joins on cells (see ``region_cells``).

    A point meets the cell it lies in, once per level in use: regions 16 times larger than
    others add one. A cell's regions are listed in order, without those that come after one
    that covers the whole cell; more than ``per_row`` of them are cut into several rows, met one
    after the other. Only regions whose edge runs through the cell take the ray test. ``salts``
    copies the cells so that a crowded one is met by several tasks.
    """
    of_cell = Window.partitionBy("_level", "_cx", "_cy")
    first = F.min(F.when(F.col("inside"), F.col("ordinal"))).over(of_cell)
    listed = (region_cells(regions).withColumn("_first", first).filter("_first IS NULL OR ordinal <= _first")
              .withColumn("_piece", F.floor((F.row_number().over(of_cell.orderBy("ordinal")) - 1) / per_row).cast("int")))
    region = F.struct("ordinal", "name", F.when(~F.col("inside"), F.col("coord")).alias("coord"))
    cells = written(listed.groupBy("_level", "_cx", "_cy", "_piece").agg(F.sort_array(F.collect_list(region)).alias("_regions")), "region-cells")
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    joined = points.withColumns({"_salt": salt, "_best": F.lit(None).cast("struct<ordinal: bigint, name: string>")})
    inside = F.get(F.filter("_regions", lambda r: r["coord"].isNull() | point_in_polygon(x, y, r["coord"])), F.lit(0))
    found = F.when(inside.isNotNull(), F.struct(inside["ordinal"].cast("long").alias("ordinal"), inside["name"].alias("name")))
    # A few dozen levels at most, for sizes of any ratio; one piece unless more than per_row edges cross one cell.
    for level, piece in sorted(map(tuple, cells.select("_level", "_piece").distinct().collect())):
        width = float(FAN) ** level
        here = (cells.filter((F.col("_level") == level) & (F.col("_piece") == piece)).select("_cx", "_cy", "_regions")
                     .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
        located = joined.withColumns({"_cx": F.floor(x / width), "_cy": F.floor(y / width)})
        joined = (located.join(here, ["_cx", "_cy", "_salt"], "left").withColumn("_best", F.least("_best", found))
                         .select(*points.columns, "_salt", "_best"))
    return joined.select(*points.columns, F.coalesce("_best.name", F.lit(default)).alias(name))
