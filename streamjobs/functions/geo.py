"""Point and polygon expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Inclusive bounding-box test."""
    return lon.between(west, east) & lat.between(south, north)


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test of a point against ``ARRAY<ARRAY<DOUBLE>>`` corner points.

    An edge counts when its ends lie on different sides of the point's
    latitude and the crossing is to the right; a horizontal edge never counts,
    so its division is not reached.
    """
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        here = F.get(polygon, i)
        there = F.get(polygon, F.pmod(i + n - 1, n))
        hx, hy = F.get(here, F.lit(0)), F.get(here, F.lit(1))
        tx, ty = F.get(there, F.lit(0)), F.get(there, F.lit(1))
        at = hx + F.try_divide((tx - hx) * (y - hy), ty - hy)
        return ((hy > y) != (ty > y)) & F.coalesce(x < at, F.lit(False))

    corners = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    odd = F.size(F.filter(corners, crosses)) % 2 == 1
    return F.when(n > 0, odd).otherwise(F.lit(False))
