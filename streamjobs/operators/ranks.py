"""Exact values at given ranks, by counting passes over ever narrower ranges.

Every wanted rank of every group starts with the range from minimum to maximum. A pass
counts the rows of all ranges in bins, with the least and greatest value of each bin, and
the bin that holds the rank is the next range. A bin of ``n`` rows out of 1 024 is about a
thousandth, so two or three passes are usual; a rank is found when its range is one value.
Rows are counted where they are: no sort, no exchange of rows, no copy. What is written
between passes is one row per group and rank.

Every third pass has bins that double in width, so that values that crowd at one end of
their range are told apart in few passes as well. A range of two values or more always
falls into two bins or more, therefore the passes end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamjobs.session import written

BINS = 1024
_GREATEST = 1.7976931348623157e308


def _bin(value: Column, low: Column, high: Column, doubling: bool) -> Column:
    """Bin of a value of a range, from -1 to ``BINS``; halves keep the width of any range finite."""
    def finite(c: Column) -> Column:
        return F.greatest(F.lit(-_GREATEST), F.least(F.lit(_GREATEST), c)) / 2

    # A range too narrow for its halves to differ has its greatest value in the last bin, the others in the first.
    share = F.coalesce(F.try_divide(finite(value) - finite(low), finite(high) - finite(low)), F.lit(0.0))
    if doubling:
        # 2^-1074 is the least double there is: each bin is one halving of the range.
        place = F.when(share > 0, F.greatest(F.lit(1.0), BINS - 1 + F.floor(F.log2(share)))).otherwise(F.lit(0.0))
    else:
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double")
    return (F.when(value == float("inf"), F.lit(BINS)).when(value == float("-inf"), F.lit(-1))
             .when(value == high, F.lit(BINS - 1)).otherwise(F.least(place, F.lit(float(BINS - 1 if not doubling else BINS - 2)))).cast("int"))


def values_at_ranks(df: DataFrame, col: str, by: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """Per group the number of its values (``n_rows``) and the value at every rank, as doubles.

    ``ranks`` are whole numbers from 0, as columns over ``n_rows``. Nulls and NaN are no
    values; a group without values has no row. Groups may be null; infinite values are
    values like others. ``df`` is read once per pass and once before the first.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_k0")]
    values = df.select(*named, F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    ends = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()]))
    wants = written(ends.select(*keys, "n_rows", wanted, "_low", "_high"), "ranks")
    turn = 0
    while not (ranged := wants.filter("_low < _high")).isEmpty():
        moved = _narrowed(values, ranged, keys, doubling=turn % 3 == 2)
        wants = written(wants.filter("_low = _high").unionByName(moved), "ranks")
        turn += 1
    found = wants.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), *[
        F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in ranks])
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "n_rows", *ranks)


def _narrowed(values: DataFrame, wants: DataFrame, keys: list[str], doubling: bool) -> DataFrame:
    """The wants with the range of the bin that holds their rank, ranks counted from its start."""
    # The ranges of a group are disjoint or equal, as they are bins of one range.
    ranges = (wants.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_low", "_high").distinct()
                   .groupBy(*[f"_of{k}" for k in keys]).agg(F.collect_list(F.struct("_low", "_high")).alias("_ranges")))
    v = F.col("_v")
    inside = F.get(F.filter("_ranges", lambda r: (v >= r["_low"]) & (v <= r["_high"])), F.lit(0))
    same = _same(values, keys, ranges, [f"_of{k}" for k in keys])
    rows = (values.join(ranges, same).select(*keys, "_v", inside.alias("_range")).filter("_range IS NOT NULL")
                  .select(*keys, "_v", "_range._low", "_range._high"))
    counted = (rows.withColumn("_bin", _bin(v, F.col("_low"), F.col("_high"), doubling)).groupBy(*keys, "_low", "_high", "_bin")
                   .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
    of_range = Window.partitionBy(*keys, "_low", "_high").orderBy("_bin")
    bins = counted.withColumn("_before", F.sum("_n").over(of_range) - F.col("_n"))
    placed = bins.select(*[F.col(k).alias(f"_of{k}") for k in keys], F.col("_low").alias("_from"), F.col("_high").alias("_to"),
                         "_n", "_least", "_most", "_before")
    on = (_same(wants, keys, placed, [f"_of{k}" for k in keys]) & (wants["_low"] == placed["_from"]) & (wants["_high"] == placed["_to"])
          & (wants["_rank"] >= placed["_before"]) & (wants["_rank"] < placed["_before"] + placed["_n"]))
    return wants.join(placed, on).select(*keys, "n_rows", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"),
                                         F.col("_least").alias("_low"), F.col("_most").alias("_high"))


def _same(left: DataFrame, keys: Sequence[str], right: DataFrame, others: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(keys, others, strict=True):
        on = on & left[a].eqNullSafe(right[b])
    return on
