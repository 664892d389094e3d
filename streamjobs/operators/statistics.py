"""Distribution tables: histogram, cumulative share, density, quartiles, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.operators.ordered import cumulative_counts, running_totals
from streamjobs.operators.ranks import values_at_ranks


def histogram(df: DataFrame, col: str, bins: int = 28) -> DataFrame:
    """Equal-width bins from minimum to maximum, the maximum in the last bin.

    Columns: ``bin`` (from 1), ``low``, ``high``, ``n_rows``, ``density`` and
    ``share`` (cumulative). Empty bins are listed.
    """
    values = df.filter(F.col(col).isNotNull())
    ends = values.agg(F.struct(F.min(col).cast("double").alias("low"), F.max(col).cast("double").alias("high"))).scalar()
    ranged = values.select(F.col(col).cast("double").alias("_v"), ends["low"].alias("_low"), ends["high"].alias("_high"))
    # A single distinct value gets a range of one around it.
    single = F.col("_low") == F.col("_high")
    ranged = ranged.withColumns({"_low": F.when(single, F.col("_low") - 0.5).otherwise(F.col("_low")),
                                 "_high": F.when(single, F.col("_high") + 0.5).otherwise(F.col("_high"))})
    place = F.floor((F.col("_v") - F.col("_low")) * bins / (F.col("_high") - F.col("_low"))) + 1
    counted = (ranged.groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin"))
                     .agg(F.count(F.lit(1)).alias("n"), F.min("_low").alias("lo"), F.min("_high").alias("hi")))
    # From here on there are at most ``bins`` rows, so one value can hold them.
    whole = counted.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"),
                        F.sum("n").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    listed = whole.filter(F.col("total") > 0).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    n_at = F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0))
    upto = F.aggregate(F.sequence(F.lit(1), F.col("bin")), F.lit(0).cast("long"),
                       lambda acc, b: acc + F.coalesce(F.try_element_at("by_bin", b), F.lit(0)))
    return listed.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"),
                         (F.col("lo") + F.col("bin") * width).alias("high"), n_at.alias("n_rows"),
                         (n_at / (F.col("total") * width)).alias("density"), (upto / F.col("total")).alias("share"))


def cdf(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each distinct value."""
    cumulative = cumulative_counts(df, col, by)
    return cumulative.select(*by, col, "n_rows", (F.col("n_cumulative") / F.col("n_total")).alias("share"))


def kde(df: DataFrame, col: str, points: int = 200, cumulative: bool = False, tolerance: float = 1e-9) -> DataFrame:
    """Gaussian kernel density (or its cumulative sum) on an even grid from minimum to maximum.

    The bandwidth ``h`` follows Scott's rule. Values are shared out to the two neighbours among
    fixed bins of width ``d``, in proportion to their nearness, and the kernel is applied bin by
    grid point: the work for a row does not depend on ``points``. That replaces the kernel by its
    linear interpolation between bins, which is off by at most ``d^2 / 8`` times its greatest
    curvature, ``1 / (h^3 sqrt(2 pi))``; ``d`` is chosen so that no density is off by more than
    ``tolerance``. A single distinct value has no bandwidth, its densities are null.
    """
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v"))
    shape = values.agg(F.struct(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"),
                                F.stddev_samp("_v").alias("sd"))).scalar()
    low, high, n = shape["low"], shape["high"], shape["n"]
    bandwidth = F.nullif(shape["sd"] * F.pow(n.cast("double"), F.lit(-0.2)), F.lit(0.0))
    width = F.sqrt(F.lit(8 * math.sqrt(2 * math.pi) * tolerance) * F.pow(bandwidth, F.lit(3.0)))
    placed = values.select(F.coalesce(F.try_divide(F.col("_v") - low, width), F.lit(0.0)).alias("_u"))
    left, part = F.floor("_u"), F.col("_u") - F.floor("_u")
    shared = placed.select(F.inline(F.array(F.struct(left.alias("_bin"), (1 - part).alias("_w")), F.struct((left + 1).alias("_bin"), part.alias("_w")))))
    binned = (shared.filter("_w > 0").groupBy("_bin").agg(F.sum("_w").alias("_w"))
                    .withColumns({"_h": bandwidth, "_low": low, "_step": (high - low) / (points - 1), "_width": width, "_n": n}))

    def kernel(point: int) -> Column:
        z = (F.col("_step") * point - F.col("_bin") * F.col("_width")) / F.col("_h")
        return F.exp(z * z * -0.5) / (F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))

    # One row with a sum for each grid point; no row is multiplied.
    sums = binned.agg(F.max("_n").alias("_total"), F.min("_low").alias("_low"), F.min("_step").alias("_step"),
                      F.array(*[F.sum(F.col("_w") * kernel(p)) for p in range(points)]).alias("_sums"))
    density = (sums.filter(F.col("_total") > 0).select("_total", "_low", "_step", F.posexplode("_sums").alias("point", "_sum"))
                   .select("point", (F.col("_low") + F.col("_step") * F.col("point")).alias("x"),
                           (F.col("_sum") / F.col("_total")).alias("density")))
    if not cumulative:
        return density
    # The grid has a fixed number of points, so the running sum is small.
    step = running_totals(density, [], ["point"], "density", "_sum")
    whole = step.agg(F.max("_sum")).scalar()
    return step.select("point", "x", "density", (F.col("_sum") / whole).alias("share"))


def quantiles(df: DataFrame, col: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation and the number of values, one row per group.

    The values at the ranks around each quantile come from counting passes over narrowing
    ranges (``ranks``); nulls and NaN are no values. ``df`` is read some three times, so
    give it written if it is dear to compute.
    """
    picks = {f"_{name}_{end}": at((F.col("n_rows") - 1) * F.lit(float(p)))
             for name, p in probs.items() for end, at in (("lo", F.floor), ("hi", F.ceil))}
    found = values_at_ranks(df, col, by, picks)

    def between(name: str, p: float) -> Column:
        rank = (F.col("n_rows") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank))).alias(name)

    return found.select(*by, "n_rows", *[between(name, p) for name, p in probs.items()])


def _with_quartiles(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Rows that have a value, with their group's quartiles and whether they lie within 1.5 interquartile ranges."""
    quartiles = quantiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    small = quartiles.select(*[F.col(c).alias(f"_of_{c}") for c in by], "q1", "median", "q3")
    rows = df.select(*by, col).filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    on = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(small[f"_of_{c}"])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(col).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(small, on).select(*by, col, "q1", "median", "q3", inside.alias("_inside"))


def box_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and number of outliers."""
    return _with_quartiles(df, col, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(F.col("_inside"), F.col(col))).alias("whisker_low"), F.max(F.when(F.col("_inside"), F.col(col))).alias("whisker_high"),
        F.count_if(~F.col("_inside")).alias("n_outliers"))


def outliers(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """The values beyond the whiskers of their group's box, and how often each occurs."""
    return _with_quartiles(df, col, by).filter("NOT _inside").groupBy(*by, col).agg(F.count(F.lit(1)).alias("n_rows"))


def cross_corr(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ``xs`` with every ``ys``, from a single aggregation."""
    pairs = [(x, y) for x in xs for y in ys]
    row = df.agg(*[F.corr(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(x).alias("state"), F.lit(y).alias("knob"), F.col(f"c{i}").alias("corr"))
                       for i, (x, y) in enumerate(pairs)])
    return row.select(F.inline(listed))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column, one row each.

    The columns are stacked first, so that one pass serves all of them.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])))
    basic = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"),
                                       F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
                                       F.max("v").alias("max"))
    quartiles = quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"]).drop("n_rows")
    return (basic.join(quartiles, "column", "left")
                 .select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max"))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """How often each value occurs."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("frequency"))
