"""Latin hypercube samples and class balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.randoms import hash_uniform
from streamjobs.functions.scalar import option_name, rescale_knob
from streamjobs.operators.ordered import row_numbers


def unit_hypercube(samples: DataFrame, index: str, dims: Sequence[str], seed: int) -> DataFrame:
    """For each row and dimension a point in [0, 1) such that every one of the n strata has one point.

    ``samples`` gives the indexes (unique); ``n`` is their number. All dimensions
    are numbered in a single distributed sort of (dimension, random key).
    """
    n = samples.agg(F.count(F.lit(1)).cast("double")).scalar()
    long = samples.select(index, F.explode(F.lit(list(dims))).alias("_dim"))
    long = long.withColumn("_key", hash_uniform(seed, F.col("_dim"), F.col(index)))
    ranked = row_numbers(long, ["_dim"], ["_key", index], "_rank")
    inside = hash_uniform(f"{seed}i", F.col("_dim"), F.col(index))
    points = ranked.withColumn("_u", (F.col("_rank") + inside) / n)
    return points.groupBy(index).agg(*[F.max(F.when(F.col("_dim") == d, F.col("_u"))).alias(d) for d in dims])


def latin_hypercube(samples: DataFrame, index: str, knobs: Sequence[tuple[str, int, int]], seed: int,
                    use_min: bool = False, options: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Integer settings for knobs given as (name, min, max).

    A knob in ``options`` is a number from 1 that is replaced by the option's name.
    """
    unit = unit_hypercube(samples, index, [k for k, _, _ in knobs], seed)
    scaled = [rescale_knob(F.col(f"`{k}`"), F.lit(high), F.lit(low) if use_min else None).alias(k)
              for k, low, high in knobs]
    table = unit.select(index, *scaled)
    for knob, names in (options or {}).items():
        table = table.withColumn(knob, option_name(F.col(f"`{knob}`"), names))
    return table


def balance(df: DataFrame, label: str, fraction: float, seed: int, row_key: Sequence[str]) -> DataFrame:
    """All rows with label 1 and about ``fraction`` of those with label 0.

    The choice is a function of the row's key, so a recomputed task makes the same one.
    """
    drawn = hash_uniform(seed, *[F.col(c) for c in row_key]) < fraction
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & drawn))


def split_by_key(df: DataFrame, fraction: float, seed: int, row_key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Reproducible train and test parts."""
    u = hash_uniform(seed, *[F.col(c) for c in row_key])
    return df.filter(u < fraction), df.filter(u >= fraction)
