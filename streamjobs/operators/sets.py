"""Duplicates, first and last rows, and differences between keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, so only one row per key and task is shuffled."""
    return _one_row(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return _one_row(df, keys, order, F.min_by)


def duplicate_rows(df: DataFrame, index: str) -> DataFrame:
    """Rows that repeat, in all columns but ``index``, a row with a smaller index.

    The first index of each content is found by an aggregate, and those rows are
    removed by an anti-join on the index. Both spread evenly even when a third
    of the table is copies of one row. ``index`` must be unique.
    """
    content = [c for c in df.columns if c != index]
    first = df.groupBy(*content).agg(F.min(index).alias(index)).select(index)
    return df.join(first, index, "left_anti")


def missing_runs(expected: DataFrame, found: DataFrame, index: str = "run_index") -> DataFrame:
    """Rows of ``expected`` whose index does not occur in ``found``."""
    return expected.join(found.select(index).distinct(), index, "left_anti")


def index_differences(a: DataFrame, b: DataFrame, index: str = "run_index") -> DataFrame:
    """Indexes that occur on one side only, with the side, or on both."""
    sides = (a.select(index, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(index, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
              .groupBy(index).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    side = (F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.lit("both"))
             .when(F.col("_a") == 1, F.lit("first")).otherwise(F.lit("second")))
    return sides.select(index, side.alias("side"))


def pending_runs(schedule: DataFrame, results: DataFrame, index: str = "run_index") -> DataFrame:
    """Scheduled runs after the last completed one; all of them when none is."""
    done = results.agg(F.coalesce(F.max(index), F.lit(-1)).alias("last_done")).scalar()
    return schedule.filter(F.col(index) > done)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union; a column that one table lacks is null there."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
