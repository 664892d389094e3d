"""Tables of runs: metrics, knobs and results, keyed by ``run_index``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.functions.scalar import option_code, round_half_even
from streamjobs.operators.sets import keep_last, union_by_name


def metrics_rollup(samples: DataFrame, names: Sequence[str], drop_zero: bool = True) -> DataFrame:
    """One row per run and host, one column per metric: gauges by mean, counters by last value.

    ``samples`` has ``run_index, host, ts, metric, kind, attribute_key, value``;
    a metric with a key is named ``metric_key``. Missing samples, and with
    ``drop_zero`` zero ones, do not count.
    """
    counts = F.col("value").isNotNull()
    if drop_zero:
        counts = counts & (F.col("value") != 0)
    # Samples that do not count stay in the grouping, so that every host has its row without a join.
    full_name = F.concat_ws("_", F.col("metric"), F.col("attribute_key"))
    gauge, counter = (counts & (F.col("kind") == kind) for kind in ("gauge", "counter"))
    per_metric = (samples.withColumn("_name", F.when(full_name.isin(list(names)), full_name))
                         .groupBy("run_index", "host", "_name")
                         .agg(F.avg(F.when(gauge, F.col("value"))).alias("_mean"),
                              F.max_by(F.when(counter, F.col("value")), F.when(counter, F.col("ts"))).alias("_last")))
    value = F.coalesce("_mean", "_last")
    return per_metric.groupBy("run_index", "host").agg(
        *[F.max(F.when(F.col("_name") == n, value)).alias(n) for n in names])


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in without]


def mean_by_run(frames: Sequence[DataFrame], index: str = "run_index", skip: Sequence[str] = ("timestamp", "host")) -> DataFrame:
    """Mean over the hosts of every numeric column, rounded half-even to 2, columns in alphabetical order."""
    together = union_by_name([f.drop(*skip) for f in frames])
    names = sorted(numeric_columns(together, [index]))
    return together.groupBy(index).agg(*[round_half_even(F.avg(n)).alias(n) for n in names])


def merge_metrics(frames: Sequence[DataFrame], results: DataFrame, index: str = "run_index") -> DataFrame:
    """Mean metrics with each run's throughput and latency beside them; every metric row is kept."""
    means = mean_by_run(frames, index)
    outcome = results.select(index, *[round_half_even(F.col(c)).alias(c) for c in ("Throughput", "Latency")])
    joined = means.join(outcome, index, "left")
    return joined.select(index, *sorted(c for c in joined.columns if c != index))


def align_runs(states: DataFrame, knobs: DataFrame, index: str = "run_index") -> DataFrame:
    """Both tables side by side; a run that one lacks has nulls there."""
    return states.join(knobs, index, "full")


def _informative(df: DataFrame, names: Sequence[str], test) -> list[str]:
    """Names for which the aggregate ``test(name)`` is true; one row reaches the driver."""
    if not names:
        return []
    row = df.agg(*[test(n).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[i]]


def drop_constant(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that never vary. A null differs from everything, itself included."""
    names = [c for c in df.columns if c not in keep]
    varying = _informative(df, names, lambda n: F.coalesce(
        (F.min(n) != F.max(n)) | (F.count(n) < F.count(F.lit(1))), F.count(F.lit(1)) > 0))
    return df.select(*[c for c in df.columns if c in keep or c in varying])


def nonzero_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Metric columns with at least one value that is a number other than zero."""
    return _informative(df, names, lambda n: F.coalesce(
        F.max(F.abs(F.col(n).try_cast("double"))) > 0, F.lit(False)))


def prepare_schedule(schedule: DataFrame, column: str, options: Sequence[str]) -> DataFrame:
    """Replace a named option by its number."""
    return schedule.withColumn(column, option_code(F.col(column), options))


def prepare_states(states: DataFrame, order: Sequence[str], index: str = "run_index") -> DataFrame:
    """Drop constant metrics, then keep the last row of each run."""
    varying = drop_constant(states, [index, *order])
    return keep_last(varying, [index], order)


def run_row(knobs: DataFrame, throughput: DataFrame, latency: DataFrame, index: str = "run_index") -> DataFrame:
    """One result row per run: its knobs, mean throughput and mean latency."""
    return knobs.join(throughput, index, "left").join(latency, index, "left")
