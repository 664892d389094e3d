"""Trigger statistics of streaming queries, from their progress records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _without_first(value: str, order: str) -> Column:
    """Sum without the first record: the first trigger also pays for the start-up."""
    return F.sum(value) - F.min_by(value, order)


def trigger_stats(progress: DataFrame, by: Sequence[str] = (), order: str = "batch_id") -> DataFrame:
    """Number of triggers and the steady-state mean of ``trigger_execution``.

    ``steady_ms`` divides by the number of triggers summed; ``steady_ms_all``
    divides by all triggers, as the older reports did.
    """
    rows = progress.filter(F.col("trigger_execution").isNotNull())
    rest = _without_first("trigger_execution", order)
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n_triggers"), F.try_divide(rest, n).alias("steady_ms_all"),
                                 F.try_divide(rest, n - 1).alias("steady_ms"))


def planning_stats(progress: DataFrame, by: Sequence[str] = (), order: str = "batch_id") -> DataFrame:
    """The same over triggers that planned a query, without the time of the log commit.

    ``phases_ms`` is the sum of the six phases over those triggers.
    """
    rows = progress.filter(F.col("query_planning").isNotNull()).withColumns({
        "_exec": F.col("trigger_execution") - F.col("wal_commit"),
        "_phases": F.col("add_batch") + F.col("get_batch") + F.col("latest_offset") + F.col("query_planning")
        + F.col("trigger_execution") + F.col("wal_commit")})
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n_triggers"),
                                 F.try_divide(_without_first("_exec", order), n - 1).alias("steady_exec_ms"),
                                 F.sum("_phases").alias("phases_ms"))
