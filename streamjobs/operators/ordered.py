"""Row numbers, previous values, running totals and cumulative shares over data
where one key (or no key at all) may hold most of the rows.

An ordinary window puts a whole key into one task. Here the rows are first cut
into range partitions of (keys, order), which also cuts through a large key,
and written once, so that the cuts stay fixed. Each part is then worked on for
itself, and what precedes it (a row count, a last value, a sum) comes from a
small table with one row per part and key.

``order`` must end in something unique within the key; otherwise equal rows
have no defined order and cannot be cut apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamjobs.session import written


def range_parts(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the number of its range partition, rising with ``order``.

    ``parts`` is the number of partitions; without it Spark's setting holds, which has to
    be made for the size of the data.
    """
    columns = [F.col(c) for c in order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return written(ranged.withColumn("_part", F.spark_partition_id()), "ordered")


def _with_preceding(parts: DataFrame, local: DataFrame, keys: Sequence[str], summary: Column,
                    combine, name: str) -> DataFrame:
    """Join to ``local`` what ``combine`` makes of the summaries of a key's other parts.

    Only keys that lie in more than one part need it; ``name`` is null for the
    others. The parts are consecutive ranges, so two neighbours share at most one
    key, and the broadcast table has at most two rows per part.
    """
    by_part = parts.groupBy("_part", *keys).agg(summary.alias("_summary"))
    of_key = Window.partitionBy(*keys)
    before = (by_part.withColumn("_parts", F.count(F.lit(1)).over(of_key))
                     .withColumn(name, combine("_summary", of_key.orderBy("_part")))
                     .filter("_parts > 1").select("_part", *keys, name))
    on = local["_part"] == before["_part"]
    for c in keys:
        on = on & local[c].eqNullSafe(before[c])
    return local.join(F.broadcast(before), on, "left").select(*[local[c] for c in local.columns], before[name])


def _sum_before(col: str, window) -> Column:
    return F.coalesce(F.sum(col).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _sums(col: str, window) -> Column:
    everything = F.sum(col).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.struct(_sum_before(col, window).alias("before"), everything.alias("whole"))


def _last_before(col: str, window) -> Column:
    return F.lag(col).over(window)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, start: int = 0,
                n_parts: int | None = None) -> DataFrame:
    """Position of each row within its key."""
    parts = range_parts(df, [*keys, *order], n_parts)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    local = parts.withColumn("_rn", F.row_number().over(inside))
    numbered = _with_preceding(parts, local, keys, F.count(F.lit(1)), _sum_before, "_before")
    number = F.col("_rn") + F.coalesce("_before", F.lit(0)) - 1 + start
    return numbered.select(*df.columns, number.cast("long").alias(name))


def numbers_by_split(df: DataFrame, keys: Sequence[str], name: str, line_key: str = "line_key", start: int = 0) -> DataFrame:
    """Position of each row within its key, for rows of files that carry ``line_key`` (start of the split, row in the task).

    A row's number is its place among the key's rows of the same split, plus the rows of the
    key's splits before it, which come from a count per split. Splits are bounded, so no task
    gets more than one split's rows of a key; nothing is sorted as a whole, and nothing is
    written. A key's rows have to be those of one file (or ``keys`` has to name the file).
    """
    block, order = F.col(f"{line_key}.block"), F.col(f"{line_key}.row")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    local = df.withColumn("_block", block).withColumn("_rn", F.row_number().over(inside))
    counts = df.select(*[F.col(k).alias(f"_of_{k}") for k in keys], block.alias("_at")).groupBy(*[f"_of_{k}" for k in keys], "_at").agg(
        F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_at")
    offsets = counts.withColumn("_offset", F.sum("_rows").over(before) - F.col("_rows"))
    on = local["_block"] == offsets["_at"]
    for k in keys:
        on = on & local[k].eqNullSafe(offsets[f"_of_{k}"])
    return local.join(offsets, on).select(*df.columns, (F.col("_offset") + F.col("_rn") - 1 + start).cast("long").alias(name))


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str,
                    n_parts: int | None = None) -> DataFrame:
    """The value of the row before within the key; null on a key's first row."""
    parts = range_parts(df, [*keys, *order], n_parts)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    local = (parts.withColumn("_rn", F.row_number().over(inside))
                  .withColumn("_lag", F.lag(value).over(inside)))
    last = F.max_by(F.struct(value), F.struct(*order))
    joined = _with_preceding(parts, local, keys, last, _last_before, "_before")
    previous = F.when(F.col("_rn") > 1, F.col("_lag")).otherwise(F.col("_before")[value])
    return joined.select(*df.columns, previous.alias(name))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str,
                   whole: str | None = None) -> DataFrame:
    """Sum of ``value`` up to and including each row within its key; ``whole`` names a column for the key's sum."""
    parts = range_parts(df, [*keys, *order])
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    local = parts.withColumn("_running", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    if whole:
        everything = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        local = local.withColumn("_all", F.sum(value).over(everything))
    joined = _with_preceding(parts, local, keys, F.sum(value), _sums, "_sums")
    columns = [(F.col("_running") + F.coalesce("_sums.before", F.lit(0))).alias(name)]
    if whole:
        columns.append(F.coalesce("_sums.whole", "_all").alias(whole))
    return joined.select(*df.columns, *columns)


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value (and key): ``n_rows`` with it, ``n_cumulative`` at or below it, ``n_total`` of the key.

    The rows are counted per value first, so a value that fills a third of the
    table is one row when the sorting begins. Null values are left out.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
                .agg(F.count(F.lit(1)).alias("n_rows")))
    return running_totals(counts, keys, [value], "n_rows", "n_cumulative", whole="n_total")
