"""Port counters, bandwidth and resource use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.operators.ordered import numbers_by_split, previous_values, row_numbers

# Fixed value: seconds between two samples of a port's counters.
SAMPLE_SECONDS = 5


def sample_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: float = SAMPLE_SECONDS,
                   start: int = 0) -> DataFrame:
    """Add ``sample``, the ordinal within the series, and ``time_s``, its time from the start.

    Rows of files that are ordered by their ``line_key`` are numbered by their splits, without a sort of all rows.
    """
    if list(order) == ["line_key"]:
        numbered = numbers_by_split(df, keys, "sample", start=start)
    else:
        numbered = row_numbers(df, keys, order, "sample", start)
    return numbered.withColumn("time_s", F.col("sample") * F.lit(float(seconds)))


def counter_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                 interval: float = SAMPLE_SECONDS) -> DataFrame:
    """Rise of a counter per second since the sample before; 0 on the first sample."""
    before = previous_values(df, keys, order, value, "_previous")
    rate = (F.col(value) - F.col("_previous")) / F.lit(float(interval))
    return before.withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("_previous")


def counter_rate_by_sample(df: DataFrame, keys: Sequence[str], value: str,
                           interval: float = SAMPLE_SECONDS) -> DataFrame:
    """The same rate for series whose ``sample`` numbers have no gaps, by an equi-join on the number."""
    before = df.select(*keys, (F.col("sample") + 1).alias("sample"), F.col(value).alias("_previous"))
    joined = df.join(before, [*keys, "sample"], "left")
    rate = (F.col(value) - F.col("_previous")) / F.lit(float(interval))
    return joined.withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("_previous")


def port_bandwidth(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean rate in MB/s over all samples and the largest rate."""
    return rates.groupBy(*keys).agg((F.avg("rate") / 1e6).alias("mean_mb_s"), F.max("rate").alias("max_rate"),
                                    F.count(F.lit(1)).alias("n_samples"))


def sum_series(rates: DataFrame, ports: Sequence[tuple[int, int]] | None = None,
               first_port_only: bool = False) -> DataFrame:
    """Rates of several ports added up per sample; a port without that sample adds 0.

    The series is as long as that of the first port listed, and only the listed
    ports count. Without a list all ports and samples do.
    """
    if not ports:
        return rates.groupBy("sample").agg(F.sum("rate").alias("rate"))
    switch, port = ports[0]
    first = (F.col("switch") == switch) & (F.col("port") == port)
    wanted = F.lit(False)
    for s, p in ports[:1] if first_port_only else ports:
        wanted = wanted | ((F.col("switch") == s) & (F.col("port") == p))
    summed = rates.filter(wanted).groupBy("sample").agg(F.sum("rate").alias("rate"),
                                                        F.max(first.cast("int")).alias("_first"))
    return summed.filter(F.col("_first") == 1).drop("_first")


def offered_load(samples: DataFrame, message_bytes: int, message_rate: float, switches: int) -> DataFrame:
    """The constant input rate in MB/s beside each sample."""
    return samples.select("sample", F.lit(message_bytes * message_rate * switches / 1e6).alias("offered_mb_s"))


def mean_resources(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean CPU share and memory."""
    return df.groupBy(*by).agg(F.avg("cpu").alias("avg_cpu"), F.avg("mem").alias("avg_mem"))
