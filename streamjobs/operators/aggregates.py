"""Grouped counts, distinct sets and windowed averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.text import words


def word_count(df: DataFrame, text: str = "value") -> DataFrame:
    return words(df, [], text).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def distinct_terms(df: DataFrame, by: Sequence[str], text: str = "value") -> DataFrame:
    """The words of each (topic, file): ``frequency`` is 1 for a word that occurs, ``term_count`` how often."""
    counted = words(df, list(by), text).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("term_count"))
    return counted.select(*by, "word", F.lit(1).cast("long").alias("frequency"), "term_count")


def avg_distinct_terms(df: DataFrame, topic: str = "topic", file: str = "file", frequency: str = "frequency",
                       approx: bool = False) -> DataFrame:
    """Sum of the frequencies over the number of files, per topic.

    The exact form sums per file first, so that no task holds a topic's files.
    """
    total = F.sum(F.col(frequency).try_cast("double"))
    if approx:
        return df.groupBy(topic).agg((total / F.approx_count_distinct(file)).alias("avg_words"))
    per_file = df.groupBy(topic, file).agg(total.alias("_total"))
    return per_file.groupBy(topic).agg((F.sum("_total") / F.count(file)).alias("avg_words"))


def distinct_items(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Every distinct item of every key as a row of its own, so that a group of any size spreads over many tasks."""
    return df.filter(F.col(item).isNotNull()).select(*keys, item).distinct()


def with_window(df: DataFrame, ts: str, size: str, slide: str | None = None) -> DataFrame:
    """Add ``window_start`` and ``window_end``; one row per window the time falls into."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (df.withColumn("_w", window).withColumn("window_start", F.col("_w.start"))
              .withColumn("window_end", F.col("_w.end")).drop("_w"))


def windowed_items(df: DataFrame, ts: str, size: str, by: Sequence[str], item: str) -> DataFrame:
    """Tumbling windows: the distinct items of each group, one row each."""
    return distinct_items(with_window(df, ts, size), ["window_start", "window_end", *by], item)


def items_per_window(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact number of items per window and group, from one row per distinct item; the same on a stream of such rows."""
    return items.groupBy("window_start", "window_end", *by).agg(F.count(F.lit(1)).alias("n_items"))


def windowed_distinct_approx(df: DataFrame, ts: str | Column, size: str, by: Sequence[str], item: str) -> DataFrame:
    """Tumbling windows: approximate number of distinct items, with a state of fixed size per group."""
    counted = df.groupBy(F.window(ts, size).alias("window"), *by).agg(F.approx_count_distinct(item).alias("n_items"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n_items")


def windowed_sketches(df: DataFrame, ts: str, size: str, by: Sequence[str], item: str, bits: int = 14) -> DataFrame:
    """Tumbling windows: a mergeable sketch of the distinct items of each group, of at most ``2^bits`` bytes and a few.

    Stored once, it answers for longer windows and for fewer columns (``merged_counts``) without
    the rows. With 14 bits, up to some 1 500 items are counted all but exactly; beyond, the
    standard error is 1.04 / 2^(bits / 2), 0.8 %.
    """
    return with_window(df.filter(F.col(item).isNotNull()), ts, size).groupBy("window_start", "window_end", *by).agg(
        F.hll_sketch_agg(item, F.lit(bits)).alias("sketch"))


def merged_counts(sketches: DataFrame, size: str, by: Sequence[str]) -> DataFrame:
    """Number of distinct items per longer window and group, from the sketches of shorter windows inside it."""
    longer = with_window(sketches.select(F.col("window_start").alias("_start"), *by, "sketch"), "_start", size)
    merged = longer.groupBy("window_start", "window_end", *by).agg(F.hll_union_agg("sketch").alias("_merged"))
    return merged.select("window_start", "window_end", *by, F.hll_sketch_estimate("_merged").alias("n_items"))


def running_items(df: DataFrame, ts: str, size: str, by: Sequence[str], item: str, late: str | None = None) -> DataFrame:
    """The rows of ``windowed_items`` on a stream, each sent on when its item is first met.

    With ``late`` a window is forgotten that long after its end; without it the state holds
    every item of every window.
    """
    if late:
        df = df.withWatermark(ts, late)
    window = F.window(ts, size).alias("window")
    found = df.filter(F.col(item).isNotNull()).select(window, *by, item).dropDuplicates(["window", *by, item])
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, item)


def running_distinct_counts(df: DataFrame, ts: str, size: str, by: Sequence[str], item: str, late: str) -> DataFrame:
    """Exact number of distinct items per tumbling window and group on a stream, in one append query.

    Two stateful steps follow each other: repeats of an item in a window are dropped, then the
    window's items are counted. Both forget a window once the watermark, ``late`` behind the
    latest row, has passed its end; that is when its counts are sent on.
    """
    seen = (df.withWatermark(ts, late).filter(F.col(item).isNotNull())
              .select(F.window(ts, size).alias("window"), *by, item).dropDuplicates(["window", *by, item]))
    counted = seen.groupBy("window", *by).agg(F.count(F.lit(1)).alias("n_items"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n_items")


def sliding_avg(df: DataFrame, ts: str | Column, value: str, by: Sequence[str], size: str = "30 minutes",
                slide: str = "10 minutes", name: str = "avg_value") -> DataFrame:
    """Mean of ``value`` per sliding window and group."""
    return (df.groupBy(F.window(ts, size, slide).alias("window"), *by).agg(F.avg(value).alias(name))
              .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *by, name))
