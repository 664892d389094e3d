"""Sinks for batch and streaming results."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streamjobs.functions.envelope import schema_envelope
from streamjobs.session import fresh_path, written


@dataclass(frozen=True)
class Sink:
    format: str
    options: dict[str, str] = field(default_factory=dict)


def kafka_sink(servers: str, topic: str) -> Sink:
    return Sink("kafka", {"kafka.bootstrap.servers": servers, "topic": topic})


def file_sink(path: str, format: str = "parquet", **options: str) -> Sink:
    return Sink(format, {"path": path, **options})


def start(df: DataFrame, sink: Sink, mode: str = "append", checkpoint: str | None = None, name: str | None = None,
          every: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a query. ``every`` is a processing-time trigger; ``available_now`` ends with the present input."""
    writer = df.writeStream.format(sink.format).options(**sink.options).outputMode(mode)
    return _launch(writer, df.sparkSession, checkpoint, name, every, available_now)


def _launch(writer, spark: SparkSession, checkpoint, name, every, available_now) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint or fresh_path(spark, "progress"))
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def start_foreach_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "update",
                        checkpoint: str | None = None, name: str | None = None, every: str | None = None,
                        available_now: bool = False) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).outputMode(mode)
    return _launch(writer, df.sparkSession, checkpoint, name, every, available_now)


def enveloped(write: Callable[[DataFrame, int], None], typed: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch handler that hands every row on as one schema-and-payload text."""
    return lambda batch, batch_id: write(schema_envelope(batch, typed), batch_id)


def table_writer(url: str, table: str, mode: str = "append", **options: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes to a database table, which is made if absent."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()

    return handle


def run_for(query: StreamingQuery, seconds: float | None) -> StreamingQuery:
    """Wait for the query, at most ``seconds``, then stop it."""
    query.awaitTermination(seconds) if seconds is not None else query.awaitTermination()
    query.stop()
    return query


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.option("header", True).mode(mode).csv(path)


def append_result(row: DataFrame, path: str) -> None:
    """Add result rows to a table of runs."""
    row.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = 1_000_000) -> None:
    """One folder per value of ``by``; every task gets about ``rows_per_file`` rows, of one folder or of several small ones.

    The folders lie one behind the other on a line with a place per row. A row goes to a place of
    its folder by its hash, and each stretch of ``rows_per_file`` places is a task: no two large
    files meet in one task, as they would if they were dealt by a hash. The rows are written once
    before, so that they are not computed for the counts and again for the files.
    """
    df = written(df, "undealt")
    counts = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(*[f"_by_{c}" for c in by])  # a row per folder
    folders = written(counts.withColumn("_end", F.sum("_rows").over(before)), "folders")
    total = folders.agg(F.max("_end")).first()[0] or 0
    n_tasks = max(1, math.ceil(total / rows_per_file))
    same = reduce(and_, [df[c].eqNullSafe(folders[f"_by_{c}"]) for c in by])
    share = F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.lit(1 << 20)) / (1 << 20)
    place = F.col("_end") - F.col("_rows") + share * F.col("_rows")
    task = F.floor(place * n_tasks / max(1, total)).cast("int")
    dealt = df.join(F.broadcast(folders), same).withColumn("_task", task).repartitionById(n_tasks, "_task")
    dealt.select(*[df[c] for c in df.columns]).write.partitionBy(*by).parquet(path)


def single_file(df: DataFrame) -> DataFrame:
    """All rows in one partition, for a small report only: a single task writes it."""
    return df.repartition(1)
