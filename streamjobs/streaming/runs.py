"""Running a stream over the input there is, and reading the result as a table.

The results go through files in the shared folder, not through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.operators.ordered import row_numbers
from streamjobs.operators.sets import keep_last
from streamjobs.session import fresh_path
from streamjobs.streaming.ledger import BatchLedger
from streamjobs.streaming.sinks import file_sink, start, start_foreach_batch


def collect_append(df: DataFrame, name: str | None = None) -> DataFrame:
    """Result of an append-mode query."""
    path = fresh_path(df.sparkSession, "append")
    start(df, file_sink(path), "append", name=name, available_now=True).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _batches(df: DataFrame, mode: str) -> DataFrame:
    """Every emitted row with its batch; a repeated batch replaces itself."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, mode)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/b={batch_id}")

    start_foreach_batch(df, handle, mode, available_now=True).awaitTermination()
    schema = df.withColumn("_batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(f"{path}/*")


def collect_update(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result of an update-mode query: the last row emitted for each key."""
    return keep_last(_batches(df, "update"), keys, ["_batch"]).drop("_batch")


def collect_complete(df: DataFrame) -> DataFrame:
    """Result of a complete-mode query: what its last batch emitted, as the ledger names it."""
    ledger = BatchLedger(df.sparkSession, fresh_path(df.sparkSession, "complete"))
    start_foreach_batch(df, ledger.writer("complete"), "complete", available_now=True).awaitTermination()
    return ledger.last(df.schema, "complete")


def collect_ordered(df: DataFrame, place: str) -> DataFrame:
    """The last batch of a sorted complete-mode query, with every row's place in it, from 1."""
    ledger = BatchLedger(df.sparkSession, fresh_path(df.sparkSession, "ordered"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Sorted output comes in range partitions: the id rises with the order.
        ledger.write(batch.withColumn("_at", F.monotonically_increasing_id()), "ordered", batch_id)

    start_foreach_batch(df, handle, "complete", available_now=True).awaitTermination()
    schema = df.withColumn("_at", F.lit(0).cast("long")).schema
    return row_numbers(ledger.last(schema, "ordered"), [], ["_at"], place, 1).drop("_at")


def arrivals(df: DataFrame, number: Column, count: int, files: int = 2) -> DataFrame:
    """``df`` as a stream whose triggers get the rows numbered 0, 1, ... up to ``count``, one number after the other.

    Each part is written as ``files`` files after the one before it; the file source takes files by age.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "arrivals")
    for k in range(count):
        df.filter(number == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
