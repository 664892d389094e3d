"""Progress of running queries as a table."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from streamjobs.session import fresh_path
from streamjobs.sources.logs import PHASES

SCHEMA = T.StructType([T.StructField("query", T.StringType()), T.StructField("batch_id", T.LongType()),
                       T.StructField("input_rows", T.LongType()), T.StructField("late_rows", T.LongType()), T.StructField("state_rows", T.LongType()),
                       T.StructField("observed", T.MapType(T.StringType(), T.LongType())),
                       *[T.StructField(n, T.LongType()) for n in PHASES]])


def _row(progress: dict) -> tuple:
    durations = progress.get("durationMs", {})
    late = sum(s.get("numRowsDroppedByWatermark", 0) for s in progress.get("stateOperators", []))
    state = sum(s.get("numRowsTotal", 0) for s in progress.get("stateOperators", []))
    observed = {f"{name}.{metric}": value for name, metrics in (progress.get("observedMetrics") or {}).items() for metric, value in metrics.items()}
    return (progress.get("name") or progress["id"], progress["batchId"], progress.get("numInputRows"), late, state, observed,
            *[durations.get(key) for key in PHASES.values()])


def observed(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """``df``, with the number of rows that meet each condition reported per trigger, under ``name.condition``.

    The counts are taken while the rows pass; the recorder has them in the map ``observed``.
    """
    return df.observe(name, *[F.count_if(condition).alias(c) for c, condition in conditions.items()])


class ProgressRecorder(StreamingQueryListener):
    """Appends the progress records of all queries to a table in the shared folder, ``every`` so many at once."""

    def __init__(self, spark: SparkSession, every: int = 50):
        self._spark, self._every, self._path = spark, every, fresh_path(spark, "progress-records")
        self._held: list[tuple] = []
        self._lock = threading.Lock()

    @classmethod
    @contextmanager
    def on(cls, spark: SparkSession, every: int = 50) -> Iterator[ProgressRecorder]:
        """A recorder that listens inside the block."""
        recorder = cls(spark, every)
        spark.streams.addListener(recorder)
        try:
            yield recorder
        finally:
            spark.streams.removeListener(recorder)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        with self._lock:
            self._held.append(_row(json.loads(event.progress.json)))
            if len(self._held) >= self._every:
                self._flush()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def _flush(self) -> None:
        if self._held:
            self._spark.createDataFrame(self._held, SCHEMA).coalesce(1).write.mode("append").parquet(self._path)
            self._held = []

    def table(self) -> DataFrame:
        """All records of triggers that have ended."""
        self._spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self._lock:
            self._flush()
        if not self._spark._jvm.org.apache.hadoop.fs.Path(self._path).getFileSystem(
                self._spark._jsc.hadoopConfiguration()).exists(self._spark._jvm.org.apache.hadoop.fs.Path(self._path)):
            return self._spark.createDataFrame([], SCHEMA)
        return self._spark.read.schema(SCHEMA).parquet(self._path)


def progress_table(recorder: ProgressRecorder, query: StreamingQuery | str) -> DataFrame:
    """All progress records of a query, given as such or by its name."""
    name = query if isinstance(query, str) else query.name or str(query.id)
    return recorder.table().filter(F.col("query") == name)


def watch(query: StreamingQuery, report, seconds: float = 1.0) -> None:
    """Report status and last progress while the query is active."""
    while query.isActive:
        report(query.status, query.lastProgress)
        time.sleep(seconds)
