"""Message topics as DataFrames.

A ``Source`` names a format and its options, so that a job reads a broker topic
in production and a folder of files in a test without a change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Source:
    format: str
    options: dict[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None
    streaming: bool = True


def kafka_source(servers: str, topics: str | None = None, pattern: str | None = None,
                 starting: str = "earliest", fail_on_data_loss: bool = False, streaming: bool = True) -> Source:
    """Topics by comma list or by regular expression."""
    if (topics is None) == (pattern is None):
        raise ValueError("give either topics or a pattern")
    chosen = {"subscribe": topics} if topics is not None else {"subscribePattern": pattern}
    return Source("kafka", {"kafka.bootstrap.servers": servers, "startingOffsets": starting,
                            "failOnDataLoss": str(fail_on_data_loss).lower(), **chosen}, streaming=streaming)


def file_source(path: str, format: str = "parquet", schema: T.StructType | None = None, glob: str | None = None,
                streaming: bool = True, **options: str) -> Source:
    """A folder of files; new files are new messages."""
    extra = {"pathGlobFilter": glob} if glob else {}
    return Source(format, {"path": path, **extra, **options}, schema, streaming)


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """All columns of the source."""
    reader = spark.readStream if source.streaming else spark.read
    reader = reader.format(source.format).options(**source.options)
    if source.schema is not None:
        reader = reader.schema(source.schema)
    return reader.load()


def read_topic(spark: SparkSession, source: Source, with_timestamp: bool = False) -> DataFrame:
    """The messages as text in ``value``, with the broker's ``timestamp`` when asked for."""
    rows = read_source(spark, source)
    keep = ["timestamp"] if with_timestamp else []
    return rows.select(rows["value"].cast("string").alias("value"), *keep)
