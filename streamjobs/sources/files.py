"""Files as messages and experiment tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.functions.scalar import after_last
from streamjobs.operators.ordered import row_numbers

log = logging.getLogger(__name__)

NUMBERED_SEPARATOR = "rrrr "


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files without a header, by schema."""
    return spark.read.schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def repeat_lines(lines: DataFrame, times: int) -> DataFrame:
    """The whole set of line messages ``times`` times over."""
    return lines.select("value", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("round"))


def lines_to_messages(spark: SparkSession, path: str, times: int = 1) -> DataFrame:
    """Each line of the files is a message."""
    return repeat_lines(spark.read.text(path), times)


def tag_messages(files: DataFrame, order: str, topic: str = "topic", text: str = "value") -> DataFrame:
    """Append `` Topic: t File: i`` to each file's text, i counting the files of a topic from 1 by ``order``.

    Only the names are sorted and numbered; the texts move once, to meet their
    numbers. ``order`` must be unique within a topic.
    """
    numbers = row_numbers(files.select(topic, order), [topic], [order], "file_no", start=1)
    numbered = files.join(numbers, [topic, order])
    tagged = F.concat(F.col(text), F.lit(" Topic: "), F.col(topic), F.lit(" File: "),
                      F.col("file_no").cast("string"))
    return numbered.select(topic, "file_no", tagged.alias("value"))


def files_to_messages(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Each file is one tagged message, numbered in the order of the paths."""
    files = (spark.read.text(path, wholetext=True)
             .select("value", F.lit(topic).alias("topic"), F.col("_metadata.file_path").alias("path")))
    return tag_messages(files, "path")


def number_copies(messages: DataFrame, times: int, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Each text ``times`` times, each copy ending in the separator and its number."""
    copies = messages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return copies.select(*keep, "copy", F.concat(F.col(text), F.lit(NUMBERED_SEPARATOR),
                                                 F.col("copy").cast("string")).alias("value"))


def replay_file(spark: SparkSession, path: str, times: int) -> DataFrame:
    """One file's content as ``times`` numbered messages."""
    return number_copies(spark.read.text(path, wholetext=True), times)


def read_experiment(spark: SparkSession, path: str, index: str | None = "run_index",
                    schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; the first column becomes the index, whatever its name.

    Without ``schema`` the types are found by reading the file once more.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.withColumnRenamed(df.columns[0], index) if index else df


def read_experiments(spark: SparkSession, paths: Sequence[str], index: str | None = "run_index") -> list[DataFrame]:
    """The tables that exist; a missing file is reported and skipped."""
    frames = []
    for path in paths:
        try:
            frames.append(read_experiment(spark, path, index))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            log.warning("no file %s", path)
    return frames


def read_box_settings(df: DataFrame) -> DataFrame:
    """Latency text per setting (one column each) as (setting, latency_s) rows.

    Rows with a null anywhere are dropped; the number after the last colon counts.
    """
    complete = df.dropna("any")
    return complete.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("setting"), after_last(F.col(f"`{c}`").cast("string")).try_cast("double").alias("latency_s"))
        for c in df.columns])))


def metric_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per metric of a nested JSON catalogue."""
    beans = spark.read.option("multiLine", True).json(path)
    return explode_catalogue(beans)


def explode_catalogue(beans: DataFrame) -> DataFrame:
    values = beans.select("MBean", "ObjectName", F.explode("Values").alias("v"))
    return values.select(F.col("MBean").alias("bean"), F.col("ObjectName").alias("object_name"),
                         F.col("v.Type").alias("kind"), F.col("v.InstancePrefix").alias("metric"),
                         F.col("v.Attribute").alias("attribute"))
