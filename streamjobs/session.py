"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

_local_folders: dict[str, str] = {}


def build_session(app: str = "streamjobs", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC time.

    ``master`` is left to spark-submit when not given; ``conf`` holds further
    settings with ``__`` in place of dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="streamjobs-")
        log.warning("spark.checkpoint.dir is not set: intermediate tables go to %s", _local_folders[app])
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/streamjobs/{app}/{label}-{uuid.uuid4().hex}"


def delete_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/streamjobs/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that later steps see one fixed set of rows, also after
    an executor is lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
