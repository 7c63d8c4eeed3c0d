"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "corpusfreq", **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join handling switched on.

    Nothing else is forced: master, memory and shuffle partitions belong to the
    cluster that runs the job and can be passed as ``conf`` (dots as ``__``).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def application_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path in the shared folder."""
    return f"{application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete what ``new_shared_path`` and ``durable`` have stored for this application.

    Tables that read it must not be used afterwards.
    """
    context = spark.sparkContext
    # Spark's own checkpoints lie in a folder of this run below the shared one.
    for name in (application_dir(spark), context.getCheckpointDir()):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    named = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(named or posixpath.dirname(context.getCheckpointDir()))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Unlike ``durable`` the planner knows its size and reads single columns of it.
    """
    path = new_shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
