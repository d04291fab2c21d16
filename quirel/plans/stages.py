"""Cutting a plan where several queries read the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Sizes up to which Spark broadcasts a join's side: by its estimate before a run, and by its measure within one.
_ESTIMATED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def broadcast_by_measure(spark: SparkSession) -> None:
    """From now on the session broadcasts a join's side by what an adaptive run has measured, up to the size that held for estimates.

    Estimates come from file sizes. A table that compresses well and the many objects that are made of a row are taken for far less
    than they are, most of all a few columns beside VARIANT ones, and the driver collects what is broadcast. Hints stay.
    """
    held = spark.conf.get(_ESTIMATED)
    if held != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get(_MEASURED, None) is None:
            spark.conf.set(_MEASURED, held)
        spark.conf.set(_ESTIMATED, "-1")


def materialize(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed in the session's shared folder; kept in memory only where that is unset and the driver runs all tasks."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.persist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to four tasks a core, and not to fewer where its rows are few bytes: for work that takes long for its bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path below spark.checkpoint.dir; a temporary one only where that is unset and the driver runs all tasks."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='quirel-')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: unlike a checkpoint it can be joined to what is made of it."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
