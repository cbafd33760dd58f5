"""A SparkSession with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Sets the folder of spark.checkpoint.dir. Where that is unset, a local master gets a temporary one, and a cluster raises."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidewatch-")
    spark.sparkContext.setCheckpointDir(at)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which the driver and all executors see."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def session(name: str = "tidewatch", **more: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
