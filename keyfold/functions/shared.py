"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_LOCAL = "file:///tmp/checkpoints"
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; where driver and executors are one process (tests), else a folder under /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _LOCAL).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/keyfold-{what}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_remove_all)
    _scratch.append((spark, path))
    return path


def _remove_all() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob, in order; none if there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().toString() for x in found or [])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
