"""Run logs: files of name=value lines, one file for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a complete log names.
REQUIRED = ("executable", "dataset_type", "join_count", "checksum1", "checksum2")


def read(spark: SparkSession, folder: str, pattern: str = "slurm*") -> DataFrame:
    """(path, text) of the folder's log files."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _value(name: str) -> Column:
    """The value of the last of lines that is `name=...`, less a carriage return at its end; null if there is none."""
    last = F.try_element_at(F.filter("lines", lambda x: x.startswith(f"{name}=")), F.lit(-1))
    return F.regexp_replace(F.substring(last, len(name) + 2, 1 << 30), "\r$", "")


def parse(logs: DataFrame) -> DataFrame:
    """(path, the required values as text, has_verified_field, verified, complete) of (path, text) rows; complete: all are there, executable and dataset_type not empty."""
    out = logs.select("path", F.split("text", "\n").alias("lines")).select("path", *(_value(n).alias(n) for n in REQUIRED), _value("verified").alias("v"))
    complete = F.lit(True)
    for n in REQUIRED:
        complete = complete & (F.coalesce(F.col(n), F.lit("")) != "" if n in ("executable", "dataset_type") else F.col(n).isNotNull())
    return out.select("path", *REQUIRED, F.col("v").isNotNull().alias("has_verified_field"), F.coalesce(F.col("v").isin("true", "1"), F.lit(False)).alias("verified"), complete.alias("complete"))
