"""Result rows as CSV: quoting, appending, and loading several files that differ in their columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import shared

#: File names that mean another name.
ALIASES = {"hybrid_uniform": "hybrid", "hybrid_skew1": "hybrid", "hybrid_skew2": "hybrid"}


def escape(field: Column) -> Column:
    """Quoted, with quotes doubled, where a comma, quote or line end asks for it."""
    return F.when(field.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


#: Columns of result files that are numbers.
WHOLE = ("join_count", "max_key", "nr", "ns", "p", "num_partitions", "mpi_nodes", "mpi_processes", "mpi_world_size", "mpi_active_ranks", "partition_threads",
         "join_threads", "partition_chunk", "join_chunk", "partition_block_size", "partition_task_grain", "join_task_grain", "offset_task_grain", "seed")
REAL = ("join_throughput", "join_time", "partition_throughput", "partition_time", "time_sec", "tot_sec", "total_throughput", "redistribution_time",
        "redistribution_throughput", "skew_fraction", "skew_partition_fraction")
NUMERIC = dict.fromkeys(("checksum1", "checksum2"), "decimal(20,0)") | dict.fromkeys(WHOLE, "decimal(20,0)") | dict.fromkeys(REAL, "double")
PATTERN = "hashjoin_*.csv"


def append(rows: DataFrame, path: str) -> None:
    """Append rows to the folder of CSV files, columns in alphabetical order; nothing to write is an error.

    Every part has its own header, and load() goes by it: appended rows may have other columns than those before.
    """
    if not rows.columns or rows.isEmpty():
        raise ValueError("there is no row to append")
    rows.select(*sorted(rows.columns)).write.mode("append").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def exec_type(stem: str) -> str:
    """The kind of run that a file's name tells."""
    name = re.sub("^hashjoin_", "", stem)
    return ALIASES.get(name, name)


def union(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames by file stem, tagged with exec_type; columns that a frame lacks are null."""
    tagged = [f.withColumn("exec_type", F.lit(exec_type(stem))) for stem, f in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line -> the files that have it, of a file or of the parts in a folder."""
    parts = shared.files(spark, f"{path.rstrip('/')}/*") or [path]
    parts = [p for p in parts if not p.rpartition("/")[2].startswith(("_", "."))]
    out: dict[str, list[str]] = {}
    for p in parts:
        out.setdefault(next((r["value"] for r in spark.read.text(p).take(1)), ""), []).append(p)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text of a CSV file or a folder of them, each read by its own header; columns that a part lacks are null."""
    options = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    frames = [options.csv(files) for header, files in sorted(_headers(spark, path).items()) if header]
    if not frames:
        raise ValueError(f"no CSV rows in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as text of the CSV files or folders in paths."""
    stems = {re.sub(r"\.csv$", "", p.rstrip("/").rpartition("/")[2]): p for p in paths}
    return union({s: read(spark, p) for s, p in stems.items()})


def load_first(spark: SparkSession, candidates: list[str], pattern: str = PATTERN) -> DataFrame:
    """The result files of the first folder that has any; none in all of them is an error."""
    for folder in candidates:
        if found := shared.files(spark, f"{folder.rstrip('/')}/{pattern}"):
            return load(spark, found)
    raise FileNotFoundError(f"no {pattern} in {', '.join(candidates)}")
