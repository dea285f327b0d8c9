"""Do runs of the same kind agree?  Verified runs vouch for themselves; all others of a group must equal its first by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME = ("join_count", "checksum1", "checksum2")


def groups(parsed: DataFrame, *by: str) -> DataFrame:
    """(by.., n_runs, n_verified, n_outcomes, ok) of complete logs; n_outcomes: distinct results of runs that aren't verified."""
    by = by or ("executable", "dataset_type")
    outcome = F.when(~F.col("verified"), F.struct(*OUTCOME))
    g = parsed.where("complete").groupBy(*by).agg(F.count("*").alias("n_runs"), F.count_if("verified").alias("n_verified"), F.count_distinct(outcome).alias("n_outcomes"))
    return g.withColumn("ok", F.col("n_outcomes") <= 1)


def mismatches(parsed: DataFrame, *by: str) -> DataFrame:
    """(by.., path, outcome columns) of runs that differ from the first unverified one of their group."""
    by = by or ("executable", "dataset_type")
    rows = parsed.where("complete and not verified").select(*by, "path", *OUTCOME)
    first = rows.groupBy(*by).agg(F.min_by(F.struct(*OUTCOME), "path").alias("first"))
    joined = rows.join(first, list(by))
    same: Column = F.struct(*OUTCOME) == F.col("first")
    return joined.where(~same).drop("first")


def status(parsed: DataFrame) -> int:
    """0: all agree; 1: a run is marked as failed, or runs differ; 2: no log, or one that lacks a value."""
    seen = parsed.agg(F.count("*").alias("n"), F.count_if(~F.col("complete")).alias("missing"), F.count_if(F.col("has_verified_field") & ~F.col("verified")).alias("failed")).first()
    if not seen["n"] or seen["missing"]:
        return 2
    return int(bool(seen["failed"]) or not groups(parsed).where("not ok").isEmpty())
