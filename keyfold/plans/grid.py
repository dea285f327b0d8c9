"""Parameter grids: every combination of the values, less those whose processes don't divide evenly over their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parameters of a campaign.
PARAMETERS = (
    "node", "mpi_process", "n", "p", "seed", "max_key", "dataset_type", "partition_thread", "join_thread",
    "partition_schedule", "join_schedule", "partition_chunk", "join_chunk", "partition_block_size", "mpi_partition_strategy",
)


def expand(spark: SparkSession, values: dict[str, list], repeats: int = 1) -> DataFrame:
    """One row for each run, with its number `repeat`; every parameter needs a value."""
    missing = [k for k in PARAMETERS if not values.get(k)]
    if missing:
        raise ValueError(f"no values for {', '.join(missing)}")
    out = spark.range(1, repeats + 1).select(F.col("id").cast("int").alias("repeat"))
    for k in PARAMETERS:
        out = out.withColumn(k, F.explode(F.array(*map(F.lit, values[k]))))
    return out.where("mpi_process >= node and mpi_process % node = 0")
