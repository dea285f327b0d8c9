"""The join aggregate over two growing streams of keys.

The aggregate needs only key multiplicities, and these add up: each micro-batch is counted by key and written as one table
under its batch number, so a batch that is replayed replaces itself.  The result so far is the eager join of the sums.  compact() sums
all batches but the last, which alone can be replayed, into one table, so that a result reads no more than what came since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfold.functions import shared, u64
from keyfold.operators import join


def count(stream: DataFrame, key: str, folder: str, side: str) -> StreamingQuery:
    """Count a stream's keys into folder until it has no more input now; side: R or S."""
    at = f"{folder.rstrip('/')}/{side}"

    def write(batch: DataFrame, number: int) -> None:
        join.multiplicity(batch, key).write.mode("overwrite").parquet(f"{at}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}.progress").trigger(availableNow=True).start()


def totals(spark: SparkSession, folder: str, side: str) -> DataFrame:
    """(key, n) over all batches of a side."""
    return _parts(spark, folder, side)[0].groupBy("key").agg(F.sum("n").alias("n"))


def _numbers(spark: SparkSession, at: str, name: str) -> list[int]:
    """The numbers of the tables that are whole."""
    return sorted(int(f.split(f"/{name}=")[-1].split("/")[0]) for f in shared.files(spark, f"{at}/{name}=*/_SUCCESS"))


def _parts(spark: SparkSession, folder: str, side: str) -> tuple[DataFrame, list[int]]:
    """(key, n) of the compacted table and the batches after it, and the numbers of these batches."""
    at = f"{folder.rstrip('/')}/{side}"
    upto = _numbers(spark, f"{at}.sums", "upto")[-1:]
    batches = [b for b in _numbers(spark, at, "batch") if not upto or b > upto[0]]
    paths = [f"{at}.sums/upto={u}" for u in upto] + [f"{at}/batch={b}" for b in batches]
    read = spark.read.schema("key long, n long")
    return (read.parquet(*paths) if paths else spark.createDataFrame([], "key long, n long")), batches


def compact(spark: SparkSession, folder: str, side: str) -> None:
    """Sum all batches but the last, and the sums so far, into one table; older sums and the batches in it are deleted once it is whole."""
    at = f"{folder.rstrip('/')}/{side}"
    batches = _numbers(spark, at, "batch")
    old = _numbers(spark, f"{at}.sums", "upto")
    last = [b for b in batches if not old or b > old[-1]][:-1]
    if last:
        read = spark.read.schema("key long, n long").parquet(*(f"{at}.sums/upto={u}" for u in old[-1:]), *(f"{at}/batch={b}" for b in last))
        read.groupBy("key").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{at}.sums/upto={last[-1]}")
    now = _numbers(spark, f"{at}.sums", "upto")
    for u in now[:-1]:
        shared.delete(spark, f"{at}.sums/upto={u}")
    for b in batches:
        if now and b <= now[-1]:
            shared.delete(spark, f"{at}/batch={b}")


def result(spark: SparkSession, folder: str) -> DataFrame:
    """(join_count, checksum1, checksum2) of what both sides have had so far."""
    r, s = (totals(spark, folder, x) for x in "RS")
    with u64.wrapping(spark):
        matches = r.withColumnRenamed("n", "a").join(s, "key").select("key", (F.col("a") * F.col("n")).alias("m"))
    return join.checksums(matches)
