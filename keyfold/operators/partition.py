"""Key partitioning and layouts as queries: ids, owners, histograms, offsets, exchange counts, positions.

Windows run over summaries (partitions, blocks, ranks) or within one block of rows, never over a whole relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions.u64 import div

BEFORE = (Window.unboundedPreceding, -1)
#: Rows that a rank can send at once.
MOST = (1 << 31) - 1


def check_partitions(p: int) -> int:
    if p <= 0 or p & (p - 1) or p > 1 << 31:
        raise ValueError(f"the number of partitions must be a power of two up to 2^31, not {p}")
    return p


def partition_id(key: Column, p: int) -> Column:
    """Three xor-shifts of the unsigned key, then its low bits."""
    check_partitions(p)
    for shift in (33, 17, 9):
        key = key.bitwiseXOR(F.shiftrightunsigned(key, shift))
    return key.bitwiseAND(F.lit(p - 1).cast("bigint")).cast("int")


def owner(pid: Column, p: int, ranks: int, strategy: str = "block") -> Column:
    """The rank that owns a partition."""
    if strategy == "cyclic":
        return (pid % ranks).cast("int")
    if strategy == "block":
        wide = (pid.cast("bigint") + 1) * F.lit(ranks).cast("bigint") - 1
        return F.least(div(wide, p), F.lit(ranks - 1)).cast("int")
    raise ValueError(f"strategy must be block or cyclic, not {strategy!r}")


def row_ranges(spark: SparkSession, n: int, active: int, world: int | None = None) -> DataFrame:
    """(rank, begin, end): the rows of each rank; ranks beyond the active ones have none."""
    rank = F.col("id")
    here = rank < active
    return spark.range(world or active).select(
        rank.cast("int").alias("rank"),
        F.when(here, div(rank * n, active)).otherwise(0).cast("bigint").alias("begin"),
        F.when(here, div((rank + 1) * n, active)).otherwise(0).cast("bigint").alias("end"),
    )


def rank_of(i: Column, n: int, active: int) -> Column:
    """The rank whose row range has ordinal i."""
    return div((i + 1) * active - 1, n).cast("int")


def ordinal(df: DataFrame, by: str, name: str = "i", width: int = 1 << 16) -> DataFrame:
    """df with each row's place, from 0, in the order of a unique integral column: one sort per chunk of values, one sum over the chunks' counts.

    Chunks are equally wide (a power of two), so that one has about `width` rows, however far apart the values are.
    """
    low, high, n = df.agg(F.min(F.col(by).cast("bigint")), F.max(F.col(by).cast("bigint")), F.count(by)).first()
    span = (high - low + 1) * width // n if n else width
    chunk = F.shiftright(F.col(by).cast("bigint"), max(0, min(63, span.bit_length() - 1)))
    counts = df.groupBy(chunk.alias("__chunk")).count()
    starts = counts.select("__chunk", F.coalesce(F.sum("count").over(Window.orderBy("__chunk").rowsBetween(*BEFORE)), F.lit(0)).alias("__start"))
    ranked = df.withColumn("__chunk", chunk).withColumn("__n", F.row_number().over(Window.partitionBy("__chunk").orderBy(by)) - 1)
    return ranked.join(starts, "__chunk").withColumn(name, F.col("__start") + F.col("__n")).drop("__chunk", "__start", "__n")


def histogram(df: DataFrame, key: str, p: int) -> DataFrame:
    """(pid, cnt) for every partition, empty ones too."""
    counts = df.groupBy(partition_id(F.col(key), p).alias("pid")).agg(F.count("*").alias("cnt"))
    every = df.sparkSession.range(p).select(F.col("id").cast("int").alias("pid"))
    return every.join(counts, "pid", "left").select("pid", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def block_histogram(df: DataFrame, key: str, p: int, block: int, i: str = "i") -> DataFrame:
    """(block, pid, cnt) of blocks of consecutive rows; i: the rows' ordinals."""
    if block <= 0:
        raise ValueError("the block size must be positive")
    at = div(F.col(i), block)
    return df.groupBy(at.alias("block"), partition_id(F.col(key), p).alias("pid")).agg(F.count("*").alias("cnt"))


def offsets(hist: DataFrame) -> DataFrame:
    """(pid, cnt, begin): exclusive sums over partitions."""
    return hist.select("pid", "cnt", F.coalesce(F.sum("cnt").over(Window.orderBy("pid").rowsBetween(*BEFORE)), F.lit(0)).cast("bigint").alias("begin"))


def layout(df: DataFrame, key: str, p: int) -> DataFrame:
    """(pid, cnt, begin, end) of the partitioned relation."""
    return offsets(histogram(df, key, p)).withColumn("end", F.col("begin") + F.col("cnt"))


def block_offsets(df: DataFrame, key: str, p: int, block: int, i: str = "i") -> DataFrame:
    """(pid, block, cnt, start): where each block's rows of a partition begin."""
    blocks = block_histogram(df, key, p, block, i)
    begins = offsets(blocks.groupBy("pid").agg(F.sum("cnt").alias("cnt"))).select("pid", "begin")
    within = F.coalesce(F.sum("cnt").over(Window.partitionBy("pid").orderBy("block").rowsBetween(*BEFORE)), F.lit(0))
    return blocks.withColumn("within", within).join(begins, "pid").select("pid", "block", "cnt", (F.col("begin") + F.col("within")).cast("bigint").alias("start"))


def scatter(df: DataFrame, key: str, p: int, block: int, i: str = "i") -> DataFrame:
    """df with pid and position in the partitioned relation: stable, in the order of i within a partition."""
    rows = df.withColumn("pid", partition_id(F.col(key), p)).withColumn("block", div(F.col(i), block))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("block", "pid").orderBy(i)) - 1)
    starts = block_offsets(df, key, p, block, i).select("pid", "block", "start")
    return rows.join(starts, ["pid", "block"]).withColumn("position", (F.col("start") + F.col("__n")).cast("bigint")).drop("block", "start", "__n")


def exchange_matrix(df: DataFrame, key: str, n: int, p: int, ranks: int, strategy: str = "block", i: str = "i") -> DataFrame:
    """(src_rank, owner, cnt) for every pair: rows that a rank sends to each owner."""
    sent = df.groupBy(rank_of(F.col(i), n, ranks).alias("src_rank"), owner(partition_id(F.col(key), p), p, ranks, strategy).alias("owner")).agg(F.count("*").alias("cnt"))
    pairs = df.sparkSession.range(ranks * ranks).select(div(F.col("id"), ranks).cast("int").alias("src_rank"), (F.col("id") % ranks).cast("int").alias("owner"))
    return pairs.join(sent, ["src_rank", "owner"], "left").select("src_rank", "owner", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def displacements(matrix: DataFrame) -> DataFrame:
    """The matrix with displ: where each owner's rows begin in a rank's send buffer; an error where counts add up to more than MOST."""
    before = F.coalesce(F.sum("cnt").over(Window.partitionBy("src_rank").orderBy("owner").rowsBetween(*BEFORE)), F.lit(0)).cast("bigint")
    over = F.raise_error(F.concat(F.lit("displacements overflow at rank "), F.col("src_rank").cast("string"))).cast("bigint")
    return matrix.withColumn("displ", F.when(before + F.col("cnt") > MOST, over).otherwise(before))


def repartition_by_owner(df: DataFrame, key: str, p: int, ranks: int, strategy: str = "block") -> DataFrame:
    """df dealt so that Spark partition k holds exactly the rows that rank k owns."""
    return df.repartitionById(ranks, owner(partition_id(F.col(key), p), p, ranks, strategy))


def work_items(r: DataFrame, key_r: str, s: DataFrame, key_s: str, p: int, threads: int) -> DataFrame:
    """(pid, part, s_begin, s_end, work): probe slices of partitions with rows on both sides, sized to `threads` equal shares."""
    both = layout(s, key_s, p).select("pid", F.col("cnt").alias("s_cnt"), "begin").join(histogram(r, key_r, p).select("pid", F.col("cnt").alias("r_cnt")), "pid")
    both = both.withColumn("work", F.col("r_cnt") + F.col("s_cnt"))
    target = both.agg(F.greatest(div(F.sum("work") + threads - 1, threads), F.lit(1)).alias("target"))
    slices = F.least(F.greatest(div(F.col("work") + F.col("target") - 1, F.col("target")), F.lit(1)), F.lit(threads), F.col("s_cnt")).cast("int")
    both = both.join(F.broadcast(target)).where("r_cnt > 0 and s_cnt > 0").withColumn("slices", slices)  # target: one row
    both = both.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    at = [(F.col("begin") + div((F.col("part") + k) * F.col("s_cnt"), F.col("slices"))).cast("bigint") for k in (0, 1)]
    return both.select("pid", "part", at[0].alias("s_begin"), at[1].alias("s_end"), "work").orderBy(F.desc("work"), "pid", "part")
