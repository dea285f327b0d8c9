"""Deterministic relations: uniform, and skewed towards the keys of a few hot partitions.

A record of a skewed set takes one draw r, or two where r % 100 < skew: then the second picks a key from the pool.  Whether a draw
begins a record depends only on the run of hot draws just before it, and any draw can be computed alone; so each chunk of draws is made by itself,
looking back to the last draw that is not hot.  A first pass counts the records that begin in each chunk, running sums of these counts
give the records' ordinals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions import shipping, u64
from keyfold.operators import partition

CHUNK = 1 << 18


@dataclass(frozen=True)
class Spec:
    """`uniform`, or `skewed_A_B`: A percent of the records fall on the keys of B percent of the partitions."""

    name: str
    skew: int = 0
    hot: int = 0

    @classmethod
    def parse(cls, text: str) -> Spec:
        if text == "uniform":
            return cls(text)
        m = re.fullmatch(r"skewed_(\d+)_(\d+)", text)
        if not m or int(m[1]) > 100 or not 1 <= int(m[2]) <= 100:
            raise ValueError(f"a dataset is uniform or skewed_<0..100>_<1..100>, not {text!r}")
        return cls(text, int(m[1]), int(m[2]))

    def hot_partitions(self, p: int) -> int:
        return max(1, -(-p * self.hot // 100))


def second_seed(seed: int) -> int:
    """The seed of S for R's seed."""
    return seed ^ u64.SECOND_SEED


def uniform(spark: SparkSession, n: int, seed: int, max_key: int, begin: int = 0) -> DataFrame:
    """(i, key) of records begin..n."""
    with u64.wrapping(spark):
        key = u64.umod(u64.draw(seed, F.col("id")), max_key) if max_key else F.lit(0).cast("bigint")
        return spark.range(begin, max(n, begin)).select(F.col("id").alias("i"), key.alias("key"))


def pool(spark: SparkSession, p: int, max_key: int, hot_percent: int) -> DataFrame:
    """(idx, key): the keys of the hot partitions, ascending, with their ordinals."""
    hot = Spec("", 0, hot_percent).hot_partitions(p)
    keys = spark.range(max(max_key, 1)).select(F.col("id").alias("key")).where(partition.partition_id(F.col("key"), p) < hot)
    return partition.ordinal(keys, "key", "idx").select("idx", "key")


def draws(seed: int, begin: int, end: int) -> np.ndarray:
    """Draws begin..end of a stream, in numpy."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + (np.arange(begin, end, dtype=np.uint64) + np.uint64(1)) * np.uint64(u64.GOLDEN)
        for shift, multiplier in zip((30, 27), u64.MULTIPLIERS, strict=True):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(multiplier)
        return x ^ x >> np.uint64(31)


def starts(seed: int, skew: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of draws begin..end begin a record, and the draws begin..end+1."""
    back = begin
    while back > 0:  # to just behind the last draw that is not hot
        lower = max(0, back - 64)
        cold = np.flatnonzero(draws(seed, lower, back) % np.uint64(100) >= skew)
        if len(cold):
            back = lower + int(cold[-1]) + 1
            break
        back = lower
    r = draws(seed, back, end + 1)
    hot = r[:-1] % np.uint64(100) < skew
    at = np.arange(back, end)
    last = np.maximum.accumulate(np.where(hot, back - 1, at))
    before = np.concatenate(([back - 1], last[:-1]))
    return ((at - 1 - before) % 2 == 0)[begin - back :], r[begin - back :]


def skewed(spark: SparkSession, n: int, seed: int, max_key: int, p: int, spec: Spec, begin: int = 0, end: int | None = None) -> DataFrame:
    """(i, key) of records begin..end of n; only chunks with some of them are made."""
    end = n if end is None else min(end, n)
    if not spec.skew or not n:
        return uniform(spark, n, seed, max_key)
    shipping.ship(spark)
    keys = pool(spark, p, max_key, spec.hot)
    size = keys.count()
    chunks = -(-2 * n // CHUNK)
    ids = spark.range(0, chunks, 1, min(chunks, max(spark.sparkContext.defaultParallelism, chunks // 16)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_of = [int(starts(seed, spec.skew, c * CHUNK, (c + 1) * CHUNK)[0].sum()) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_of, pa.int64())], ["id", "n"])

    counts = ids.mapInArrow(count, "id long, n long")
    base = F.coalesce(F.sum("n").over(Window.orderBy("id").rowsBetween(*partition.BEFORE)), F.lit(0))  # a row for each chunk
    placed = counts.select("id", "n", base.alias("base")).where((F.col("base") < end) & (F.col("base") + F.col("n") > begin)).select("id", "base").repartition(ids.rdd.getNumPartitions(), "id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begin, r = starts(seed, spec.skew, c * CHUNK, (c + 1) * CHUNK)
                at = np.flatnonzero(begin)[: max(0, n - first)]
                hot = r[at] % np.uint64(100) < spec.skew
                cold = (r[at] % np.uint64(max_key) if max_key else np.zeros(len(at))).astype(np.int64)
                idx = np.where(hot, (r[at + 1] % np.uint64(size)).astype(np.int64), -1 - np.arange(len(at)))  # no pool has these, and no two rows of a chunk share one
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(at))), pa.array(cold), pa.array(idx)], ["i", "cold", "idx"])

    rows = placed.mapInArrow(make, "i long, cold long, idx long")
    if begin or end < n:
        rows = rows.where((F.col("i") >= begin) & (F.col("i") < end))
    found = rows.join(keys, "idx", "left")  # broadcast by the optimizer where the pool is small
    return found.select("i", F.coalesce("key", "cold").alias("key"))


def relation(spark: SparkSession, n: int, seed: int, max_key: int, p: int, dataset: str) -> DataFrame:
    """(i, key) of the named dataset."""
    spec = Spec.parse(dataset)
    return skewed(spark, n, seed, max_key, p, spec) if spec.skew else uniform(spark, n, seed, max_key)


def relation_slice(spark: SparkSession, n: int, begin: int, end: int, seed: int, max_key: int, p: int, dataset: str) -> DataFrame:
    """Records begin..end of the relation of n."""
    spec = Spec.parse(dataset)
    if not spec.skew:
        return uniform(spark, min(end, n), seed, max_key, begin)
    return skewed(spark, n, seed, max_key, p, spec, begin, end)
