"""The duplicate-aware equi-join aggregate: match count and two checksums, without making the pairs.

With c_X(k) the multiplicity of k in X: count = sum c_R c_S, checksum1 = sum h(k) c_R c_S and checksum2 = sum h(k xor golden) c_R c_S,
h = splitmix64, all modulo 2^64.  `eager` aggregates both sides by key before joining; partial aggregation then sends at most one row
per key and task, so hot keys need no special care, and the join reuses the aggregates' partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions import u64
from keyfold.operators import partition

STRATEGIES = ("eager", "buildagg", "rows", "naive")
VERIFY_ROWS = 500


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """(key, n): how often each key occurs."""
    return df.groupBy(F.col(key).cast("bigint").alias("key")).agg(F.count("*").alias("n"))


def _matches(r: DataFrame, s: DataFrame, key_r: str, key_s: str, strategy: str) -> DataFrame:
    """(key, m): m pairs of that key; a key may come in several rows."""
    left, right = r.select(F.col(key_r).cast("bigint").alias("key")), s.select(F.col(key_s).cast("bigint").alias("key"))
    if strategy == "eager":
        return multiplicity(left, "key").withColumnRenamed("n", "a").join(multiplicity(right, "key"), "key").select("key", (F.col("a") * F.col("n")).alias("m"))
    if strategy == "buildagg":
        return right.join(multiplicity(left, "key"), "key").select("key", F.col("n").alias("m"))
    if strategy == "rows":
        return left.join(right, "key").select("key", F.lit(1).cast("bigint").alias("m"))
    if strategy == "naive":
        other = right.withColumnRenamed("key", "k2")
        return left.join(other, (F.col("key") <= F.col("k2")) & (F.col("key") >= F.col("k2"))).select("key", F.lit(1).cast("bigint").alias("m"))
    raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")


def checksums(matches: DataFrame, *by: str) -> DataFrame:
    """(*by, join_count, checksum1, checksum2), all unsigned, of (key, m) rows."""
    key, m = F.col("key"), F.col("m")
    with u64.wrapping(matches.sparkSession):
        first: Column = u64.splitmix64(key) * m
        second: Column = u64.splitmix64(key.bitwiseXOR(u64.lit(u64.GOLDEN))) * m
        rows = matches.select(*by, "m", first.alias("a"), second.alias("b"))
        sums = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")) for c in ("m", "a", "b")]
        total = rows.groupBy(*by).agg(*(x.alias(n) for x, n in zip(sums, "mab", strict=True)))
        return total.select(*by, *(u64.to_decimal(F.col(c)).alias(n) for c, n in zip("mab", ("join_count", "checksum1", "checksum2"), strict=True)))


def checksum_join(r: DataFrame, s: DataFrame, key_r: str = "key", key_s: str = "key", strategy: str = "eager") -> DataFrame:
    """One row (join_count, checksum1, checksum2); null keys match nothing, an empty join gives zeros."""
    with u64.wrapping(r.sparkSession):
        matches = _matches(r, s, key_r, key_s, strategy)
    return checksums(matches)


def rank_partials(r: DataFrame, s: DataFrame, key_r: str, key_s: str, p: int, ranks: int, strategy: str = "block") -> DataFrame:
    """(owner, join_count, checksum1, checksum2): each owner's share; their sums are the whole result."""
    with u64.wrapping(r.sparkSession):
        matches = _matches(r, s, key_r, key_s, "eager").withColumn("owner", partition.owner(partition.partition_id(F.col("key"), p), p, ranks, strategy))
    return checksums(matches, "owner")


def verified(r: DataFrame, s: DataFrame, key_r: str = "key", key_s: str = "key") -> bool | None:
    """Whether the eager and the all-pairs result agree; None (not run) if a side has over VERIFY_ROWS rows."""
    if any(x.limit(VERIFY_ROWS + 1).count() > VERIFY_ROWS for x in (r, s)):
        return None
    return checksum_join(r, s, key_r, key_s).first() == checksum_join(r, s, key_r, key_s, "naive").first()
