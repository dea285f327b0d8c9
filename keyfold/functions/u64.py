"""Unsigned 64-bit arithmetic on BIGINT bit patterns.

Spark's integers wrap only outside ANSI mode, and whether an expression wraps is settled when its DataFrame is built.  Build
such DataFrames inside wrapping(); the session's setting is as before afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The splitmix64 increment and multipliers, and what the second relation's seed and checksum are xored with.
GOLDEN = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SECOND_SEED = 0xDEADEBDECDEEDEF1


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """DataFrames built inside have arithmetic modulo 2^64."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def signed(value: int) -> int:
    """The BIGINT with the bits of an unsigned value."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def lit(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def mix(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * lit(MULTIPLIERS[0])
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * lit(MULTIPLIERS[1])
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def splitmix64(x: Column) -> Column:
    return mix(x + lit(GOLDEN))


def draw(seed: int, j: Column) -> Column:
    """Draw j, from 0, of the stream of a seed; any draw stands alone."""
    return mix(lit(seed) + (j + lit(1)) * lit(GOLDEN))


def umod(x: Column, m: int) -> Column:
    """x modulo m, both unsigned, 0 < m < 2^62."""
    return (F.shiftrightunsigned(x, 1) % lit(m) * lit(2) + x.bitwiseAND(lit(1))) % lit(m)


def to_decimal(x: Column) -> Column:
    """The unsigned value as DECIMAL(20, 0)."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, (d + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(d)


def div(a: Column | int, b: Column | int) -> Column:
    """Whole quotient of numbers that are not negative, without doubles."""
    wide = [F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (a, b)]
    return F.call_function("div", *wide)
