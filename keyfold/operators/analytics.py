"""Analytics of benchmark runs: cleaning, averages, best configurations, speedups, skew penalty and scaling.

Frames have one row for each run or configuration; group keys may be null, and null equals null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBLEM = ("nr", "ns", "max_key")
#: The order in which kinds of run are listed.
EXEC_ORDER = ("seq", "omp", "mpi", "hybrid", "omp_loop", "omp_loop_wb", "omp_task", "omp_task_wb", "omp_taskloop", "omp_taskloop_wb")


def positive(x: Column) -> Column:
    """x, or null where it isn't above zero."""
    return F.when(x > 0, x)


def throughput(n: Column, seconds: Column) -> Column:
    """Rows a second; 0 where no time was taken."""
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(n / seconds)


def normalize(runs: DataFrame, numeric: dict[str, str]) -> DataFrame:
    """numeric: column -> type, such as sources.results.NUMERIC.  Text to numbers (null where it is none), and the columns tot_sec, time_sec, dataset_type and total_throughput filled in."""
    for c, kind in numeric.items():
        if c in runs.columns:
            runs = runs.withColumn(c, F.col(c).try_cast(kind))
    for a, b in (("tot_sec", "time_sec"), ("time_sec", "tot_sec")):
        if a not in runs.columns and b in runs.columns:
            runs = runs.withColumn(a, F.col(b))
    if "dataset_type" not in runs.columns:
        runs = runs.withColumn("dataset_type", F.lit("uniform"))
    if {"nr", "ns", "tot_sec"} <= set(runs.columns):
        own = (F.col("nr") + F.col("ns")) / positive(F.col("tot_sec"))
        runs = runs.withColumn("total_throughput", F.coalesce("total_throughput", own) if "total_throughput" in runs.columns else own)
    return runs


def residual(total: Column, *phases: Column) -> Column:
    """What the phases leave of the total, at least 0; null stays null."""
    rest = total
    for p in phases:
        rest = rest - p
    return F.when(rest < 0, F.lit(0.0)).otherwise(rest)


def average(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means of values and n_runs by configuration."""
    return runs.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n_runs"))


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def best(averaged: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """The configuration with the least tot_sec in each group."""
    return _first(averaged.where("tot_sec is not null"), by, [F.col("tot_sec"), *(F.col(t).asc_nulls_last() for t in ties)])


def with_baseline(df: DataFrame, base: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """df with columns (new name = old name) of the one row of base that has the same keys; null keys match."""
    b = base.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(old).alias(new) for new, old in columns.items()))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(b, match, "left").drop(*(f"__{k}" for k in keys))


def speedup(chosen: DataFrame, baseline: str = "seq") -> DataFrame:
    """chosen with seq_tot_sec and speedup_vs_seq against the baseline's row of the same problem and dataset."""
    out = with_baseline(chosen, chosen.where(F.col("exec_type") == baseline), [*PROBLEM, "dataset_type"], seq_tot_sec="tot_sec")
    return out.withColumn("speedup_vs_seq", F.col("seq_tot_sec") / positive(F.col("tot_sec")))


def skew_penalty(chosen: DataFrame) -> DataFrame:
    """chosen with uniform_tot_sec and the ratio to it."""
    out = with_baseline(chosen, chosen.where("dataset_type = 'uniform'"), [*PROBLEM, "exec_type"], uniform_tot_sec="tot_sec")
    return out.withColumn("skew_penalty_vs_uniform", F.col("tot_sec") / positive(F.col("uniform_tot_sec")))


def scaling_axis(runs: DataFrame) -> DataFrame:
    """runs with scaling_units and scaling_axis: the first parallelism column that says something."""

    def col(name: str) -> Column:
        return F.col(name) if name in runs.columns else F.lit(None).cast("bigint")

    p, j = col("partition_threads"), col("join_threads")
    rest = ("mpi_processes", "mpi_active_ranks", "mpi_world_size")
    axis = F.when(p == j, "omp_threads").when(p.isNotNull(), "partition_threads").when(j.isNotNull(), "join_threads")
    for c in rest:
        axis = axis.when(col(c).isNotNull(), c)
    return runs.withColumn("scaling_units", F.coalesce(p, j, *map(col, rest))).withColumn("scaling_axis", axis.otherwise("unknown"))


def infer_exec_type(runs: DataFrame, fallback: str) -> DataFrame:
    """One row: the kind of run that the columns show."""

    def top(*names: str) -> Column:
        here = [F.max(F.col(n).try_cast("double")) for n in names if n in runs.columns] or [F.lit(None).cast("double")]
        return F.greatest(*here) if len(here) > 1 else here[0]

    seen = runs.agg(top("partition_threads", "join_threads").alias("t"), top("mpi_processes", "mpi_active_ranks", "mpi_world_size").alias("r"))
    kind = F.when(F.col("t").isNotNull() & (F.col("r") > 1), "hybrid").when(F.col("t").isNotNull(), "omp").when(F.col("r").isNotNull(), "mpi").otherwise(fallback)
    return seen.select(kind.alias("exec_type"))


def _first_values(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first value that isn't null of each column, in order (ties: the least value); null keys are a group."""

    def first(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), F.col(c).alias("x"))))["x"]

    return df.groupBy(*by).agg(*(first(c).alias(c) for c in columns))


def strong(averaged: DataFrame, keys: list[str]) -> DataFrame:
    """averaged with speedup and parallel_efficiency against the fewest units, and the first time that is known, of its group."""
    base = _first_values(averaged, keys, ["scaling_units"], ["scaling_units", "time_sec"])
    out = with_baseline(averaged, base, keys, baseline_units="scaling_units", baseline_time="time_sec").where("baseline_time > 0")
    out = out.withColumn("speedup", F.col("baseline_time") / F.col("time_sec"))
    return out.withColumn("parallel_efficiency", F.col("speedup") / (F.col("scaling_units") / F.col("baseline_units")))


def weak(averaged: DataFrame, keys: list[str]) -> DataFrame:
    """averaged with scaled_speedup and weak_efficiency; the baseline has the fewest units, and the first time known in the order of units, then nr."""
    base = _first_values(averaged, keys, ["scaling_units", "nr"], ["scaling_units", "time_sec"])
    out = with_baseline(averaged, base, keys, baseline_units="scaling_units", baseline_time="time_sec").where("baseline_time > 0")
    out = out.withColumn("weak_efficiency", F.col("baseline_time") / F.col("time_sec"))
    return out.withColumn("scaled_speedup", F.col("scaling_units") / F.col("baseline_units") * F.col("weak_efficiency"))


def preferred(value: Column, order: tuple[str, ...] = EXEC_ORDER) -> list[Column]:
    """Sort keys: the place in a list, others last, then the text."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return [F.when(at == 0, F.lit(len(order) + 1)).otherwise(at), value]


def checksum_validation(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n_distinct_checksum_pairs, is_valid, exec_types) of each problem."""
    place = F.struct(*(c.alias(n) for c, n in zip(preferred(F.col("exec_type")), ("at", "name"), strict=True)))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("exec_type").isNotNull(), place))), lambda x: x["name"]), ", ")
    out = runs.groupBy(*by).agg(F.count_distinct(F.struct("checksum1", "checksum2")).alias("n_distinct_checksum_pairs"), kinds.alias("exec_types"))
    return out.withColumn("is_valid", F.col("n_distinct_checksum_pairs") == 1)


def number(x: Column) -> Column:
    """Whole numbers without a point, others to six significant digits, with an exponent below 1e-4 and from 1e6 on; null as NA.

    A number whose decimals end in a 5 just behind the sixth digit is rounded up, where C goes by the binary value."""
    x = x.cast("double")
    parts = F.split(F.format_string("%.5e", F.abs(x)), "e")
    power, digits = parts[1].cast("int"), F.replace(parts[0], F.lit("."), F.lit(""))

    def trimmed(whole: Column, rest: Column) -> Column:
        return F.regexp_replace(F.concat(whole, F.lit("."), rest), "\\.?0*$", "")

    small = trimmed(F.lit("0"), F.concat(F.repeat(F.lit("0"), F.greatest(-1 - power, F.lit(0))), digits))
    plain = trimmed(F.substring(digits, F.lit(1), power + 1), F.substring(digits, power + 2, F.lit(6)))
    long = F.concat(trimmed(F.substring(digits, F.lit(1), F.lit(1)), F.substring(digits, F.lit(2), F.lit(6))), F.lit("e"), parts[1])
    text = F.when((power < -4) | (power > 5), long).when(power < 0, small).otherwise(plain)
    whole = F.format_string("%.0f", x)
    return F.when(x.isNull(), "NA").when((F.abs(x) >= 1 << 53) | (x == F.floor(x)), whole).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def problem_label() -> Column:
    return F.concat(F.lit("nr="), number(F.col("nr")), F.lit(", ns="), number(F.col("ns")), F.lit(", max_key="), number(F.col("max_key")))


def slug(x: Column) -> Column:
    """A file name: other characters to underscores, none at the ends, at most 180 long."""
    clean = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(clean == "", "plot").otherwise(clean), 1, 180)


def dataset_metadata(specs: DataFrame, name: str = "dataset_type") -> DataFrame:
    """specs with dataset, skew_fraction and skew_partition_fraction of skewed_A_B names; others pass with zeros."""
    parts = [F.regexp_extract(name, r"^skewed_(\d+)_(\d+)$", k) for k in (1, 2)]
    fraction = [F.when(p != "", p.try_cast("double") / 100).otherwise(0.0) for p in parts]
    return specs.select("*", F.when(parts[0] != "", "skewed").otherwise(F.col(name)).alias("dataset"), fraction[0].alias("skew_fraction"), fraction[1].alias("skew_partition_fraction"))
