"""The registered queries: each operator on the driver's tables, or on generated relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions import u64
from keyfold.functions import shared
from keyfold.operators import analytics, checker, join, partition
from keyfold.plans import grid, oracles
from keyfold.plans.oracles import BLOCK, MAX_KEY, RANKS, SEED, THREADS, N, P
from keyfold.sources import datasets, logs, results

CONFIG = ["exec_type", "partition_threads", "join_threads", "mpi_processes", "nr", "ns", "max_key", "dataset_type"]
#: Ticks in a second; a prime, so that rounded means never stand halfway.
TIME_UNIT = 1_000_003
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """R: customers of orders; S: users of events."""
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, key, i) in the order of events."""
    return partition.ordinal(_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key")), "event_id")


@query
def join_checksum_orders_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query
def join_checksum_custkey_userid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(*_keys(spark, sf_dir))


@query
def join_checksum_buildagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(*_keys(spark, sf_dir), strategy="buildagg")


@query
def join_checksum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(*_keys(spark, sf_dir), strategy="rows")


@query
def naive_join_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(_table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", "naive")


@query
def rank_partial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.rank_partials(*_keys(spark, sf_dir), "key", "key", P, RANKS)


@query
def splitmix64_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    with u64.wrapping(spark):
        return _table(spark, sf_dir, "orders").select("o_orderkey", u64.to_decimal(u64.splitmix64(F.col("o_orderkey"))).alias("hash"))


@query
def partition_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", partition.partition_id(F.col("o_orderkey"), P).alias("pid"))


def _owners(spark: SparkSession, strategy: str) -> DataFrame:
    pids = spark.range(P).select(F.col("id").cast("int").alias("pid"))
    return pids.select("pid", partition.owner(F.col("pid"), P, RANKS, strategy).alias("owner"))


@query
def owner_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owners(spark, "block")


@query
def owner_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owners(spark, "cyclic")


@query
def rank_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.row_ranges(spark, N, RANKS, RANKS + 1)


def _relation(spark: SparkSession, dataset: str, seed: int = SEED) -> DataFrame:
    return datasets.relation(spark, N, seed, MAX_KEY, P, dataset)


@query
def gen_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, "uniform")


@query
def gen_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.relation_slice(spark, N, N // RANKS, 2 * N // RANKS, SEED, MAX_KEY, P, "skewed_90_5")


@query
def gen_skewed_90_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, "skewed_90_5")


@query
def gen_skewed_90_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, "skewed_90_1")


@query
def skew_key_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.pool(spark, P, MAX_KEY, 5)


@query
def join_checksum_gen_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(_relation(spark, "uniform"), _relation(spark, "uniform", datasets.second_seed(SEED)))


@query
def join_checksum_gen_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.checksum_join(_relation(spark, "skewed_90_5"), _relation(spark, "skewed_90_5", datasets.second_seed(SEED)))


@query
def key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.multiplicity(_keys(spark, sf_dir)[1], "key")


@query
def partition_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.histogram(_keys(spark, sf_dir)[1], "key", P)


@query
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.block_histogram(_events(spark, sf_dir), "key", P, BLOCK)


@query
def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.offsets(partition.histogram(_keys(spark, sf_dir)[1], "key", P))


@query
def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.layout(_keys(spark, sf_dir)[1], "key", P)


@query
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.block_offsets(_events(spark, sf_dir), "key", P, BLOCK)


@query
def scatter_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.scatter(_events(spark, sf_dir), "key", P, BLOCK).select("event_id", "pid", "position")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    rows = partition.ordinal(orders.select("o_orderkey", F.col("o_custkey").alias("key")), "o_orderkey")
    return partition.exchange_matrix(rows, "key", orders.count(), P, RANKS)


@query
def exchange_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query
def exchange_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.displacements(_matrix(spark, sf_dir))


@query
def join_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _keys(spark, sf_dir)
    return partition.work_items(r, "key", s, "key", P, THREADS)


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as if loaded from one file for each kind; each frame has only its kind's columns."""
    raw = _table(spark, sf_dir, "orders").selectExpr(*(f"{e.format(s='STRING')} AS {n}" for n, e in oracles.RUNS.items()))
    lacks = {"hashjoin_seq": ("partition_threads", "join_threads", "mpi_processes"), "hashjoin_omp": ("mpi_processes",), "hashjoin_mpi": ("partition_threads", "join_threads"), "hashjoin_hybrid_uniform": ()}
    return results.union({stem: raw.where(F.col("stem") == stem).drop("stem", *gone) for stem, gone in lacks.items()})


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = analytics.normalize(_loaded(spark, sf_dir).withColumn("tot_sec", F.col("time_text")), {"tot_sec": "double", "join_text": "double"})
    runs = runs.withColumn("tot_sec", F.col("tot_sec") / TIME_UNIT).withColumn("partition_time", F.col("time_text").try_cast("double") / (2 * TIME_UNIT - 3)).withColumn("join_time", F.col("join_text") / TIME_UNIT)
    return analytics.normalize(runs.drop("time_sec", "total_throughput", "time_text", "join_text"), {})


def _average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.average(_normal(spark, sf_dir), CONFIG, ["tot_sec", "time_sec", "partition_time", "join_time"])


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.best(_average(spark, sf_dir), [*analytics.PROBLEM, "dataset_type", "exec_type"], ["partition_threads", "join_threads", "mpi_processes"])


def _round(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query
def bench_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).select("run_id", *CONFIG, "time_text")


@query
def bench_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("run_id", "tot_sec", "time_sec", _round("total_throughput", 3))


@query
def bench_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _average(spark, sf_dir).select(*CONFIG, *map(_round, ("tot_sec", "partition_time", "join_time")), "n_runs")


@query
def bench_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = analytics.residual(F.col("tot_sec"), F.col("partition_time"), F.col("join_time"))
    return _average(spark, sf_dir).select(*CONFIG, F.round(rest, 6).alias("redistribution_time"))


@query
def bench_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select(*CONFIG, _round("tot_sec"), "n_runs")


@query
def bench_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [*analytics.PROBLEM, "dataset_type"]
    return analytics.best(_best(spark, sf_dir), by, ["exec_type"]).select(*by, "exec_type", _round("tot_sec"))


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("run_id", F.round(analytics.throughput(F.col("nr") + F.col("ns"), F.col("tot_sec")), 3).alias("throughput"))


@query
def speedup_vs_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.speedup(_best(spark, sf_dir)).select(*analytics.PROBLEM, "dataset_type", "exec_type", _round("speedup_vs_seq"))


@query
def skew_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.skew_penalty(_best(spark, sf_dir)).select(*analytics.PROBLEM, "dataset_type", "exec_type", _round("skew_penalty_vs_uniform"))


@query
def scaling_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.scaling_axis(_normal(spark, sf_dir)).select("run_id", "scaling_axis", "scaling_units")


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows = analytics.scaling_axis(_normal(spark, sf_dir)).dropna(subset=["scaling_units", "total_throughput"])
    by = ["dataset_type", "nr", "ns", "max_key", "scaling_axis", "scaling_units"]
    return analytics.average(rows, by, ["time_sec"]), [*by, "n_runs"]


@query
def strong_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _units(spark, sf_dir)
    return analytics.strong(rows, ["dataset_type", "nr", "ns", "max_key", "scaling_axis"]).select(*names, _round("speedup"), _round("parallel_efficiency"))


@query
def weak_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _units(spark, sf_dir)
    return analytics.weak(rows, ["dataset_type", "max_key", "scaling_axis"]).select(*names, _round("scaled_speedup"), _round("weak_efficiency"))


@query
def scaling_exec_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _normal(spark, sf_dir)
    kinds = [analytics.infer_exec_type(runs.where(F.col("exec_type") == k), "seq").select(F.lit(k).alias("exec_type"), F.col("exec_type").alias("inferred")) for k in ("seq", "omp", "mpi", "hybrid")]
    return kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3])


@query
def checksum_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.checksum_validation(_normal(spark, sf_dir), [*analytics.PROBLEM, "dataset_type"])


@query
def ordered_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select("event_type", F.row_number().over(Window.orderBy(*analytics.preferred(F.col("event_type"), ("view", "click")))).alias("place"))


@query
def fmt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = analytics.slug(F.concat(F.col("exec_type"), F.lit(" / "), F.coalesce("dataset_type", F.lit("")), F.lit("!")))
    case = F.concat(u64.div(F.col("nr"), 1_000_000).cast("string"), F.lit(" / "), F.coalesce("mpi_processes", F.lit(1)).cast("string"))
    return _normal(spark, sf_dir).select("run_id", analytics.problem_label().alias("problem"), analytics.number(F.col("tot_sec")).alias("seconds"), analytics.number(F.col("total_throughput")).alias("rate"), analytics.number(F.col("tot_sec") * 1e-6).alias("megaseconds"), slug.alias("slug"), case.alias("case_label"))


@query
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "CASE o_orderkey % 4 WHEN 0 THEN 'uniform' WHEN 1 THEN concat('skewed_', CAST(o_custkey % 100 AS STRING), '_5') WHEN 2 THEN 'skewed_90_1' ELSE 'other' END AS dataset_type"
    return analytics.dataset_metadata(_table(spark, sf_dir, "orders").selectExpr(name).distinct())


@query
def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {k: [1] for k in grid.PARAMETERS} | {"node": [1, 4, 8], "mpi_process": [1, 4, 8], "mpi_partition_strategy": ["block", "cyclic"], "dataset_type": ["uniform", "skewed_90_5", "skewed_90_1"]}
    return grid.expand(spark, values, 5).select("repeat", "node", "mpi_process", "mpi_partition_strategy", "dataset_type")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {n: e.format(s="STRING").replace("\n", "\\n").replace("\r", "\\r") for n, e in oracles.LOG_TEXT.items()}
    return logs.parse(_table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in text.items())))


@query
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


@query
def checker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.groups(_parsed(spark, sf_dir))


@query
def checker_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.mismatches(_parsed(spark, sf_dir))


@query
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", results.escape(F.col("props")).alias("field"))


@query
def bench_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs appended to a CSV file of the shared folder in two parts with different columns, and loaded again from the first folder that has any."""
    folder = shared.scratch(spark, "csv")
    rows = _loaded(spark, sf_dir)
    results.append(rows.where("exec_type = 'seq'").drop("partition_threads", "join_threads", "mpi_processes"), f"{folder}/hashjoin_omp.csv")
    results.append(rows.where("exec_type <> 'seq'"), f"{folder}/hashjoin_omp.csv")
    return results.load_first(spark, [f"{folder}/none", folder])


@query
def log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a log of every status and priority of orders, and a file that is none: read and parsed."""
    folder = shared.scratch(spark, "logs")
    made = _table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("k"), F.max("o_custkey").alias("c"))
    for r in made.collect():  # a log for each group
        text = f"started\r\nexecutable=hashjoin_{r['o_orderstatus']}\r\ndataset_type={r['o_orderpriority']}\njoin_count={r['n']}\nchecksum1={r['k']}\nchecksum2={r['c']}\n"
        text += "verified=true\n" if r["n"] % 2 else ""
        shared.write_bytes(spark, f"{folder}/slurm-{r['o_orderstatus']}-{r['o_orderpriority'][0]}.out", text.encode())
    shared.write_bytes(spark, f"{folder}/notes.txt", b"executable=none\n")
    parsed = logs.parse(logs.read(spark, folder))
    return parsed.withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


@query
def repartition_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's key in the Spark partition of the rank that owns it."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey")
    return partition.repartition_by_owner(rows, "o_orderkey", P, RANKS).select("o_orderkey", F.spark_partition_id().alias("owner"))
