"""Command line: one run of the join, a check of run logs, a campaign over a grid."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators import analytics, checker, join, partition
from keyfold.plans import grid
from keyfold.plans.session import RECOMMENDED
from keyfold.sources import datasets, logs, results

OUTCOME = ("join_count", "checksum1", "checksum2")
#: A grid's parameter -> the column of a result row.
RECORDED = {
    "node": "mpi_nodes", "mpi_process": "mpi_processes", "mpi_partition_strategy": "mpi_partition_strategy", "partition_thread": "partition_threads", "join_thread": "join_threads",
    "partition_schedule": "partition_schedule", "join_schedule": "join_schedule", "partition_chunk": "partition_chunk", "join_chunk": "join_chunk", "partition_block_size": "partition_block_size",
}


def outcome(spark: SparkSession, sides: list[DataFrame], strategy: str, p: int, ranks: int, ownership: str) -> dict[str, int]:
    """The join's result; with ranks, the sum of what each owner of partitions has."""
    if ranks < 2:
        rows = [join.checksum_join(*sides, strategy=strategy).first()]
    else:
        rows = join.rank_partials(*sides, "key", "key", p, ranks, ownership).collect()  # one for each rank
    return {k: sum(int(r[k]) for r in rows) % (1 << 64) for k in OUTCOME}


def run(
    spark: SparkSession, nr: int, ns: int, seed: int, max_key: int, p: int, dataset: str = "uniform", strategy: str = "eager",
    ranks: int = 1, ownership: str = "block", partition_tasks: int | None = None, join_tasks: int | None = None,
) -> dict[str, str]:
    """Generate both relations, time their join, verify it against all pairs where both are small; the values of one result row.

    ranks, ownership: the join is summed from the shares of so many owners of partitions; partition_tasks, join_tasks: how many tasks hold a side and
    join (the session's own numbers if not given).
    """
    partition.check_partitions(p)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sides = [datasets.relation(spark, n, s, max_key, p, dataset).select("key").persist(StorageLevel.MEMORY_AND_DISK) for n, s in ((nr, seed), (ns, datasets.second_seed(seed)))]
    if partition_tasks:
        whole, sides = sides, [s.repartition(partition_tasks).persist(StorageLevel.MEMORY_AND_DISK) for s in sides]
    for s in sides:
        s.count()  # generation isn't timed
    for s in whole if partition_tasks else []:
        s.unpersist()
    spark.conf.set("spark.sql.shuffle.partitions", str(join_tasks or before))
    try:
        began = time.perf_counter()
        found = outcome(spark, sides, strategy, p, ranks, ownership)
        took = time.perf_counter() - began
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = {"executable": f"keyfold_{strategy}", "dataset_type": dataset} | {k: str(found[k]) for k in OUTCOME}
    if nr <= join.VERIFY_ROWS and ns <= join.VERIFY_ROWS:
        naive = outcome(spark, sides, "naive", p, 1, ownership)
        out |= {f"naive_{k}": str(naive[k]) for k in OUTCOME} | {"verified": str(naive == found).lower()}
    for s in sides:
        s.unpersist()
    rate = (nr + ns) / took if took > 0 else 0.0
    return out | {"nr": str(nr), "ns": str(ns), "seed": str(seed), "max_key": str(max_key), "p": str(p), "time_sec": f"{took:.6f}", "total_throughput": f"{rate:.3f}"}


def frame(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    """Result rows as text columns; what a row lacks is null."""
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"`{k}` string" for k in names))


def campaign(spark: SparkSession, values: dict[str, list], repeats: int, csv: str) -> DataFrame:
    """Every run of a grid, appended to csv as it ends; returns the averages by configuration.

    Processes are the owners that share the partitions, dealt by the strategy; threads are the tasks that hold a side and that join.  Nodes, schedules,
    chunks and block sizes tell threads how to share loops, which is the scheduler's work here: they are recorded with the run.
    """
    rows = []
    for g in grid.expand(spark, values, repeats).orderBy("repeat").collect():
        row = run(spark, g["n"], g["n"], g["seed"], g["max_key"], g["p"], g["dataset_type"], "eager", g["mpi_process"], g["mpi_partition_strategy"], g["partition_thread"], g["join_thread"])
        rows.append(row | {column: str(g[name]) for name, column in RECORDED.items()})
        results.append(frame(spark, rows[-1:]), csv)
    runs = analytics.normalize(frame(spark, rows), {k: t for k, t in results.NUMERIC.items() if not k.startswith("checksum")})
    return analytics.average(runs, ["executable", "dataset_type", "nr", "ns", "max_key", "p", "seed", *RECORDED.values()], ["tot_sec", "total_throughput"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="keyfold", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run", help="join two generated relations")
    for name in ("nr", "ns", "seed", "max-key", "p"):
        one.add_argument(f"-{name}", type=int, required=True)
    one.add_argument("--dataset-type", default="uniform")
    one.add_argument("--strategy", default="eager", choices=join.STRATEGIES)
    one.add_argument("--csv", help="folder of CSV files to append the result to")
    log = sub.add_parser("check", help="do the logs of a folder agree?")
    log.add_argument("folder")
    many = sub.add_parser("campaign", help="run a grid")
    many.add_argument("grid", help="JSON object: parameter -> list of values")
    many.add_argument("--repeats", type=int, default=1)
    many.add_argument("--csv", required=True)
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.config(map=RECOMMENDED).getOrCreate()
    if a.command == "check":
        parsed = logs.parse(logs.read(spark, a.folder))
        for row in checker.groups(parsed).orderBy("executable", "dataset_type").collect():
            print(*(f"{k}={v}" for k, v in row.asDict().items()))
        for row in checker.mismatches(parsed).orderBy("path").collect():
            print("differs:", *(f"{k}={v}" for k, v in row.asDict().items()))
        return checker.status(parsed)
    if a.command == "campaign":
        campaign(spark, json.loads(a.grid), a.repeats, a.csv).orderBy(F.desc("n_runs")).show(truncate=False)
        return 0
    try:
        row = run(spark, a.nr, a.ns, a.seed, a.max_key, a.p, a.dataset_type, a.strategy)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    for k in ("executable", "dataset_type", *OUTCOME, *(f"naive_{k}" for k in OUTCOME), "verified"):
        if k in row:
            print(f"{k}={row[k]}")
    if row.get("verified") == "false":
        print("the result differs from the all-pairs join", file=sys.stderr)
        return 1
    if a.csv:
        results.append(frame(spark, [row]), a.csv)
    return 0
