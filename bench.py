"""Times the headline queries and prints one JSON line.

The join of generated relations (BENCH_JOIN_ROWS rows a side, generated beforehand into memory, as the baseline excludes generation)
is timed as the best of three; the catalogue's queries over $BENCH_SF_DIR as one run each after a warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from keyfold.operators import join  # noqa: E402
from keyfold.plans import catalog  # noqa: E402
from keyfold.plans.session import RECOMMENDED  # noqa: E402
from keyfold.sources import datasets  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ROWS = int(os.environ.get("BENCH_JOIN_ROWS", "50000000"))
SEED, MAX_KEY, P = 13, 1_000_000, 256
#: What the joins of 50 million rows a side must give.
GOLDEN = {
    "uniform": (2499986166, 6185417096973469475, 16931092769743058723),
    "skewed_90_5": (40578723119, 12610816366499644757, 12079717592018431889),
    "skewed_90_1": (173507209024, 12347604091913951299, 2033051395823430535),
}
HEADLINES = (
    "join_checksum_orders_lineitem", "join_checksum_custkey_userid", "join_checksum_buildagg", "join_checksum_gen_skewed", "rank_partial_results",
    "partition_layout", "scatter_positions", "exchange_matrix", "join_work_items", "bench_best", "speedup_vs_seq", "weak_scaling", "log_parse", "checker_groups",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "14g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.inMemoryColumnarStorage.compressed", "false")
        .config("spark.sql.inMemoryColumnarStorage.batchSize", "200000")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=RECOMMENDED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(f) -> tuple[float, object]:
    at = time.perf_counter()
    out = f()
    return time.perf_counter() - at, out


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    wrong = []
    for name in GOLDEN:
        sides = [datasets.relation(spark, ROWS, s, MAX_KEY, P, name).select("key").persist(StorageLevel.MEMORY_ONLY) for s in (SEED, datasets.second_seed(SEED))]
        for s in sides:
            s.count()
        runs = [timed(lambda: tuple(int(x) for x in join.checksum_join(*sides).first())) for _ in range(3)]  # noqa: B023
        times[f"join_{name}_{ROWS // 1_000_000}m"] = round(min(t for t, _ in runs), 3)
        if ROWS == 50_000_000 and any(out != GOLDEN[name] for _, out in runs):
            wrong.append(name)
        for s in sides:
            s.unpersist(blocking=True)
    for name in HEADLINES:
        query = catalog.QUERIES[name]
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(timed(lambda: query(spark, SF_DIR).write.format("noop").mode("overwrite").save())[0], 3)  # noqa: B023
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name, "wrong": wrong}))
    spark.stop()


if __name__ == "__main__":
    main()
