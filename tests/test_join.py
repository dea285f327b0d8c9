import random
from collections import Counter

import pytest
from keyfold.functions import u64
from keyfold.operators import join, partition
from keyfold.sources import datasets
from pyspark.sql import functions as F

M = (1 << 64) - 1

#: Fixed values: (nr, ns, seed, max_key, partitions, dataset) and the published or literally computed results.
GOLDEN = [
    ((5, 8, 13, 8, 4, "uniform"), (5, 8842340191968113137, 10794883823239991901)),
    ((0, 8, 13, 8, 4, "uniform"), (0, 0, 0)),
    ((500, 500, 13, 0, 4, "uniform"), (250000, 12950599592729043568, 18433132728787114304)),
    ((500, 500, 13, 100, 16, "uniform"), (2543, 1210046004697120050, 15387921279119520417)),
    ((500, 500, 13, 1000, 16, "skewed_90_5"), (3403, 14834447939304983497, 15504429340623035849)),
    ((500, 500, 13, 1000, 256, "skewed_90_1"), (17307, 11806095332124372136, 13098440806160984572)),
    ((500, 300, 7, 64, 8, "skewed_100_25"), (9431, 4689446077315490273, 7117618270417500371)),
    ((10**6, 10**6, 13, 10**6, 256, "uniform"), (998628, 12682559309998960217, 14036291595224585745)),
    ((10**6, 10**6, 13, 10**6, 256, "skewed_90_5"), (16239151, 13194441401417851453, 5243928144645998107)),
    ((10**6, 10**6, 13, 10**6, 256, "skewed_90_1"), (69435238, 7042026590243191438, 16928178310895057836)),
]


def splitmix64(x):
    x = (x + u64.GOLDEN) & M
    x = (x ^ x >> 30) * u64.MULTIPLIERS[0] & M
    x = (x ^ x >> 27) * u64.MULTIPLIERS[1] & M
    return x ^ x >> 31


def plain(r, s):
    a, b = Counter(r), Counter(s)
    m = {k: a[k] * b[k] for k in a.keys() & b.keys() if k is not None}
    return sum(m.values()), sum(splitmix64(k & M) * n for k, n in m.items()) & M, sum(splitmix64((k & M) ^ u64.GOLDEN) * n for k, n in m.items()) & M


def result(df):
    return tuple(int(x) for x in df.first())


@pytest.mark.parametrize(("config", "want"), GOLDEN, ids=str)
def test_golden(spark, config, want):
    nr, ns, seed, max_key, p, name = config
    r = datasets.relation(spark, nr, seed, max_key, p, name)
    s = datasets.relation(spark, ns, datasets.second_seed(seed), max_key, p, name)
    for strategy in join.STRATEGIES if nr <= 500 else ("eager",):
        assert result(join.checksum_join(r, s, strategy=strategy)) == want, strategy
    if nr <= 500:
        assert join.verified(r, s) is True
    else:
        assert join.verified(r, s) is None


def test_any_keys(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), None, 12345678901234567]
    r, s = ([rng.choice(keys) for _ in range(n)] for n in (40, 60))
    left, right = (spark.createDataFrame([(k, "x") for k in v], "k long, m string") for v in (r, s))
    for strategy in join.STRATEGIES:
        assert result(join.checksum_join(left, right, "k", "k", strategy)) == plain(r, s)
    parts = join.rank_partials(left, right, "k", "k", 8, 3).collect()
    assert sum(x["join_count"] for x in parts) == plain(r, s)[0] and sum(int(x["checksum1"]) for x in parts) & M == plain(r, s)[1]
    with pytest.raises(ValueError):
        join.checksum_join(left, right, "k", "k", "other")


def test_the_sessions_mode_stays(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(ZeroDivisionError), u64.wrapping(spark):
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_scalars(spark):
    keys = [0, 1, 2, (1 << 64) - 1, 1 << 63]
    with u64.wrapping(spark):
        rows = spark.createDataFrame([(u64.signed(k),) for k in keys], "k long").select(u64.to_decimal(u64.splitmix64(F.col("k"))).alias("h"), u64.umod(F.col("k"), 1000).alias("m"))
        assert [(int(r["h"]), r["m"]) for r in rows.collect()] == [(splitmix64(k), k % 1000) for k in keys]
    assert splitmix64(0) == 0xE220A8397B1DCDAF


def test_eager_plan_aggregates_before_the_join(spark):
    r = spark.range(1000).select((F.col("id") % 7).alias("key"))
    plan = join.checksum_join(r, r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 2 and "CartesianProduct" not in plan


def test_generator_prefixes_and_slices(spark):
    for name, first in (("skewed_90_5", [93695, 850810, 329606, 247019, 984711]), ("skewed_90_1", [93695, 687161, 761800, 737176, 933926]), ("uniform", [93695, 367921, 544456, 245427, 667107])):
        rows = datasets.relation(spark, 1000, 13, 10**6, 256, name).orderBy("i").collect()
        assert [r["key"] for r in rows[:5]] == first and [r["i"] for r in rows] == list(range(1000))
        part = datasets.relation_slice(spark, 1000, 300, 700, 13, 10**6, 256, name).orderBy("i").collect()
        assert part == rows[300:700]
    assert datasets.pool(spark, 256, 10**6, 5).count() == 50778 and datasets.pool(spark, 256, 10**6, 1).count() == 11718
    assert datasets.relation(spark, 50, 13, 100, 4, "skewed_0_5").collect() == datasets.relation(spark, 50, 13, 100, 4, "uniform").collect()


def test_chunks_join_seamlessly(spark, monkeypatch):
    whole = datasets.relation(spark, 3000, 5, 1000, 16, "skewed_95_10").orderBy("i").collect()
    monkeypatch.setattr(datasets, "CHUNK", 64)
    assert datasets.relation(spark, 3000, 5, 1000, 16, "skewed_95_10").orderBy("i").collect() == whole


@pytest.mark.parametrize("text", ["", "skewed", "skewed_90", "skewed_101_5", "skewed_90_0", "skewed_90_5x", "Uniform"])
def test_bad_specs(text):
    with pytest.raises(ValueError):
        datasets.Spec.parse(text)


def test_layouts(spark):
    r = datasets.relation(spark, 5, 13, 8, 4, "uniform")
    s = datasets.relation(spark, 8, datasets.second_seed(13), 8, 4, "uniform")
    for df, counts, keys in ((r, [1, 1, 0, 3], [0, 1, 7, 3, 3]), (s, [0, 5, 1, 2], [5, 1, 1, 1, 5, 2, 7, 7])):
        rows = partition.layout(df, "key", 4).orderBy("pid").collect()
        assert [x["cnt"] for x in rows] == counts and [x["begin"] for x in rows] == [sum(counts[:k]) for k in range(4)]
        for block in (1, 2, 100):
            assert [x["key"] for x in partition.scatter(df, "key", 4, block).orderBy("position").collect()] == keys
    keys = spark.createDataFrame([(k,) for k in (0, 1, 255, 256, 511, 512, 131072, 999999, 2**40 + 5)], "k long")
    assert [x["p"] for x in keys.select(partition.partition_id(F.col("k"), 256).alias("p")).collect()] == [0, 1, 255, 0, 255, 1, 1, 153, 133]
    pids = spark.range(8).select(F.col("id").cast("int").alias("p"))
    for strategy, want in (("block", [0, 0, 1, 1, 1, 2, 2, 2]), ("cyclic", [0, 1, 2, 0, 1, 2, 0, 1])):
        assert [x["o"] for x in pids.select(partition.owner(F.col("p"), 8, 3, strategy).alias("o")).collect()] == want
    for bad in (0, 3, -4):
        with pytest.raises(ValueError):
            partition.check_partitions(bad)
    with pytest.raises(ValueError):
        partition.owner(F.col("p"), 8, 3, "other")
    with pytest.raises(ValueError):
        partition.block_histogram(r, "key", 4, 0)


def test_ranks_and_exchange(spark):
    assert [tuple(x) for x in partition.row_ranges(spark, 10, 3, 4).collect()] == [(0, 0, 3), (1, 3, 6), (2, 6, 10), (3, 0, 0)]
    rows = datasets.relation(spark, 1000, 3, 50, 16, "uniform")
    matrix = partition.exchange_matrix(rows, "key", 1000, 16, 3)
    assert sum(x["cnt"] for x in matrix.collect()) == 1000 and matrix.count() == 9
    shown = {(x["src_rank"], x["owner"]): x["displ"] for x in partition.displacements(matrix).collect()}
    assert all(shown[k, 0] == 0 for k in range(3))
    dealt = partition.repartition_by_owner(rows, "key", 16, 3).select(F.spark_partition_id().alias("at"), partition.owner(partition.partition_id(F.col("key"), 16), 16, 3).alias("o"))
    assert dealt.where("at <> o").count() == 0


def test_work_items_cover_the_probe_side(spark):
    r = datasets.relation(spark, 2000, 3, 500, 64, "skewed_90_5")
    s = datasets.relation(spark, 3000, 4, 500, 64, "skewed_90_5")
    items = partition.work_items(r, "key", s, "key", 64, 8).collect()
    sizes = {x["pid"]: (x["begin"], x["end"]) for x in partition.layout(s, "key", 64).collect()}
    for pid in {x["pid"] for x in items}:
        mine = sorted((x["s_begin"], x["s_end"]) for x in items if x["pid"] == pid)
        assert mine[0][0] == sizes[pid][0] and mine[-1][1] == sizes[pid][1] and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    assert [x["work"] for x in items] == sorted((x["work"] for x in items), reverse=True) and max(x["part"] for x in items) > 0


def test_the_count_is_unsigned(spark):
    from pyspark.sql import functions as F

    matches = spark.range(3).select(F.col("id").alias("key"), F.lit((1 << 62) + 1).alias("m"))
    assert join.checksums(matches).first()["join_count"] == 3 * ((1 << 62) + 1)


def test_ordinals_of_values_far_apart(spark):
    import random

    from keyfold.operators import partition

    rng = random.Random(3)
    for values in ([rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)], list(range(-5, 40)), [7], [0, (1 << 63) - 1, -(1 << 63)]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        got = {r["v"]: r["i"] for r in partition.ordinal(df, "v", width=64).collect()}
        assert got == {v: k for k, v in enumerate(sorted(values))}
    assert partition.ordinal(spark.createDataFrame([], "v long"), "v").count() == 0


def test_displacements_that_overflow(spark):
    import pytest
    from keyfold.operators import partition

    ok = spark.createDataFrame([(0, 0, 1 << 30), (0, 1, (1 << 30) - 1), (1, 0, 5)], "src_rank int, owner int, cnt long")
    assert {(r["src_rank"], r["owner"]): r["displ"] for r in partition.displacements(ok).collect()} == {(0, 0): 0, (0, 1): 1 << 30, (1, 0): 0}
    with pytest.raises(Exception, match="overflow"):
        partition.displacements(ok.union(ok.where("src_rank = 0").selectExpr("src_rank", "owner + 2", "cnt"))).collect()


def test_a_cluster_must_name_the_shared_folder(spark):
    from types import SimpleNamespace

    import pytest
    from keyfold.functions import shared

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared.shared_dir(other)
    assert shared.shared_dir(spark)
