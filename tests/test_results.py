import csv
import io

import pytest
from keyfold.operators import analytics, checker
from keyfold.plans import grid
from keyfold.sources import logs, results
from pyspark.sql import functions as F


def log(executable="e", dataset="d", count="1", c1="2", c2="3", verified=None, end="\n"):
    lines = [f"executable={executable}", f"dataset_type={dataset}", f"join_count={count}", f"checksum1={c1}"] + ([f"checksum2={c2}"] if c2 else []) + ([f"verified={verified}"] if verified else [])
    return end.join(lines) + end


def write(tmp_path, *texts):
    for i, t in enumerate(texts):
        (tmp_path / f"slurm-{i}.log").write_bytes(t.encode())
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def test_logs(spark, tmp_path):
    at = write(tmp_path, log(end="\r\n"), log(count="1") + "join_count=9\nchecksum1=a=b\n", log(c2=None), log(verified="true"), log(verified="no"), "nothing")
    rows = logs.parse(logs.read(spark, at)).orderBy("path").collect()
    assert [r["join_count"] for r in rows] == ["1", "9", "1", "1", "1", None]
    assert rows[1]["checksum1"] == "a=b" and [r["complete"] for r in rows] == [True, True, False, True, True, False]
    assert [(r["has_verified_field"], r["verified"]) for r in rows[3:5]] == [(True, True), (True, False)]


@pytest.mark.parametrize(
    ("texts", "status"),
    [([log(), log()], 0), ([log(), log(count="5")], 1), ([log(), log(verified="false")], 1), ([log(c2=None)], 2), ([], 2), ([log(verified="1"), log(verified="1", count="4")], 0), ([log(), log(executable="f", count="9")], 0)],
)
def test_status(spark, tmp_path, texts, status):
    parsed = logs.parse(logs.read(spark, write(tmp_path, *texts))) if texts else logs.parse(spark.createDataFrame([], "path string, text string"))
    assert checker.status(parsed) == status


def test_groups_and_mismatches(spark, tmp_path):
    parsed = logs.parse(logs.read(spark, write(tmp_path, log(), log(), log(count="7"), log(verified="true"))))
    assert [tuple(r) for r in checker.groups(parsed).collect()] == [("e", "d", 4, 1, 2, False)]
    assert [(r["path"][-11:], r["join_count"]) for r in checker.mismatches(parsed).collect()] == [("slurm-2.log", "7")]


def test_escape_is_csvs(spark):
    texts = ["plain", "a,b", 'say "x"', "two\nlines", "cr\rhere", "", ' "'] + [None]
    got = [r["e"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(results.escape(F.col("t")).alias("e")).collect()]
    for t, e in zip(texts[:-1], got):
        assert next(csv.reader(io.StringIO(e, newline="")), [""]) == [t]
    assert got[-1] is None and got[0] == "plain" and got[1] == '"a,b"'


def test_append_and_load(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x,\"y\"", None)], "b int, a string, c string")
    at = str(tmp_path / "hashjoin_hybrid_skew1.csv")
    results.append(rows, at)
    results.append(rows, at)
    other = str(tmp_path / "hashjoin_omp_loop.csv")
    results.append(spark.createDataFrame([(1,)], "d int"), other)
    out = results.load(spark, [at, other])
    assert out.columns == ["a", "b", "c", "exec_type", "d"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([('x,"y"', "2", None, "hybrid", None)] * 2 + [(None, None, None, "omp_loop", "1")], key=str)
    with pytest.raises(ValueError):
        results.append(rows.limit(0), at)


def frame(spark, *rows):
    return spark.createDataFrame(rows, "exec_type string, dataset_type string, nr long, ns long, max_key long, tot_sec double, scaling_units long, scaling_axis string, time_sec double")


def test_analytics(spark):
    rows = frame(
        spark,
        ("seq", "uniform", 10, 10, 5, 4.0, 1, "omp_threads", 4.0),
        ("omp", "uniform", 10, 10, 5, 2.0, 2, "omp_threads", 2.0),
        ("omp", "uniform", 10, 10, 5, 2.5, 4, "omp_threads", 1.0),
        ("omp", "skew", 10, 10, 5, 3.0, 2, "x", 0.0),
        ("omp", None, 10, 10, 5, None, 2, "x", None),
    )
    best = analytics.best(rows, ["exec_type", "dataset_type"], ["scaling_units"])
    assert {(r["exec_type"], r["dataset_type"]): r["tot_sec"] for r in best.collect()} == {("seq", "uniform"): 4.0, ("omp", "uniform"): 2.0, ("omp", "skew"): 3.0}
    assert {(r["exec_type"], r["dataset_type"]): r["speedup_vs_seq"] for r in analytics.speedup(best).collect()} == {("seq", "uniform"): 1.0, ("omp", "uniform"): 2.0, ("omp", "skew"): None}
    assert {r["dataset_type"]: r["skew_penalty_vs_uniform"] for r in analytics.skew_penalty(best.where("exec_type = 'omp'")).collect()} == {"uniform": 1.0, "skew": 1.5}
    strong = {r["scaling_units"]: (r["speedup"], r["parallel_efficiency"]) for r in analytics.strong(rows.where("dataset_type = 'uniform'"), ["dataset_type"]).collect()}
    assert strong == {1: (1.0, 1.0), 2: (2.0, 1.0), 4: (4.0, 1.0)}
    weak = {r["scaling_units"]: (r["scaled_speedup"], r["weak_efficiency"]) for r in analytics.weak(rows.where("dataset_type = 'uniform'"), ["dataset_type"]).collect()}
    assert weak == {1: (1.0, 1.0), 2: (4.0, 2.0), 4: (16.0, 4.0)}
    assert [r["n_runs"] for r in analytics.average(rows, ["exec_type"], ["tot_sec"]).orderBy("exec_type").collect()] == [4, 1]


def test_small_functions(spark):
    one = spark.createDataFrame([(None, 0.0, 5.0, 1.25, "a b/ü!"), (3, 2.0, 4.0, 2.0, "__")], "n long, t double, u double, x double, s string")
    got = one.select(
        analytics.throughput(F.lit(8), F.col("t")), analytics.residual(F.col("t"), F.col("u")), analytics.number(F.col("x")), analytics.slug(F.col("s")), analytics.residual(F.col("n").cast("double"), F.lit(1.0)), analytics.positive(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, "1.25", "a_b", None, None), (4.0, 0.0, "2", "plot", 2.0, 2.0)]
    runs = spark.createDataFrame([("7", "x", "2")], "nr string, ns string, tot_sec string")
    assert analytics.normalize(runs, {"nr": "long", "ns": "long", "tot_sec": "double"}).first().asDict() == {"nr": 7, "ns": None, "tot_sec": 2.0, "time_sec": 2.0, "dataset_type": "uniform", "total_throughput": None}
    none = spark.createDataFrame([(1,)], "a int")
    assert analytics.infer_exec_type(none, "seq").first()[0] == "seq" and analytics.scaling_axis(none).first()["scaling_axis"] == "unknown"


def test_grid(spark):
    values = {k: [1] for k in grid.PARAMETERS} | {"node": [1, 4, 8], "mpi_process": [1, 4, 8], "mpi_partition_strategy": ["block", "cyclic"], "dataset_type": ["a", "b", "c"]}
    assert grid.expand(spark, values, 5).count() == 180
    with pytest.raises(ValueError):
        grid.expand(spark, values | {"seed": []})


def test_parts_with_other_columns_keep_their_names(spark, tmp_path):
    at = str(tmp_path / "hashjoin_omp.csv")
    results.append(spark.createDataFrame([("e", 9)], "executable string, nr int"), at)
    results.append(spark.createDataFrame([("true", 8, "f")], "verified string, nr int, executable string"), at)
    results.append(spark.createDataFrame([("g", 7)], "executable string, nr int"), at)
    got = {r["nr"]: (r["executable"], r["verified"], r["exec_type"]) for r in results.load(spark, [at]).collect()}
    assert got == {"9": ("e", None, "omp"), "8": ("f", "true", "omp"), "7": ("g", None, "omp")}


def test_the_first_folder_with_files_is_loaded(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "other.csv").write_text("nr\n1\n")
    (tmp_path / "b" / "hashjoin_seq.csv").write_text("nr,checksum1\n2,18446744073709551615\nx,\n")
    (tmp_path / "b" / "hashjoin_hybrid_uniform.csv").write_text("nr\n3\n")
    (tmp_path / "c" / "hashjoin_seq.csv").write_text("nr\n4\n")
    folders = [str(tmp_path / x) for x in ("none", "a", "b", "c")]
    runs = analytics.normalize(results.load_first(spark, folders), results.NUMERIC)
    assert sorted(((r["exec_type"], r["nr"], r["checksum1"]) for r in runs.collect()), key=str) == sorted([("seq", 2, 18446744073709551615), ("seq", None, None), ("hybrid", 3, None)], key=str)
    with pytest.raises(FileNotFoundError):
        results.load_first(spark, folders[:2])


def test_numbers_are_printed_as_by_g(spark):
    values = [1234567.5, 0.1, 1e-5, 1.5e-5, 123456.75, 99999.96, 999999.5, 1e20 + 0.5, 12.5, -0.25, -1234567.25, 3.0, -4.0, 0.0001, 0.000123456789, 1e15 + 0.5, 0.1 + 0.2]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(analytics.number(F.col("v"))).collect()]
    assert got == [str(int(v)) if v.is_integer() else f"{v:g}" for v in values]


def test_empty_names_are_missing(spark, tmp_path):
    rows = logs.parse(logs.read(spark, write(tmp_path, log(executable=""), log(dataset=""), log(count=""), log()))).orderBy("path").collect()
    assert [r["complete"] for r in rows] == [False, False, True, True] and rows[0]["executable"] == ""


def test_the_baseline_is_the_first_value_of_each_column(spark):
    rows = frame(spark, ("omp", "d", 10, 10, 5, None, 1, "x", None), ("omp", "d", 10, 10, 5, 4.0, 2, "x", 4.0), ("omp", "d", 10, 10, 5, 1.0, 4, "x", 1.0), ("omp", None, 10, 10, 5, 1.0, 3, "x", 1.0))
    got = {(r["dataset_type"], r["scaling_units"]): (r["baseline_units"], r["baseline_time"], r["speedup"], r["parallel_efficiency"]) for r in analytics.strong(rows, ["dataset_type"]).collect()}
    assert got == {("d", 1): (1, 4.0, None, None), ("d", 2): (1, 4.0, 1.0, 0.5), ("d", 4): (1, 4.0, 4.0, 1.0), (None, 3): (3, 1.0, 1.0, 1.0)}
