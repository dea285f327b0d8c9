import json

import pytest
from keyfold.plans import cli, grid
from keyfold.sources import results


def test_run_prints_and_appends(spark, capsys, tmp_path):
    csv = str(tmp_path / "hashjoin_spark.csv")
    args = ["run", "-nr", "5", "-ns", "8", "-seed", "13", "-max-key", "8", "-p", "4", "--csv", csv]
    assert cli.main(args, spark) == 0
    out = dict(x.split("=", 1) for x in capsys.readouterr().out.splitlines())
    assert out["join_count"] == "5" and out["checksum1"] == out["naive_checksum1"] == "8842340191968113137" and out["verified"] == "true"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "slurm-1.log").write_text("\n".join(f"{k}={v}" for k, v in out.items()))
    assert cli.main(["check", str(tmp_path / "logs")], spark) == 0
    assert results.load(spark, [csv]).first()["checksum2"] == "10794883823239991901"


@pytest.mark.parametrize("bad", [["-p", "3"], ["-p", "4", "--dataset-type", "skewed_1"]])
def test_bad_arguments(spark, bad):
    assert cli.main(["run", "-nr", "5", "-ns", "8", "-seed", "13", "-max-key", "8", *bad], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["run", "-nr", "5"], spark)


def test_campaign(spark, tmp_path, capsys):
    values = {k: [1] for k in grid.PARAMETERS} | {"n": [20, 600], "p": [4], "max_key": [9], "dataset_type": ["uniform", "skewed_90_25"], "mpi_partition_strategy": ["block"]}
    csv = str(tmp_path / "hashjoin_spark.csv")
    assert cli.main(["campaign", json.dumps(values), "--repeats", "2", "--csv", csv], spark) == 0
    rows = results.load(spark, [csv])
    assert rows.count() == 8 and rows.where("verified = 'true'").count() == 4


def test_campaign_applies_its_parameters(spark, tmp_path, monkeypatch):
    values = {k: [1] for k in grid.PARAMETERS} | {"node": [1, 2], "mpi_process": [2, 4], "n": [300], "p": [8], "max_key": [50], "dataset_type": ["uniform"], "mpi_partition_strategy": ["block", "cyclic"], "join_thread": [3], "partition_thread": [2]}
    seen, real = [], cli.outcome
    monkeypatch.setattr(cli, "outcome", lambda s, sides, strategy, p, ranks, ownership: (seen.append((strategy, ranks, ownership, sides[0].rdd.getNumPartitions(), s.conf.get("spark.sql.shuffle.partitions"))), real(s, sides, strategy, p, ranks, ownership))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    averages = cli.campaign(spark, values, 1, str(tmp_path / "hashjoin_spark.csv"))
    rows = results.load(spark, [str(tmp_path / "hashjoin_spark.csv")]).collect()
    assert averages.count() == len(rows) == 8 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert {(r["mpi_nodes"], r["mpi_processes"], r["mpi_partition_strategy"]) for r in rows} == {(n, m, s) for n in "12" for m in "24" for s in ("block", "cyclic")}
    assert len({(r["join_count"], r["checksum1"], r["checksum2"]) for r in rows}) == 1 and all(r["verified"] == "true" and r["join_threads"] == "3" for r in rows)
    assert {x for x in seen if x[0] == "eager"} == {("eager", m, s, 2, "3") for m in (2, 4) for s in ("block", "cyclic")}
