from keyfold.operators import join
from keyfold.sources import datasets
from keyfold.streaming import join as streaming


def test_batches_add_up_to_the_whole(spark, tmp_path):
    r, s = (datasets.relation(spark, 2000, seed, 50, 16, "skewed_90_25") for seed in (1, 2))
    folder = str(tmp_path / "state")
    for part in range(3):
        for side, df in (("R", r), ("S", s)):
            df.where(f"i % 3 = {part}").select("key").coalesce(1).write.mode("append").parquet(str(tmp_path / side))
            stream = spark.readStream.schema("key long").parquet(str(tmp_path / side))
            assert streaming.count(stream, "key", folder, side).awaitTermination(120)
        have = [df.where(f"i % 3 <= {part}") for df in (r, s)]
        assert streaming.result(spark, folder).first() == join.checksum_join(*have).first()


def test_compaction_keeps_the_sums(spark, tmp_path):
    rows = spark.range(600).selectExpr("id % 7 AS key")
    folder = str(tmp_path / "state")
    for part in range(4):
        rows.where(f"key % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "R"))
        assert streaming.count(spark.readStream.schema("key long").parquet(str(tmp_path / "R")), "key", folder, "R").awaitTermination(120)
        if part != 2:
            streaming.compact(spark, folder, "R")
        want = {r["key"]: r["n"] for r in join.multiplicity(rows.where(f"key % 4 <= {part}"), "key").collect()}
        assert {r["key"]: r["n"] for r in streaming.totals(spark, folder, "R").collect()} == want
    assert [p.name for p in (tmp_path / "state" / "R").iterdir() if p.name.startswith("batch")] == ["batch=3"]
    assert streaming.result(spark, folder).first()["join_count"] == 0


def test_products_wrap_as_in_the_batch_join(spark, tmp_path):
    for side in "RS":
        spark.createDataFrame([(5, 1 << 40)], "key long, n long").write.parquet(str(tmp_path / side / "batch=0"))
    assert streaming.result(spark, str(tmp_path)).first()["join_count"] == 0  # 2^80
