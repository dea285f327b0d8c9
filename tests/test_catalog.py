"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables; and the entry module without its optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from keyfold.plans import catalog, oracles

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def cell(x):
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name not in oracles.SQL:
        assert df.count() > 0
        return
    rel = duck.sql(oracles.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(map(cell, r)) for r in df.collect()) == want


@pytest.mark.parametrize("keep", [True, False])
def test_entry_module(tmp_path, keep):
    """It imports, also where the optional subpackage and the pipeline are gone."""
    import shutil

    for f in ("__spark_entry__.py", *(("corpus_pipeline.py",) if keep and (ROOT / "corpus_pipeline.py").exists() else ())):
        shutil.copy(ROOT / f, tmp_path)
    shutil.copytree(ROOT / "keyfold", tmp_path / "keyfold", ignore=shutil.ignore_patterns(*([] if keep else ["llm"]), "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'join_checksum_orders_lineitem' in q and set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
