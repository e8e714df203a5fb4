"""The driver's contract, with and without the llm subpackage; and each query against its SQL on small tables."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_import_without_llm(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})
    n, m = map(int, done.stdout.split())
    assert n > 45 and 40 < m <= n


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables aren't here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from fragspark.plans import catalog

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cell = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    for name, query in catalog.QUERIES.items():
        frame = query(spark, str(SMALL))
        columns = sorted(frame.columns)
        got = sorted((tuple(cell(r[c]) for c in columns) for r in frame.collect()), key=str)
        if name in catalog.ORACLES:
            rel = con.sql(catalog.ORACLES[name])
            assert sorted(rel.columns) == columns, name
            at = [rel.columns.index(c) for c in columns]
            assert got == sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str), name
