import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, SMALL = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rule_id", "rank", "score"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_library_stands_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "dossierlake"):
        os.symlink(ROOT / p, tmp_path / p) if p.endswith(".py") else None
    (tmp_path / "dossierlake").mkdir()
    for p in (ROOT / "dossierlake").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "dossierlake" / p.name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    copy = tmp_path / "run"
    copy.mkdir()
    (copy / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    os.symlink(tmp_path / "dossierlake", copy / "dossierlake")
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env | {"PYTHONPATH": str(copy)}).returncode == 0
