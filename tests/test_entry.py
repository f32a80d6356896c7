from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = entry.catalog.QUERIES | entry.jobs.QUERIES
ORACLES = entry.catalog.ORACLES | entry.jobs.ORACLES


def rounded(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(rounded, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_oracle(spark, sf, duck, name):
    table = QUERIES[name](spark, sf).toArrow()
    sql = ORACLES.get(name)
    if sql is None:
        assert table.num_columns > 0
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(table.column_names)
    want = sorted((tuple(rounded(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(rounded(r[c]) for c in sorted(names)) for r in table.to_pylist()), key=repr)
    assert got == want


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "marlquarry", tmp_path / "marlquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], said.stderr
