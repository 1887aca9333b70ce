"""Every catalogue query against its DuckDB SQL."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from linesets import file_queries as files
from linesets import queries as core

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


def canon(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def compare(spark, duck, query, sql):
    mine = query(spark, SF)
    names = sorted(mine.columns)
    got = sorted(tuple(canon(v) for v in r) for r in mine.select(*names).collect())
    theirs = duck.sql(sql)
    assert sorted(theirs.columns) == names
    want = sorted(tuple(canon(v) for v in r) for r in theirs.select(*[f'"{n}"' for n in names]).fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core(spark, duck, name):
    compare(spark, duck, core.QUERIES[name], core.ORACLE[name])


@pytest.mark.parametrize("name", sorted(files.QUERIES))
def test_files(spark, duck, name):
    compare(spark, duck, files.QUERIES[name], files.ORACLE[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
