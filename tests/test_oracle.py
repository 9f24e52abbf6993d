"""Every registered query against its SQL twin, on the small tables."""

import glob
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

from .conftest import DATA

SF = f"{DATA}/sf0.001"
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    kinds = dict(r[:2] for r in duck.execute(f"DESCRIBE {sql}").fetchall())
    assert columns == sorted(kinds)
    want = sorted(([plain(v) for v in r] for r in duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()), key=str)
    assert got == want
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_arithmetic_runs_over_all_rows(spark):
    assert entry.queries()["arithmetic"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
