"""Every query with SQL gives the rows of an independent engine."""

import glob
import os

import duckdb
import pytest

from quillmesh.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(round(r[i], 8) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE:
        cursor = engine.cursor()
        cursor.execute(ORACLE[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert _rows(df.columns, got) == _rows(columns, cursor.fetchall())
