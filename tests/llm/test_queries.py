import glob
import os

import duckdb
import pytest

from quillmesh.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, engine, name):
    """Every query runs over its whole tables; those with SQL give its rows, the others no row twice."""
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(map(str, rows)))
    assert df.columns and set(ORACLE) <= set(QUERIES)
    if name in ORACLE:
        cursor = engine.cursor()
        cursor.execute(ORACLE[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(str(tuple(dict(zip(df.columns, r))[n] for n in sorted(names))) for r in rows) == sorted(str(tuple(dict(zip(names, r))[n] for n in sorted(names))) for r in cursor.fetchall())
