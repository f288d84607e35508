"""Every query with SQL gives the SQL's rows; the others give a stable schema."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
CORE = {k: v for k, v in __spark_entry__.queries().items() if k not in {q for part in __spark_entry__._PARTS if part.__name__.endswith("llm.queries") for q in part.QUERIES}}
SQL = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(__spark_entry__.queries())
