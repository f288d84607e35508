import os

import duckdb
import pytest

from ledgerlake.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_with_its_columns(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() >= 0
    fixed = {"p7_found": ["sat_concept_value_hk", "concept_name", "value_cents"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    assert df.columns == fixed.get(name, df.columns)


def test_p7_matches_its_sql(spark):
    con = duckdb.connect()
    for t in ("sat_concept_value", "canonical_concept_tag_preference"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["p7_found"]).fetchall())
    assert sorted(map(tuple, queries.p7_found(spark, DATA).collect())) == want and want


def test_shares_add_up(spark):
    rows = queries.p9_shares(spark, DATA).collect()
    assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9
