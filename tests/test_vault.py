from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.hashing import hashdiff, key_hash, ts_text
from ledgerlake.operators.vault import asof_expand, collapse, latest_rows, load_hub, load_link, load_satellite, payload_conflicts

T1, T2, T3 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)


def test_golden_hash_and_null_parts(spark):
    df = spark.sql("SELECT '0000320193' AS a, CAST(NULL AS string) AS b, TIMESTAMP '2026-01-01 00:00:00.5' AS t")
    r = df.select(key_hash("a").alias("h"), key_hash("a", "b").alias("n"), key_hash("a", "b", nullable=(1,)).alias("m"), key_hash("a", F.lit("^^")).alias("e"), hashdiff("b").alias("d"), ts_text("t").alias("t")).first()
    assert r.h == "2868C13AF99C02EE73164889411A55E30926673596D33928A7E2F1043FCF6295"
    assert r.n is None and r.m == r.e and len(r.d) == 64 and r.t == "2026-01-01 00:00:00.500000"


def test_hub_and_link_reload_adds_nothing(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), (None, "c")], "cik string, accn string")
    hub = load_hub(rows, None, "cik", "hk", T1, "s")
    assert hub.count() == 2 and load_hub(rows, hub, "cik", "hk", T2, "s").count() == 0
    link = load_link(rows, None, ["cik", "accn"], "lk", {"c_hk": "cik"}, T1, "s")
    assert link.count() == 3 and link.where("lk IS NULL").count() == 1
    assert load_link(rows.where("cik IS NOT NULL"), link, ["cik", "accn"], "lk", {"c_hk": "cik"}, T2, "s").count() == 0


def test_satellite_a_b_a(spark):
    schema = "p string, name string"
    load = lambda rows, old, t: load_satellite(spark.createDataFrame(rows, schema), old, "p", ["name"], "hk", t, "s")
    s1 = load([("1", "A"), ("2", None)], None, T1)
    assert load([("1", "A"), ("2", None)], s1, T2).count() == 0
    s2 = s1.unionByName(load([("1", "B")], s1, T2))
    s3 = s2.unionByName(load([("1", "A")], s2, T3))
    assert s3.where("p = '1'").count() == 3 and s3.select("hk").distinct().count() == 4
    assert payload_conflicts(spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "A"), ("2", "A")], schema), ["p"], ["name"]).count() == 1


def test_multi_active_satellite(spark):
    rows = spark.createDataFrame([("c", "t1", "x"), ("c", "t2", "x")], "p string, cdk string, v string")
    s = load_satellite(rows, None, "p", ["v"], "hk", T1, "s", child_key="cdk")
    assert s.count() == 2 and load_satellite(rows, s, "p", ["v"], "hk", T2, "s", child_key="cdk").count() == 0


@pytest.mark.parametrize("rule,rows,won", [
    ("value_desc", [("a", 1, 5.0), ("b", 2, 9.0)], "b"),
    ("value_desc", [("a", 1, 5.0), ("b", 2, 5.0)], "a"),
    ("preference_rank_asc", [("a", 1, 5.0), ("b", 2, 9.0)], "a"),
    ("preference_rank_asc", [("b", 2, 9.0)], "b"),
    ("value_desc", [("a", None, 5.0), ("b", 9, 5.0)], "b"),
])
def test_collapse_rules(spark, rule, rows, won):
    df = spark.createDataFrame([("g", t, r, v, rule) for t, r, v in rows], "g string, tag string, rank int, value double, rule string")
    assert [r.tag for r in collapse(df, ["g"], "rule", "rank", "value").collect()] == [won]


def test_asof_and_latest(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2020-06-01'), (2, DATE '2020-12-31'), (3, NULL), (4, DATE '2030-01-01') AS t(i, filed)")
    out = asof_expand(df, ["2020-12-31", "2019-12-31", "2021-12-31"], "filed")
    assert sorted((r.i, str(r.as_of_date)) for r in out.collect()) == [(1, "2020-12-31"), (1, "2021-12-31"), (2, "2020-12-31"), (2, "2021-12-31")]
    df = spark.createDataFrame([("a", T1, 1), ("a", T2, 2), ("a", T2, 3)], "k string, load_datetime timestamp, v int")
    assert [r.v for r in latest_rows(df, ["k"]).collect()] == [3]
