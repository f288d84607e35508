import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.operators import profile
from ledgerlake.operators.profile import column_profile


def test_exact_statistics_against_numpy(spark, monkeypatch):
    rnd = random.Random(1)
    rows = []
    for load, shift in (("a", 0.0), ("b", 0.5), ("c", 0.5)):
        for i in range(701 + ord(load)):
            v = None if rnd.random() < 0.1 else float("nan") if rnd.random() < 0.02 else float("inf") if rnd.random() < 0.01 else 7.0 if rnd.random() < 0.3 else round(rnd.gauss(shift, 1), 2)
            rows.append((load, v, i % 5, None))
    df = spark.createDataFrame(rows, "load string, x double, n int, empty double")
    out = {(r.column_name, r.load_key): r for r in column_profile(df, F.col("load"), ["x", "n", "empty"], violations={"x": F.col("v") > 6}).collect()}
    finite = {k: np.sort([v for load, v, _, _ in rows if load == k and v is not None and np.isfinite(v)]) for k in "abc"}
    for k in "abc":
        x, r = finite[k], out["x", k]
        assert (r.rows, r.nulls) == (701 + ord(k), sum(load == k and v is None for load, v, _, _ in rows))
        assert r.distinct_values == len(set(x.tolist())) + (1 if r.infinite else 0)
        assert r.top_rows == max(int((x == v).sum()) for v in set(x.tolist()))
        assert abs(r.q50 - float(np.median(x))) < 1e-9
        assert r.violations == int((x > 6).sum())
        assert out["empty", k].q50 is None and out["empty", k].nulls == out["empty", k].rows
    grid = np.unique(np.concatenate([finite["a"], finite["b"]]))
    ks = max(abs(np.searchsorted(finite["a"], v, "right") / finite["a"].size - np.searchsorted(finite["b"], v, "right") / finite["b"].size) for v in grid)
    assert abs(out["x", "b"].ks_distance - ks) < 1e-9 and out["x", "a"].ks_distance is None


def test_decimals_that_share_a_double_stay_apart(spark):
    df = spark.sql("SELECT 'a' AS load, CAST(x AS decimal(28,2)) AS x FROM VALUES ('90071992547409930.01'), ('90071992547409930.02'), ('90071992547409930.02'), ('1.00') AS t(x)")
    r = column_profile(df, F.col("load"), ["x"]).first()
    assert (r.distinct_values, r.top_rows) == (3, 2)


def test_empty_table_null_load_and_dates(spark):
    df = spark.createDataFrame([], "load string, d date")
    assert column_profile(df, F.col("load"), ["d"]).count() == 0
    df = spark.sql("SELECT * FROM VALUES ('a', DATE '2020-01-03'), ('a', DATE '2020-01-01'), (NULL, DATE '2020-01-01') AS t(load, d)")
    r = column_profile(df, F.col("load"), ["d"]).first()
    assert (r.rows, r.q50) == (2, 18263.0)


def test_any_column_type_and_text(spark, monkeypatch):
    monkeypatch.setattr(profile, "LONG_TEXT", 20)
    monkeypatch.setattr(profile, "GRID_CELLS", 1)
    rnd = random.Random(3)
    texts = ["AB-12", "ab", "  ", "", "x" * 40, "x" * 40 + "y", "É9", None]
    rows = [(k, rnd.choice(texts), i % 3 == 0, (1 << 60) + i % 4, [i % 2], b"\x01" if i % 2 else None, {"a": i % 5}) for k in "abc" for i in range(200)]
    rows += [("b2", None, None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "load string, t string, f boolean, big long, arr array<int>, bin binary, m map<string,int>")
    out = {(r.column_name, r.load_key): r for r in column_profile(df, F.col("load"), patterns={"t": "^[A-Z]{2}-[0-9]+$"}).collect()}
    assert {c for c, _ in out} == set(df.columns)
    for k in "abc":
        mine = [r[1] for r in rows if r[0] == k and r[1] is not None]
        r = out["t", k]
        assert (r.distinct_values, r.nulls, r.min_text, r.q50, r.min_value) == (len(set(mine)), 200 - len(mine), "", None, None)
        assert r.blanks == sum(not t.strip() for t in mine) and (r.min_length, r.max_length) == (0, 41)
        assert r.pattern_violations == sum(t != "AB-12" for t in mine) and r.patterns == 6
        assert r.median_text == sorted(mine)[(len(mine) - 1) // 2][:20]
        assert (out["big", k].distinct_values, out["f", k].distinct_values, out["arr", k].distinct_values, out["bin", k].nulls, out["m", k].distinct_values) == (4, 2, 2, 100, 5)
    a, c = ([r[1] for r in rows if r[0] == k and r[1] is not None] for k in "bc")
    ks = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in c) / len(c)) for t in set(a + c))
    r = out["t", "c"]  # the load before has no values at all: the last one with values counts
    assert r.previous_load == "b2" and abs(r.ks_distance - ks) < 1e-9 and out["t", "b2"].distinct_values == 0
