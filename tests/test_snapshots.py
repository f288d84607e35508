from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.operators.snapshots import snapshot_changes


def changes(spark, rows, schema="cik string, day string, name string, city string", **kw):
    df = spark.createDataFrame(rows, schema)
    out = snapshot_changes(df, F.col("cik"), F.col("day"), {"name": X.same_name("name"), "city": F.col("city")}, **kw)
    return sorted((r.snapshot_key, r.to_date, r.change, tuple(r.changed_fields)) for r in out.collect())


def test_added_removed_changed(spark):
    rows = [("1", "a", "X Co", "P"), ("2", "a", "Y", "P"), ("3", "a", None, "P"), ("1", "b", "x  co", "Q"), ("3", "b", "Z", "P"), ("4", "b", "W", "P"), ("1", "c", "X Co", "Q"), ("2", "c", "Y", "P")]
    assert changes(spark, rows) == [("1", "b", "changed", ("city",)), ("2", "b", "removed", ()), ("2", "c", "added", ()), ("3", "c", "removed", ()), ("4", "b", "added", ()), ("4", "c", "removed", ())]


def test_null_is_a_value_on_request(spark):
    rows = [("1", "a", None, "P"), ("1", "b", "N", "P")]
    assert changes(spark, rows) == []
    assert changes(spark, rows, null_transitions=True) == [("1", "b", "changed", ("name",))]


def test_repeats_nulls_and_few_dates(spark):
    rows = [("1", "a", "N", "P")] * 5 + [("1", "b", "N", "P")] * 2 + [(None, "b", "N", "P"), ("9", None, "N", "P")]
    assert changes(spark, rows) == []
    assert changes(spark, rows[:5]) == []
    assert changes(spark, []) == []


def test_clashing_column_names(spark):
    df = spark.createDataFrame([("1", "a", "N", 1, 2), ("1", "b", "M", 1, 2)], "k string, d string, name string, sum int, sign int")
    out = snapshot_changes(df, F.col("k"), F.col("d"), {"name": F.col("name"), "sum": F.col("sum")}).collect()
    assert [(r.change, r.changed_fields) for r in out] == [("changed", ["name"])]


def test_many_dates_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    days = [f"d{i:03d}" for i in range(70)]  # more than two words of pairs
    rows = [(str(k), d, rnd.choice(["x", "y", "z", None]), rnd.choice("PQ")) for k in range(12) for d in days if rnd.random() < 0.8 for _ in range(rnd.randrange(1, 3))]
    held = {}
    for k, d, *values in rows:
        for f, v in zip(("name", "city"), values, strict=True):
            if v is not None:
                held.setdefault((k, d, f), set()).add(v)
    there = {(k, d) for k, d, *_ in rows}
    want = []
    for a, b in zip(days, days[1:]):
        for k in {k for k, _ in there}:
            if ((k, a) in there) != ((k, b) in there):
                want.append((k, b, "added" if (k, b) in there else "removed", ()))
            else:
                old, new = ({f: held.get((k, d, f), set()) for f in ("city", "name")} for d in (a, b))
                fields = tuple(f for f in ("city", "name") if old[f] - new[f] and new[f] - old[f])
                want += [(k, b, "changed", fields)] if fields else []
    assert changes(spark, rows) == sorted(want)
