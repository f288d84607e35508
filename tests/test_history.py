import random

from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.operators.history import HistoryStore, build_history, raw_changes

SCHEMA = "key string, t long, name string, value int, same string"
YEAR = 366 * 86_400_000_000


def raw(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    return raw_changes(df, F.col("key"), F.col("t"), F.col("name"), X.same_name("name"))


def chains(df):
    return sorted((r.k, r.same, r.valid_from_us, r.valid_to_us) for r in df.collect())


def brute(rows):
    by = {}
    for k, t, n in rows:
        if None not in (k, t, n):
            by.setdefault(k, set()).add((t, " ".join(n.split()).lower()))
    out = []
    for k, seen in by.items():
        runs = []
        for t, n in sorted(seen):
            if not runs or runs[-1][0] != n:
                runs.append((n, t))
        out += [(k, n, t, runs[i + 1][1] if i + 1 < len(runs) else None) for i, (n, t) in enumerate(runs)]
    return sorted(out)


def test_returning_names_and_nulls(spark):
    rows = [("a", 1, "X"), ("a", 2, " x "), ("a", 3, None), ("a", 4, "Y"), ("a", 3 * YEAR, "X"), ("a", 3 * YEAR, "X"), (None, 1, "X"), ("b", None, "X"), ("b", 7, "")]
    assert chains(build_history(raw(spark, rows))) == brute(rows)
    assert chains(build_history(raw(spark, []))) == []


def test_late_updates_rebuild_only_touched_chains(spark):
    rnd = random.Random(4)
    rows = [(f"k{rnd.randrange(30)}", rnd.randrange(9 * YEAR), rnd.choice("XYZ")) for _ in range(400)] + [("hot", rnd.randrange(9 * YEAR), rnd.choice("XY")) for _ in range(200)]
    rnd.shuffle(rows)
    store = HistoryStore(spark)
    store.apply(raw(spark, rows[:400]))
    before = store.state()
    untouched = [c for c in chains(store.chains()) if c[0] not in {k for k, _, _ in rows[400:]}]
    old = store.chains()
    store.apply(raw(spark, rows[400:])).apply(raw(spark, [])).apply(raw(spark, rows[:50]))
    assert store.state() != before
    assert chains(store.chains()) == brute(rows)
    assert [c for c in chains(store.chains()) if c in set(untouched)] == untouched
    assert chains(old) == brute(rows[:400])  # a reader keeps the state it opened
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert chains(store.chains()) == brute(rows)


def test_hot_entities_by_slices(spark):
    rnd = random.Random(6)
    rows = [("hot", rnd.randrange(3000), rnd.choice("XY")) for _ in range(900)] + [("warm", rnd.randrange(50), "same") for _ in range(300)] + [(f"k{rnd.randrange(40)}", rnd.randrange(90), rnd.choice("XYZ")) for _ in range(300)]
    assert chains(build_history(raw(spark, rows), hot_rows=100)) == brute(rows)


def corrected(spark, rows):
    df = spark.createDataFrame(rows, "key string, t long, name string, d int")
    return raw_changes(df, F.col("key"), F.col("t"), F.col("name"), X.same_name("name"), F.col("d"))


def test_last_delivery_of_an_instant_counts(spark):
    rows = [("a", 1, "X", 1), ("a", 2, "Wrong", 1), ("a", 2, "Right", 2), ("a", 3, "Right", None), ("a", 4, "P", None), ("a", 4, "Q", None), ("b", 1, "Z", 3), ("b", 1, "Y", 2)]
    want = [("a", "p", 4, 4), ("a", "q", 4, None), ("a", "right", 2, 4), ("a", "x", 1, 2), ("b", "z", 1, None)]
    assert chains(build_history(corrected(spark, rows))) == want
    assert chains(build_history(corrected(spark, rows), hot_rows=1)) == want
    store = HistoryStore(spark, bucket_rows=1).apply(corrected(spark, [r for r in rows if r[2] not in ("Right", "Z")])).apply(corrected(spark, [r for r in rows if r[2] in ("Right", "Z")]))
    assert chains(store.chains()) == want


def _bytes(path, states):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for s in states for d, _, fs in os.walk(os.path.join(path, s)) for f in fs if f.endswith(".parquet"))


def test_an_update_costs_what_it_touches(spark):
    wrote = []
    for size in (2_000, 20_000):
        rows = [(f"k{i % (size // 10)}", i, f"name {i % 7}") for i in range(size)]
        store = HistoryStore(spark, bucket_rows=200).apply(raw(spark, rows))
        store.apply(raw(spark, [("k5", 777, "late")]))
        wrote.append((_bytes(store.path, [store.state()]), sum(len(g) for g in store.manifest()["raw"].values())))
        assert chains(store.chains()) == brute([*rows, ("k5", 777, "late")])
    assert wrote[1][0] < 1.5 * wrote[0][0], wrote


def test_many_updates_merge_a_buckets_parts(spark):
    rows = [("a", t, "XY"[t // 3 % 2]) for t in range(20)]
    store = HistoryStore(spark, bucket_rows=1000).apply(raw(spark, rows[:1]))
    for r in rows[1:]:
        store.apply(raw(spark, [r]))
    assert max(len(g) for g in store.manifest()["raw"].values()) < 18
    assert chains(store.chains()) == brute(rows) and store.raw().count() == 20
    store.vacuum()
    assert chains(store.chains()) == brute(rows)


def test_empty_store(spark):
    assert HistoryStore(spark).apply(raw(spark, [])).chains().count() == 0
