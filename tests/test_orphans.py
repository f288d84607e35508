import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.functions.bitmap import Bitmap
from ledgerlake.operators.orphans import orphan_references

REFS = "relation string, row_key string, ref_key string, ref_ts timestamp"
PARENTS = "relation string, ref_key string, parent_ts timestamp"
T0 = datetime(2020, 1, 31, 23, 59)


@given(st.sets(st.integers(0, 300_000)), st.sets(st.integers(0, 300_000)))
@settings(max_examples=40, deadline=None)
def test_bitmap_matches_sets(a, b):
    x, y = Bitmap.of(np.array(sorted(a), dtype=np.int64)), Bitmap.of(np.array(sorted(b), dtype=np.int64))
    assert set(x.and_not(y).decode().tolist()) == a - b
    assert set(x.or_(y).decode().tolist()) == a | b


def test_bitmap_dense_ranges():
    a, b = np.arange(0, 60_000), np.arange(5_000, 70_000, 2)
    assert set(Bitmap.of(a).and_not(Bitmap.of(b)).decode().tolist()) == set(a.tolist()) - set(b.tolist())
    assert Bitmap.of(a).or_(Bitmap.of(b)).decode().size == len(set(a.tolist()) | set(b.tolist()))


def found(spark, refs, parents):
    rows = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
    return sorted((r.relation, r.row_key) for r in rows)


def test_missing_late_and_same_instant(spark):
    refs = [("a", "1", "k1", T0), ("a", "2", "k2", T0), ("a", "3", "k3", T0), ("a", "4", None, T0), ("a", "5", "", T0), ("b", "6", "k1", T0), ("a", "7", "k4", None)]
    parents = [("a", "k1", T0), ("a", "k2", T0 + timedelta(minutes=1)), ("a", "k4", T0 + timedelta(days=99)), ("a", None, T0)]
    # k1 at the same instant is known; k2 came a minute later, in the next month; k4 counts whenever loaded
    assert found(spark, refs, parents) == [("a", "2"), ("a", "3"), ("a", "5"), ("b", "6")]


def test_repeats_earliest_parent_and_unknown_time(spark):
    refs = [("a", "1", "k", T0)] * 3 + [("a", "2", "x", T0)]
    parents = [("a", "k", T0 + timedelta(days=1)), ("a", "k", T0 - timedelta(days=1)), ("a", "x", None)]
    assert found(spark, refs, parents) == []


def test_empty_tables_and_extra_columns(spark):
    assert found(spark, [], []) == []
    assert found(spark, [("a", "1", "k", T0)], []) == [("a", "1")]
    refs = spark.createDataFrame([("a", "1", "k", T0, 7, 8)], REFS + ", period int, bucket int")
    assert orphan_references(refs, spark.createDataFrame([], PARENTS)).count() == 1


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(3)
    keys = [f"k{i}" for i in range(200)]
    when = lambda: T0 + timedelta(minutes=rnd.randrange(600_000))
    parents = [("a", k, when()) for k in keys[:150] for _ in range(2)]
    refs = [("a", str(i), "k199" if i % 3 == 0 else rnd.choice(keys), when()) for i in range(3000)]
    first = {}
    for _, k, t in parents:
        first[k] = min(t, first.get(k, t))
    expected = sorted(("a", r) for _, r, k, t in refs if k not in first or first[k] > t)
    assert found(spark, refs, parents) == expected
