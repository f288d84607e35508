import random

from pyspark.sql import functions as F

from ledgerlake.operators import known_at as K
from ledgerlake.operators.known_at import DAY_US, known_at

EVENTS = "event_id int, k string, day int"
VERSIONS = "k string, us long, value string"


def run(spark, events, versions):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    out = known_at(e, v, "k", (F.col("day").cast("long") + 1) * F.lit(DAY_US), F.col("us"), {"since": F.col("us"), "value": F.col("value")})
    return sorted((r.event_id, r.since, r.value) for r in out.collect())


def brute(events, versions):
    out = []
    for i, k, day in events:
        known = [(us, x or "", x) for kk, us, x in versions if k is not None and kk == k and us is not None and day is not None and us < (day + 1) * DAY_US]
        best = max(known, default=None)
        out.append((i, best[0], best[2]) if best else (i, None, None))
    return sorted(out)


def test_edges(spark):
    versions = [("a", DAY_US, "at midnight"), ("a", 2 * DAY_US - 1, "last of day 1"), ("a", 5 * DAY_US, "x"), ("a", 5 * DAY_US, "y"), ("b", None, "never"), (None, 1, "none")]
    events = [(1, "a", 0), (2, "a", 1), (3, "a", 4), (4, "a", 5), (5, "b", 9), (6, None, 9), (7, "c", 9), (8, "a", None), (9, "a", 1)]
    assert run(spark, events, versions) == brute(events, versions)


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", 1)], []) == [(1, None, None)]
    assert run(spark, [], [("a", 1, "v")]) == []


def test_hot_entities_are_spread_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", 50)
    rnd = random.Random(2)
    events = [(i, "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", rnd.randrange(100)) for i in range(1500)]
    versions = [(rnd.choice(["hot", *(f"k{j}" for j in range(40))]), rnd.randrange(100 * DAY_US), f"v{i}") for i in range(400)]
    assert run(spark, events, versions) == brute(events, versions)


def test_clashing_names(spark):
    e = spark.createDataFrame([(1, "a", 1, "mine", 7, 8)], EVENTS + ", value string, k_ int, since_ int")
    v = spark.createDataFrame([("a", 5, "theirs")], VERSIONS)
    out = known_at(e, v, "k", F.lit(DAY_US), F.col("us"), {"value": F.col("value")})
    assert out.columns == ["event_id", "k", "day", "k_", "since_", "value"]
    assert tuple(out.first()) == (1, "a", 1, 7, 8, "theirs")


def test_other_types_pass_through(spark):
    e = spark.sql("SELECT 'a' AS k, TIMESTAMP '2020-01-02 03:04:05.678901' AS t, DATE '2020-01-02' AS d, CAST(1.5 AS decimal(28,2)) AS m, array(1, 2) AS l, CAST(NULL AS double) AS x")
    v = spark.sql("SELECT 'a' AS k, TIMESTAMP '2020-01-01 00:00:00' AS since, CAST(2.25 AS decimal(10,2)) AS amount, DATE '2019-01-01' AS day")
    end = (F.unix_date("d").cast("long") + 1) * F.lit(DAY_US)
    out = known_at(e, v, "k", end, F.unix_micros("since"), {"amount": F.col("amount"), "day": F.col("day"), "since": F.col("since")}).first()
    assert (out.t, out.d, out.m, out.l, out.x) == tuple(e.first()[1:])
    assert (out.amount, out.day, out.since) == (v.first().amount, v.first().day, v.first().since)


def test_events_without_a_key_are_spread(spark, monkeypatch):
    true = K._asof

    def watched(*a):
        run = true(*a)

        def small(events, versions):
            assert events.num_rows < 800, "one bucket holds all events without a key"
            return run(events, versions)

        return small

    monkeypatch.setattr(K, "_asof", watched)
    events = [(i, None if i % 5 else "a", i % 100) for i in range(1500)]
    versions = [("a", d * DAY_US, f"v{d}") for d in range(0, 100, 7)] + [(None, 1, "none")]
    for rows in (K.HOT_ROWS, 50):
        monkeypatch.setattr(K, "HOT_ROWS", rows)
        assert run(spark, events, versions) == brute(events, versions)
