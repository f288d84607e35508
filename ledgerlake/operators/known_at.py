"""Attributes as known at event time: an as-of left join that is safe for hot entities.

Method: entities are hash-partitioned; each bucket runs an embedded DuckDB ``ASOF LEFT JOIN``
of its events against the entity's versions in order of availability. Ties (several versions
that became available at the same instant) are resolved to one before the join.

Scale: versions are reduced to the last one per entity and tick (by default a day, events being
dated by days) before the bucket shuffle, so an entity has at most one version a day. An entity
with more than HOT_ROWS and a hundred-thousandth of all events (there are fewer than 100,000 such
entities) has its events spread over several buckets, each with a copy of that entity's versions. Events with a NULL
key meet no version, so they are spread over all buckets.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlake.session import buckets_for

DAY_US = 86_400_000_000
#: Events of one entity that a single task takes at least before it counts as hot.
HOT_ROWS = 200_000
#: Hot entities are fewer than this, whatever the events: about 5 MB collected and broadcast.
MOST_HOT = 100_000


def _asof(schema: pa.Schema, event_columns: list[str], carry: list[str], k: str, before: str):
    picked = ", ".join([f'e."{c}"' for c in event_columns] + [f'v."{c}"' for c in carry])
    sql = f'SELECT {picked} FROM events e ASOF LEFT JOIN versions v ON e."{k}" = v."{k}" AND e."{before}" > v.since_'

    def run(events: pa.Table, versions: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect()
        try:
            con.execute("SET threads = 1")
            con.execute("SET memory_limit = '600MB'")
            con.execute("SET temp_directory = ''")  # nothing spills to the worker's own disk; a bucket is sized to fit
            con.register("events", events)
            con.register("versions", versions)
            return con.sql(sql).to_arrow_table().cast(schema)
        finally:
            con.close()

    return run


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def known_at(events: DataFrame, versions: DataFrame, key: str, before_us: Column, since_us: Column, carry: dict[str, Column], tick_us: int = DAY_US) -> DataFrame:
    """Each event with the version of its entity that was the latest available before it.

    ``key`` is a column of one type on both sides. ``before_us`` (over events) and ``since_us`` (over versions) are microseconds since 1970; a
    version counts if ``since_us < before_us``. ``before_us`` must lie on multiples of
    ``tick_us``. ``carry`` names what is taken from the version. Result: all columns of
    ``events`` and those of ``carry``, one row per event row.

    Ties at one instant go to the greatest carried values (NULL lowest). Events with a NULL key
    or time, and events before the first version, carry NULLs. Versions with a NULL key or time
    are never known. Repeated events are kept; empty inputs are fine. An event column of the
    name of a carried one gives way to it.
    """
    names = list(carry)
    kept = [c for c in events.columns if c not in names]
    taken = {*events.columns, *names, "since_", "tick_", "v_"}
    k, before, salt, bucket, copies = (_free(n, taken) for n in ("k_", "before_", "salt_", "bucket_", "copies_"))
    e = events.withColumns({k: F.col(key), before: before_us}).select(*kept, k, before)
    v = (
        versions.select(F.col(key).alias(k), since_us.alias("since_"), *[c.alias(n) for n, c in carry.items()])
        .where(F.col(k).isNotNull() & F.col("since_").isNotNull())
        .groupBy(k, F.floor(F.col("since_") / F.lit(tick_us)).alias("tick_"))
        .agg(F.max(F.struct("since_", *names)).alias("v_"))
        .select(k, "v_.*")
    )
    total = events.count()
    hot_rows = max(HOT_ROWS, total // MOST_HOT)
    hot = e.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).collect() if total > hot_rows else []  # fewer than MOST_HOT rows
    n = buckets_for(versions, rows=total)
    if hot:
        spread = F.broadcast(events.sparkSession.createDataFrame([(r[k], -(-r.n // hot_rows)) for r in hot], f"{k} {dict(e.dtypes)[k]}, {copies} int"))
        e = e.join(spread, k, "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in kept], F.monotonically_increasing_id()), F.coalesce(copies, F.lit(1))).cast("int")).drop(copies)
        v = v.join(spread, k, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop(copies)
    else:
        e, v = e.withColumn(salt, F.lit(0)), v.withColumn(salt, F.lit(0))
    by_key = F.xxhash64(k, salt)
    by_row = F.xxhash64(*[F.col(c) for c, kind in e.select(*kept).dtypes if "map<" not in kind], F.monotonically_increasing_id())
    e = e.withColumn(bucket, F.pmod(F.when(F.col(k).isNull(), by_row).otherwise(by_key), F.lit(n)).cast("int")).drop(salt)
    v = v.withColumn(bucket, F.pmod(by_key, F.lit(n)).cast("int")).drop(salt)
    of = {f.name: f.dataType for f in (*v.schema.fields, *events.schema.fields) if f.name in kept or f.name in names} | {f.name: f.dataType for f in v.schema.fields if f.name in names}
    out = T.StructType([T.StructField(c, of[c], True) for c in (*kept, *names)])
    return e.groupBy(bucket).cogroup(v.groupBy(bucket)).applyInArrow(_asof(to_arrow_schema(out), kept, names, k, before), out)
