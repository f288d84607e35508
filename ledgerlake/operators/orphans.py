"""References to records that do not exist, or did not exist yet.

Method: keys are dictionary-encoded as integers inside hash buckets; compressed bitmaps per
key range and period are built for the referencing and for the parent side; ``reference AND
NOT parents known before the period`` leaves the suspect bits, which are decoded to keys. A
parent that arrives within the same period is then compared by its exact time.

Scale: references are reduced to distinct (relation, key, period) before the shuffle, so a key
that holds a third of all rows is a few hundred bits. Only suspect keys meet the rows again,
in an equi-join on (relation, key, period) that AQE may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.bitmap import Bitmap
from ledgerlake.session import buckets_for

#: Period of references that are checked against parents "whenever loaded".
ANY_TIME = 1 << 30


def month_index(ts: str) -> F.Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def suspects_in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (relation, ref_key, period, parent_us, is_parent) of one bucket -> suspect keys."""
    found: list[pd.DataFrame] = []
    for relation, rows in pdf.groupby("relation", sort=False):
        codes, names = pd.factorize(rows["ref_key"].to_numpy())
        is_parent = rows["is_parent"].to_numpy(dtype=bool)
        period = rows["period"].to_numpy()
        first_us = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(first_us, codes[is_parent], rows["parent_us"].to_numpy()[is_parent].astype(np.int64))

        def by_period(mask: np.ndarray, codes: np.ndarray = codes, period: np.ndarray = period) -> Iterator[tuple[int, Bitmap]]:
            order = np.argsort(period[mask], kind="stable")
            c, p = codes[mask][order], period[mask][order]
            starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if p.size else np.empty(0, dtype=int)
            for s, e in zip(starts, np.r_[starts[1:], p.size], strict=True) if p.size else ():
                yield int(p[s]), Bitmap.of(c[s:e].astype(np.int64))

        known, parents = Bitmap(), list(by_period(is_parent))
        at = 0
        for p, refs in by_period(~is_parent):
            while at < len(parents) and parents[at][0] < p:
                known = known.or_(parents[at][1])
                at += 1
            left = refs.and_not(known).decode()
            if left.size:
                us = pd.Series(first_us[left], dtype="Int64")
                us = us.mask(us == np.iinfo(np.int64).max)
                found.append(pd.DataFrame({"relation": relation, "ref_key": names[left], "period": np.int32(p), "parent_us": us}))
    if not found:
        return pd.DataFrame({"relation": pd.Series(dtype=str), "ref_key": pd.Series(dtype=str), "period": pd.Series(dtype="int32"), "parent_us": pd.Series(dtype="Int64")})
    return pd.concat(found, ignore_index=True)


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference without a parent, or with a parent that arrived only later.

    ``refs``: relation, row_key, ref_key (already normalised; text or binary), ref_ts (timestamp; NULL means
    "whenever loaded"). ``parents``: relation, ref_key, parent_ts. Result: relation, row_key,
    ref_key, ref_ts, parent_ts (NULL: never arrived), distinct.

    NULL keys are no references; an empty key is one (and has no parent unless a parent's key
    is empty too). A parent without a time counts as always known. Repeated rows give one row;
    empty inputs give an empty result; extra columns are ignored.
    """
    r = refs.where(F.col("ref_key").isNotNull()).select(
        "relation", "row_key", "ref_key", "ref_ts", F.coalesce(month_index("ref_ts"), F.lit(ANY_TIME)).alias("period")
    )
    p = (
        parents.where(F.col("ref_key").isNotNull())
        .groupBy("relation", "ref_key")
        .agg(F.min(F.coalesce(F.unix_micros("parent_ts"), F.lit(-(1 << 62)))).alias("parent_us"))
        .withColumn("period", _period_of_us("parent_us"))
    )
    kind = dict(refs.dtypes)["ref_key"]
    marks = r.groupBy("relation", "ref_key", "period").agg(F.lit(0).cast("long").alias("parent_us"))
    events = marks.withColumn("is_parent", F.lit(False)).unionByName(p.withColumn("is_parent", F.lit(True)))
    n = buckets_for(refs, parents, each=4)  # several a partition, so that partitions come out even
    suspects = (
        events.withColumn("bucket", F.pmod(F.xxhash64("relation", "ref_key"), F.lit(n)).cast("int"))
        .groupBy("bucket")
        .applyInPandas(suspects_in_bucket, f"relation string, ref_key {kind}, period int, parent_us long")
    )
    late = F.col("parent_us").isNull() | (F.col("ref_ts").isNotNull() & (F.col("parent_us") > F.unix_micros("ref_ts")))
    return (
        r.join(suspects, ["relation", "ref_key", "period"])
        .where(late)
        .select("relation", "row_key", "ref_key", "ref_ts", F.timestamp_micros("parent_us").alias("parent_ts"))
        .distinct()
    )


def _period_of_us(us: str) -> F.Column:
    """Month of a time in microseconds; parents without a time come before every period."""
    ts = F.timestamp_micros(F.when(F.col(us) > -(1 << 62), F.col(us)))
    return F.coalesce((F.year(ts) * 12 + F.month(ts) - 1).cast("int"), F.lit(-1))
