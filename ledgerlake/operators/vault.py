"""Loaders of the raw vault: insert-only hubs and links, insert-on-change satellites.

All loaders are pure: they take what arrives and what exists and return the rows to append, so
no merge is needed. The same batch loaded again gives no rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.hashing import hashdiff, key_hash, ts_text


def _lineage(df: DataFrame, load_ts: datetime, source: str) -> DataFrame:
    return df.withColumn("load_datetime", F.lit(load_ts).cast("timestamp")).withColumn("record_source", F.lit(source))


def load_hub(inbound: DataFrame, existing: DataFrame | None, key: str, hk: str, load_ts: datetime, source: str) -> DataFrame:
    """New business keys with their hash; NULL keys are not loaded, repeats load once."""
    rows = inbound.select(key).where(F.col(key).isNotNull()).distinct().select(key_hash(key).alias(hk), key)
    if existing is not None:
        rows = rows.join(existing.select(hk), hk, "left_anti")
    return _lineage(rows, load_ts, source)


def load_link(inbound: DataFrame, existing: DataFrame | None, parts: list[str], hk: str, parents: dict[str, str], load_ts: datetime, source: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """New relationships: one row per distinct parts, hashed in their order, with parent hashes.

    ``parents`` maps a parent's hash column to the part it hashes. A NULL in a part that is not
    ``nullable`` makes the link's hash NULL; such rows are kept for the not-null checks to report.
    """
    rows = inbound.select(*parts).distinct()
    at = tuple(i for i, p in enumerate(parts) if p in nullable)
    rows = rows.select(key_hash(*parts, nullable=at).alias(hk), *[key_hash(p).alias(h) for h, p in parents.items()], *parts)
    if existing is not None:
        rows = rows.join(existing.select(hk), hk, "left_anti")
    return _lineage(rows, load_ts, source)


def latest_rows(df: DataFrame, keys: list[str], order: str = "load_datetime") -> DataFrame:
    """The last row of each key (ties: the greatest row), by one hash aggregation."""
    others = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


def load_satellite(inbound: DataFrame, existing: DataFrame | None, parent: str, payload: list[str], hk: str, load_ts: datetime, source: str, child_key: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose payload differs from the latest known one of their parent (and child key).

    Only the latest version counts, so a value that returns is loaded again. Two payloads of one
    parent in one batch are both loaded; ``payload_conflicts`` reports them.
    """
    rows = inbound.select(parent, *([child_key] if child_key else []), *keep, *payload).distinct()
    rows = rows.withColumn("hashdiff", hashdiff(*payload))
    keys = [parent, *([child_key] if child_key else [])]
    if existing is not None:
        known = latest_rows(existing.select(*keys, "load_datetime", "hashdiff"), keys)
        rows = rows.join(known.select(*keys, "hashdiff"), [*keys, "hashdiff"], "left_anti")
    rows = _lineage(rows, load_ts, source)
    parts = [*keys, ts_text("load_datetime")]
    return rows.select(key_hash(*parts).alias(hk), "*")


def payload_conflicts(inbound: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys that come with more than one payload in a batch."""
    return inbound.select(*keys, hashdiff(*payload).alias("h")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("payloads")).where("payloads > 1")


def collapse(df: DataFrame, grain: list[str], rule: str, rank: str, value: str) -> DataFrame:
    """One row per grain: by rank where the rule says so, else by greatest value then best rank.

    The rule is constant within a grain. Ties beyond rank are settled by the whole row.
    """
    by_rank = F.col(rule) == "preference_rank_asc"
    order = [F.when(by_rank, F.col(rank)).asc_nulls_last(), F.when(~by_rank, F.col(value)).desc_nulls_last(), F.col(rank).asc_nulls_last()]
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in {*grain, rule, rank, value}]
    w = Window.partitionBy(*grain).orderBy(*order, F.col(value).desc_nulls_last(), *rest)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def asof_expand(df: DataFrame, dates: list[str], visible: str, name: str = "as_of_date") -> DataFrame:
    """Each row once per as-of date on which it was visible (``visible`` <= date).

    A generator over the literal dates; no join, no shuffle. NULL ``visible`` gives no row.
    """
    spine = F.array(*[F.lit(d).cast("date") for d in sorted(dates)])
    return df.withColumn(name, F.explode(F.filter(spine, lambda d: d >= F.col(visible))))
