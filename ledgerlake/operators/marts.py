"""Analytic building blocks: year panels, growth with a contiguity guard, peers, pivots, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Concepts measured at a point in time; their facts have no period start.
POINT_IN_TIME = ("assets", "liabilities", "liabilities_and_se", "stockholders_equity", "stockholders_equity_including_nci", "minority_interest", "cash_and_equivalents")

#: The eight ratios: name -> (numerator, denominator).
RATIOS = {
    "gross_margin": ("gross_profit", "revenue"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "return_on_assets": ("net_income", "assets"),
    "return_on_equity": ("net_income", "stockholders_equity"),
    "debt_to_equity": ("liabilities", "stockholders_equity"),
    "operating_cf_margin": ("operating_cash_flow", "revenue"),
    "cash_to_assets": ("cash_and_equivalents", "assets"),
}


def annual_span(start: str = "period_start_date", end: str = "period_end_date", low: int = 350, high: int = 380) -> Column:
    """Whether a period is about a year long; an unknown start is not."""
    return F.coalesce(F.datediff(F.col(end), F.col(start)).between(low, high), F.lit(False))


def latest_filed(df: DataFrame, grain: list[str], order: list[str]) -> DataFrame:
    """One row per grain: the greatest by ``order`` (NULLs last), ties by the whole row."""
    rest = [c for c in df.columns if c not in {*grain, *order}]
    best = df.groupBy(*grain).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(*grain, "b.*").select(*df.columns)


def guarded_growth(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """``yoy_pct`` against the year before; NULL after a gap, for a first year or a zero base."""
    w = Window.partitionBy(*keys).orderBy(year)
    v, before = F.col(value).cast("double"), F.lag(F.col(value).cast("double")).over(w)
    next_to = F.lag(year).over(w) == F.col(year) - 1
    return df.withColumn("yoy_pct", F.when(next_to, (v - before) / F.nullif(F.abs(before), F.lit(0.0))))


def latest_complete_year(df: DataFrame, entity: str, year: str, least: Column, snapshot: str | None = None) -> DataFrame:
    """One row: the last year with at least ``least`` entities, at the latest snapshot only."""
    rows = df
    if snapshot:
        last = df.agg(F.max(snapshot).alias("last_"))
        rows = df.join(F.broadcast(last), F.col(snapshot) == F.col("last_")).drop("last_")
    n = rows.groupBy(year).agg(F.count_distinct(entity).alias("n"))
    return n.where(F.col("n") >= least).agg(F.max(year).alias("latest_complete_fy"))


def peer_statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Size, mean, median, deviation, range, rank and percentile within peers.

    The statistics and the ranks share one partitioning, so one exchange serves all; the medians
    are aggregated and joined back on it.
    """
    v = F.col(value)
    whole, falling, rising = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(v.desc()), Window.partitionBy(*group).orderBy(v.asc())
    x = v.cast("double")
    ranked = df.withColumns({
        "peer_count": F.count(F.lit(1)).over(whole),
        "peer_mean": F.avg(x).over(whole),
        "peer_stddev": F.stddev_samp(x).over(whole),
        "peer_min": F.min(v).over(whole),
        "peer_max": F.max(v).over(whole),
        "peer_rank": F.rank().over(falling).cast("int"),
        "peer_percentile": F.cume_dist().over(rising),
    })
    medians = df.groupBy(*group).agg(F.percentile_approx(v, 0.5, 10_000).alias("peer_median"))
    return ranked.join(medians, group)


def pivot_values(df: DataFrame, grain: list[str], name: str, value: str, wanted: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One column per wanted name: the greatest value of the grain."""
    return df.groupBy(*grain).agg(*[c.alias(n) for n, c in (extra or {}).items()], *[F.max(F.when(F.col(name) == w, F.col(value))).alias(w) for w in wanted])


def derive_missing(df: DataFrame) -> DataFrame:
    """Gross profit, equity and liabilities from their parts where they are not reported."""
    equity = F.coalesce("stockholders_equity", F.col("stockholders_equity_including_nci") - F.col("minority_interest"))
    return df.withColumns({
        "gross_profit": F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue")),
        "liabilities": F.coalesce("liabilities", F.col("liabilities_and_se") - equity),
        "stockholders_equity": equity,
    })


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0)) for n, (a, b) in RATIOS.items()})
