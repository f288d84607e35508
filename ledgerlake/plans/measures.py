"""KPI measures (inventory group b) over one row per company and year at its latest snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.operators.marts import RATIOS
from ledgerlake.operators.vault import latest_rows
from ledgerlake.plans.warehouse import CHAIN_SQL, Build
from ledgerlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

COMPLETE = 0.2
SQL = rf"""WITH base AS (SELECT * EXCLUDE (rn) FROM (SELECT cik, fiscal_year, as_of_date, entity_name, CAST(revenue AS DOUBLE) AS revenue, CAST(net_income AS DOUBLE) AS net_income, CAST(assets AS DOUBLE) AS assets, CAST(stockholders_equity AS DOUBLE) AS stockholders_equity, gross_margin, operating_margin, net_margin, return_on_assets, return_on_equity, debt_to_equity, operating_cf_margin, cash_to_assets,
    row_number() OVER (PARTITION BY cik, fiscal_year ORDER BY as_of_date DESC, load_datetime DESC, mart_financial_health_hk DESC) AS rn FROM mart_financial_health) WHERE rn = 1),
latest AS (SELECT max(fiscal_year) AS fy FROM (SELECT fiscal_year, count(DISTINCT cik) AS n FROM base WHERE revenue IS NOT NULL GROUP BY 1) WHERE n >= {COMPLETE} * (SELECT count(DISTINCT cik) FROM base)),
sector AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, min(trim(gics_sector)) AS sector FROM sp100_company_sector WHERE regexp_extract(cik, '(\d+)', 1) <> '' GROUP BY 1),
s AS (SELECT base.*, coalesce(sector.sector, 'UNCATEGORIZED') AS sector FROM base LEFT JOIN sector ON base.cik = sector.cik) """


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = SQL + sql
        return f

    return add


def base(spark: SparkSession, d: str) -> DataFrame:
    """One row per company and year: measures never add up snapshots."""
    m = table(spark, d, "mart_financial_health")
    m = m.where("cik IS NOT NULL AND fiscal_year IS NOT NULL").withColumn("order_", F.struct("as_of_date", "load_datetime", "mart_financial_health_hk"))
    picked = [F.col(c).cast("double").alias(c) for c in ("revenue", "net_income", "assets", "stockholders_equity")]
    rows = latest_rows(m.select("cik", "fiscal_year", "order_", "entity_name", *picked, *RATIOS), ["cik", "fiscal_year"], "order_")
    return rows.withColumn("as_of_date", F.col("order_.as_of_date")).drop("order_")


def latest(b: DataFrame) -> DataFrame:
    """One row: the last year with revenue of enough of all companies; the grand total comes with the years."""
    years = b.rollup("fiscal_year").agg(F.count_distinct("cik").alias("all_"), F.count_distinct(F.when(F.col("revenue").isNotNull(), F.col("cik"))).alias("n_"), F.grouping_id().alias("total_"))
    whole = F.max(F.when(F.col("total_") == 1, F.col("all_"))).over(Window.partitionBy(F.lit(1)))  # one row a year
    return years.withColumn("whole_", whole).where((F.col("total_") == 0) & (F.col("n_") > 0) & (F.col("n_") >= F.col("whole_") * COMPLETE)).agg(F.max("fiscal_year").alias("latest_complete_fy"))


def with_sector(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sp100_company_sector").where(X.ten_digits("cik").isNotNull()).groupBy(X.ten_digits("cik").alias("cik")).agg(F.min(F.trim("gics_sector")).alias("sector"))
    return base(spark, d).join(s, "cik", "left").withColumn("sector", F.coalesce("sector", F.lit("UNCATEGORIZED")))


def at_latest(b: DataFrame) -> DataFrame:
    return b.join(F.broadcast(latest(b)), F.col("fiscal_year") == F.col("latest_complete_fy"))  # one row


def total(c: str) -> F.Column:
    return F.sum(F.col(c).cast("decimal(28,2)")).cast("double")


def total_sql(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,2))) AS DOUBLE)"


@query("b1_latest_totals", f"SELECT fy AS fiscal_year, {total_sql('revenue')} AS revenue, {total_sql('net_income')} AS net_income FROM base, latest WHERE fiscal_year = fy GROUP BY 1")
def _(spark, d):
    return at_latest(base(spark, d)).groupBy("fiscal_year").agg(total("revenue").alias("revenue"), total("net_income").alias("net_income"))


@query("b2_net_margin_latest", f"SELECT round({total_sql('net_income')} / nullif({total_sql('revenue')}, 0), 6) AS net_margin FROM base, latest WHERE fiscal_year = fy")
def _(spark, d):
    return at_latest(base(spark, d)).agg(F.round(F.try_divide(total("net_income"), total("revenue")), 6).alias("net_margin"))


@query("b3_revenue_yoy", f"SELECT round(({total_sql('CASE WHEN fiscal_year = fy THEN revenue END')} - {total_sql('CASE WHEN fiscal_year = fy - 1 THEN revenue END')}) / nullif({total_sql('CASE WHEN fiscal_year = fy - 1 THEN revenue END')}, 0), 6) AS revenue_yoy FROM base, latest")
def _(spark, d):
    b = base(spark, d)
    rows = b.crossJoin(F.broadcast(latest(b)))  # one row
    now, before = (F.sum(F.when(F.col("fiscal_year") == F.col("latest_complete_fy") - k, F.col("revenue")).cast("decimal(28,2)")).cast("double") for k in (0, 1))
    return rows.agg(F.round(F.try_divide(now - before, before), 6).alias("revenue_yoy"))


@query("b4_sector_revenue", f"SELECT sector, {total_sql('revenue')} AS revenue FROM s, latest WHERE fiscal_year = fy GROUP BY 1")
def _(spark, d):
    return at_latest(with_sector(spark, d)).groupBy("sector").agg(total("revenue").alias("revenue"))


@query("b5_revenue_yoy_rank")
def _(spark, d):
    """Rank and percentage of the growth of revenue, from the built trend mart at its latest date and complete year."""
    t = Build(spark, d).pl_trend
    last = t.agg(F.max("as_of_date").alias("as_of_date"))  # one row
    rows = t.where("canonical_concept = 'revenue' AND is_latest_complete_fy").join(F.broadcast(last), "as_of_date")
    return rows.groupBy("cik").agg(F.max("yoy_rank").alias("revenue_yoy_rank"), F.round(F.avg("yoy_pct"), 6).alias("revenue_yoy_pct"))


ORACLE_SQL["b5_revenue_yoy_rank"] = CHAIN_SQL + """SELECT cik, CAST(max(yoy_rank) AS INTEGER) AS revenue_yoy_rank, round(avg(yoy_pct), 6) AS revenue_yoy_pct FROM pl_trend
    WHERE canonical_concept = 'revenue' AND is_latest_complete_fy AND as_of_date = (SELECT max(as_of_date) FROM pl_trend) GROUP BY 1"""  # the chain instead of the base of the others


@query("b5_revenue_rank", "SELECT cik, CAST(rank() OVER (ORDER BY revenue DESC) AS INTEGER) AS revenue_rank FROM base, latest WHERE fiscal_year = fy AND revenue IS NOT NULL")
def _(spark, d):
    """Rank over the whole universe, without one global window: ranks of distinct values come from
    counts of the rows above, summed over range partitions."""
    rows = at_latest(base(spark, d)).where("revenue IS NOT NULL").select("cik", "revenue")
    values = rows.groupBy("revenue").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(F.desc("revenue")).sortWithinPartitions(F.desc("revenue")).withColumn("pid", F.spark_partition_id())
    from ledgerlake.session import cut

    values = cut(values)
    parts = values.groupBy("pid").agg(F.sum("n").alias("m"))
    before = parts.select("pid", F.coalesce(F.sum("m").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("pid").orderBy(F.desc("revenue")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = values.withColumn("inside", inside).join(F.broadcast(before), "pid").select("revenue", (F.col("before") + F.col("inside") + 1).cast("int").alias("revenue_rank"))
    return rows.join(ranks, "revenue").select("cik", "revenue_rank")


@query("b6_kpi_latest", f"SELECT k.kpi, CASE k.kpi WHEN 'Revenue' THEN '$' || CAST(round({total_sql('revenue')} / 1e6) AS BIGINT) || 'M' WHEN 'Net Income' THEN '$' || CAST(round({total_sql('net_income')} / 1e6) AS BIGINT) || 'M' ELSE CAST(count(DISTINCT cik) AS VARCHAR) END AS label FROM base, latest, (VALUES ('Revenue'), ('Net Income'), ('Companies')) AS k(kpi) WHERE fiscal_year = fy GROUP BY 1")
def _(spark, d):
    one = at_latest(base(spark, d)).agg(total("revenue").alias("r"), total("net_income").alias("i"), F.count_distinct("cik").alias("c"))
    kpi = spark.createDataFrame([("Revenue",), ("Net Income",), ("Companies",)], "kpi string")

    def millions(c: str) -> F.Column:
        return F.concat(F.lit("$"), F.round(F.col(c) / 1e6).cast("bigint").cast("string"), F.lit("M"))

    return kpi.crossJoin(F.broadcast(one)).select("kpi", F.when(F.col("kpi") == "Revenue", millions("r")).when(F.col("kpi") == "Net Income", millions("i")).otherwise(F.col("c").cast("string")).alias("label"))  # one row


#: The four key figures with their order on the page.
KPIS = [("Total revenue", 1), ("Total net income", 2), ("Net margin", 3), ("Revenue YoY %", 4)]
_KPI_SQL = "(VALUES " + ", ".join(f"('{k}', {n})" for k, n in KPIS) + ") AS k(kpi, sort)"


def _kpis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KPIS, "kpi string, sort int")


@query("b6_fiscal_years", "SELECT DISTINCT fiscal_year FROM base")
def _(spark, d):
    return base(spark, d).select("fiscal_year").distinct()


@query("b6_kpi_bridge", f"SELECT kpi, sort, fiscal_year FROM {_KPI_SQL}, (SELECT DISTINCT fiscal_year FROM base)")
def _(spark, d):
    years = base(spark, d).select("fiscal_year").distinct()
    return years.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.lit(n).alias("sort")) for k, n in KPIS])).alias("k"), "fiscal_year").select("k.kpi", "k.sort", "fiscal_year")


_SPARK_SQL = f"WITH_YEARS AS (SELECT *, CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 THEN (revenue - lag(revenue) OVER w) / nullif(abs(lag(revenue) OVER w), 0) END AS yoy FROM (SELECT fiscal_year, {total_sql('revenue')} AS revenue, {total_sql('net_income')} AS net_income FROM base GROUP BY 1) WINDOW w AS (ORDER BY fiscal_year))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    """The value of each key figure in each year (growth of the total against the year before)."""
    y = base(spark, d).groupBy("fiscal_year").agg(total("revenue").alias("r"), total("net_income").alias("i"))
    w = Window.partitionBy(F.lit(1)).orderBy("fiscal_year")  # one row a year
    before = F.lag("r").over(w)
    yoy = F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.try_divide(F.col("r") - before, F.abs(before)))
    values = dict(zip((k for k, _ in KPIS), (F.col("r"), F.col("i"), F.round(F.try_divide("i", "r"), 6), F.round(yoy, 6)), strict=True))
    return y.select("fiscal_year", *[v.alias(k) for k, v in values.items()]).unpivot(["fiscal_year"], list(values), "kpi", "value")


@query("b6_kpi_sparkline", f", {_SPARK_SQL} SELECT kpi, fiscal_year, CASE sort WHEN 1 THEN revenue WHEN 2 THEN net_income WHEN 3 THEN round(net_income / nullif(revenue, 0), 6) ELSE round(yoy, 6) END AS value FROM {_KPI_SQL}, WITH_YEARS")
def _(spark, d):
    return _points(spark, d).select("kpi", "fiscal_year", "value")


@query("b6_kpi_texts", f", {_SPARK_SQL} SELECT kpi, sort, CASE sort WHEN 1 THEN printf('$%.1fB', revenue / 1e9) WHEN 2 THEN printf('$%.1fB', net_income / 1e9) WHEN 3 THEN printf('%.1f%%', 100 * round(net_income / nullif(revenue, 0), 6)) ELSE printf('%.1f%%', 100 * round(yoy, 6)) END AS label FROM {_KPI_SQL}, WITH_YEARS, latest WHERE fiscal_year = fy")
def _(spark, d):
    p = _points(spark, d).join(F.broadcast(latest(base(spark, d))), F.col("fiscal_year") == F.col("latest_complete_fy"))  # one row
    label = F.when(F.col("sort") <= 2, F.format_string("$%.1fB", F.col("value") / 1e9)).otherwise(F.format_string("%.1f%%", 100 * F.col("value")))
    return p.join(F.broadcast(_kpis(spark)), "kpi").select("kpi", "sort", label.alias("label"))  # four rows


@query("b7_all_years", f"SELECT fiscal_year, {total_sql('revenue')} AS revenue, {total_sql('net_income')} AS net_income FROM base GROUP BY 1")
def _(spark, d):
    return base(spark, d).groupBy("fiscal_year").agg(total("revenue").alias("revenue"), total("net_income").alias("net_income"))


_YEARS_SQL = f"SELECT fiscal_year, {total_sql('revenue')} AS revenue, {total_sql('net_income')} AS net_income FROM base GROUP BY 1"


@query("b8_best_worst_year", f"SELECT arg_max(fiscal_year, revenue) AS best_year, arg_min(fiscal_year, yoy) AS worst_year, round(avg(net_income / nullif(revenue, 0)), 6) AS avg_net_margin FROM (SELECT *, CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 THEN (revenue - lag(revenue) OVER w) / nullif(abs(lag(revenue) OVER w), 0) END AS yoy FROM ({_YEARS_SQL}) WINDOW w AS (ORDER BY fiscal_year))")
def _(spark, d):
    """Best year by revenue, worst year by its growth against the year before."""
    y = base(spark, d).groupBy("fiscal_year").agg(total("revenue").alias("r"), total("net_income").alias("i"))
    w = Window.partitionBy(F.lit(1)).orderBy("fiscal_year")  # one row a year
    before = F.lag("r").over(w)
    y = y.withColumn("yoy", F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.try_divide(F.col("r") - before, F.abs(before))))
    return y.agg(F.max_by("fiscal_year", "r").alias("best_year"), F.min_by("fiscal_year", "yoy").alias("worst_year"), F.round(F.avg(F.try_divide("i", "r")), 6).alias("avg_net_margin"))


@query("b9_ratio_delta", "SELECT sector, round(avg(debt_to_equity), 4) AS sector_value, round((SELECT avg(debt_to_equity) FROM base, latest WHERE fiscal_year = fy), 4) AS universe_value, CASE WHEN avg(debt_to_equity) < (SELECT avg(debt_to_equity) FROM base, latest WHERE fiscal_year = fy) THEN 'BETTER' ELSE 'WORSE' END AS direction FROM s, latest WHERE fiscal_year = fy GROUP BY 1 HAVING avg(debt_to_equity) IS NOT NULL")
def _(spark, d):
    rows = at_latest(with_sector(spark, d))
    whole = rows.agg(F.avg("debt_to_equity").alias("u"))
    sector = rows.groupBy("sector").agg(F.avg("debt_to_equity").alias("v")).where("v IS NOT NULL")
    less_is_better = F.when(F.col("v") < F.col("u"), "BETTER").otherwise("WORSE")
    return sector.crossJoin(F.broadcast(whole)).select("sector", F.round("v", 4).alias("sector_value"), F.round("u", 4).alias("universe_value"), less_is_better.alias("direction"))  # one row


_EXACT = "CAST(sum(CAST({v} AS DECIMAL(28,8))) AS DOUBLE) / count({v})"
_SCOPED = "SELECT sector, u.n AS ratio_name, u.v AS v FROM s, latest, unnest([" + ", ".join(f"{{'n': '{r}', 'v': {r}}}" for r in RATIOS) + "]) AS t(u) WHERE fiscal_year = fy AND isfinite(u.v) AND abs(u.v) < 1e15"


@query(
    "b9_ratio_deltas",
    f"""SELECT a.sector, a.ratio_name, round(a.v, 4) AS sector_value, round(b.v, 4) AS universe_value, round(a.v - b.v, 4) AS delta,
    CASE WHEN a.v = b.v THEN 'EQUAL' WHEN (a.v > b.v) = (a.ratio_name <> 'debt_to_equity') THEN 'BETTER' ELSE 'WORSE' END AS direction
    FROM (SELECT sector, ratio_name, {_EXACT.format(v='v')} AS v FROM ({_SCOPED}) GROUP BY 1, 2) a JOIN (SELECT ratio_name, {_EXACT.format(v='v')} AS v FROM ({_SCOPED}) GROUP BY 1) b ON a.ratio_name = b.ratio_name""",
)
def _(spark, d):
    """All eight ratios: a sector's mean beside the universe's; of debt_to_equity less is better."""
    rows = at_latest(with_sector(spark, d)).unpivot(["sector"], list(RATIOS), "ratio_name", "v").where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e15")
    mean = F.sum(F.col("v").cast("decimal(28,8)")).cast("double") / F.count("v")  # exact sums
    both = rows.groupBy("sector", "ratio_name").agg(mean.alias("a")).join(F.broadcast(rows.groupBy("ratio_name").agg(mean.alias("b"))), "ratio_name")  # eight rows
    better = (F.col("a") > F.col("b")) == (F.col("ratio_name") != "debt_to_equity")
    return both.select("sector", "ratio_name", F.round("a", 4).alias("sector_value"), F.round("b", 4).alias("universe_value"), F.round(F.col("a") - F.col("b"), 4).alias("delta"), F.when(F.col("a") == F.col("b"), "EQUAL").when(better, "BETTER").otherwise("WORSE").alias("direction"))


@query("b10_sector_ratio_of_sums", f"SELECT sector, round({total_sql('net_income')} / nullif({total_sql('stockholders_equity')}, 0), 6) AS roe, round({total_sql('net_income')} / nullif({total_sql('assets')}, 0), 6) AS roa, round({total_sql('net_income')} / nullif({total_sql('revenue')}, 0), 6) AS net_margin FROM s, latest WHERE fiscal_year = fy GROUP BY 1")
def _(spark, d):
    ratio = lambda b: F.round(F.try_divide(total("net_income"), total(b)), 6)
    return at_latest(with_sector(spark, d)).groupBy("sector").agg(ratio("stockholders_equity").alias("roe"), ratio("assets").alias("roa"), ratio("revenue").alias("net_margin"))


_RATIO_LIST = ", ".join(f"{{'n': '{r}', 'v': {r}}}" for r in RATIOS)


@query("b11_ratio_rows", f"SELECT cik, fiscal_year, u.n AS ratio_name, u.v AS ratio_value FROM base, unnest([{_RATIO_LIST}]) AS t(u) WHERE isfinite(u.v)")
def _(spark, d):
    rows = base(spark, d).unpivot(["cik", "fiscal_year"], list(RATIOS), "ratio_name", "ratio_value")
    return rows.where("ratio_value IS NOT NULL AND NOT isnan(ratio_value) AND abs(ratio_value) < double('inf')")


@query("b12_company_latest", "SELECT cik, fiscal_year, revenue, assets FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fiscal_year DESC) AS rn FROM base) WHERE rn = 1")
def _(spark, d):
    return latest_rows(base(spark, d).select("cik", "fiscal_year", "revenue", "assets"), ["cik"], "fiscal_year")


@query("b13_cohort_lines")
def _(spark, d):
    """Forecast lines of the companies whose history ends in the cohort year, pinched at its actual."""
    from ledgerlake.plans.warehouse import Build

    b = Build(spark, d)
    f = b.forecasts
    cohort = f.agg(F.max("latest_historical_year").alias("cohort"))
    lines = f.join(F.broadcast(cohort), F.col("latest_historical_year") == F.col("cohort"))  # one row
    ahead = lines.select("cik", "cohort", F.col("forecast_year").alias("fiscal_year"), "forecast_value", "lower_ci_95", "upper_ci_95")
    past = b.pl_trend.where("canonical_concept = 'revenue'").select("cik", "fiscal_year", "as_of_date", F.col("value_numeric").cast("double").alias("v"))
    anchor = lines.select("cik", "cohort", "as_of_date").distinct().join(past, ["cik", "as_of_date"]).where("fiscal_year = cohort").select("cik", "cohort", "fiscal_year", F.col("v").alias("forecast_value"), F.col("v").alias("lower_ci_95"), F.col("v").alias("upper_ci_95"))
    return ahead.unionByName(anchor)


@query("b14_cagr", "SELECT a.cik, round(power(z.revenue / a.revenue, 1.0 / (z.fiscal_year - a.fiscal_year)) - 1, 6) AS cagr FROM (SELECT cik, min(fiscal_year) AS f, max(fiscal_year) AS l FROM base WHERE revenue > 0 GROUP BY 1 HAVING min(fiscal_year) < max(fiscal_year)) m JOIN base a ON a.cik = m.cik AND a.fiscal_year = m.f JOIN base z ON z.cik = m.cik AND z.fiscal_year = m.l")
def _(spark, d):
    g = base(spark, d).where("revenue > 0").groupBy("cik").agg(F.min(F.struct("fiscal_year", "revenue")).alias("a"), F.max(F.struct("fiscal_year", "revenue")).alias("z")).where("a.fiscal_year < z.fiscal_year")
    growth = F.pow(F.col("z.revenue") / F.col("a.revenue"), F.lit(1.0) / (F.col("z.fiscal_year") - F.col("a.fiscal_year"))) - 1
    return g.select("cik", F.round(growth, 6).alias("cagr"))


@query("b15_top_movers", "SELECT cik, round(g, 6) AS growth FROM (SELECT n.cik, (n.revenue - o.revenue) / abs(o.revenue) AS g FROM base n JOIN base o ON n.cik = o.cik AND n.fiscal_year = o.fiscal_year + 1 JOIN latest ON n.fiscal_year = fy WHERE n.revenue IS NOT NULL AND o.revenue <> 0) ORDER BY g DESC, cik LIMIT 5")
def _(spark, d):
    b = base(spark, d)
    last = F.broadcast(latest(b))  # one row
    now = b.join(last, F.col("fiscal_year") == F.col("latest_complete_fy")).select("cik", F.col("revenue").alias("n"))
    old = b.join(last, F.col("fiscal_year") == F.col("latest_complete_fy") - 1).where("revenue <> 0").select("cik", F.col("revenue").alias("o"))
    g = now.where("n IS NOT NULL").join(old, "cik").withColumn("g", (F.col("n") - F.col("o")) / F.abs("o"))
    return g.orderBy(F.desc("g"), "cik").limit(5).select("cik", F.round("g", 6).alias("growth"))


@query("b15_top_decliners", "SELECT cik, round(g, 6) AS growth FROM (SELECT n.cik, (n.revenue - o.revenue) / abs(o.revenue) AS g FROM base n JOIN base o ON n.cik = o.cik AND n.fiscal_year = o.fiscal_year + 1 JOIN latest ON n.fiscal_year = fy WHERE n.revenue IS NOT NULL AND o.revenue <> 0) ORDER BY g, cik LIMIT 5")
def _(spark, d):
    b = base(spark, d)
    last = F.broadcast(latest(b))  # one row
    now = b.join(last, F.col("fiscal_year") == F.col("latest_complete_fy")).select("cik", F.col("revenue").alias("n"))
    old = b.join(last, F.col("fiscal_year") == F.col("latest_complete_fy") - 1).where("revenue <> 0").select("cik", F.col("revenue").alias("o"))
    g = now.where("n IS NOT NULL").join(old, "cik").withColumn("g", (F.col("n") - F.col("o")) / F.abs("o"))
    return g.orderBy("g", "cik").limit(5).select("cik", F.round("g", 6).alias("growth"))


def forecast_growth(forecasts: DataFrame, past: DataFrame) -> DataFrame:
    """Yearly growth a forecast implies from the last actual to its last year, and the half-width of its 95 % band by its value.

    ``forecasts``: cik, forecast_year, forecast_value, bounds, latest_historical_year; ``past``: cik,
    fiscal_year, v. Growth is NULL where either end is not positive, the width where the value is 0.
    """
    last = forecasts.groupBy("cik").agg(F.max(F.struct("forecast_year", "forecast_value", "lower_ci_95", "upper_ci_95", "latest_historical_year")).alias("f")).select("cik", "f.*")
    both = last.join(past, (last.cik == past.cik) & (last.latest_historical_year == past.fiscal_year)).select(last.cik, "forecast_year", "forecast_value", "lower_ci_95", "upper_ci_95", "latest_historical_year", "v")
    years = F.col("forecast_year") - F.col("latest_historical_year")
    growth = F.when((F.col("v") > 0) & (F.col("forecast_value") > 0), F.pow(F.col("forecast_value") / F.col("v"), F.lit(1.0) / years) - 1)
    return both.select("cik", "latest_historical_year", "forecast_year", growth.alias("forecast_cagr"), F.try_divide((F.col("upper_ci_95") - F.col("lower_ci_95")) / 2, F.abs("forecast_value")).alias("half_width"))


@query("b14_forecast_cagr")
def _(spark, d):
    b = Build(spark, d)
    revenue = b.pl_trend.where("canonical_concept = 'revenue'").select("cik", "as_of_date", "fiscal_year", F.col("value_numeric").cast("double").alias("v"))
    last = revenue.agg(F.max("as_of_date").alias("as_of_date"))
    return forecast_growth(b.forecasts, revenue.join(F.broadcast(last), "as_of_date").drop("as_of_date"))  # one row
