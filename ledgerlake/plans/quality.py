"""Quality queries: structural reports and semantic audits (inventory group q)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.functions.hashing import hashdiff, key_hash, ts_text
from ledgerlake.operators.nested import flatten_documents
from ledgerlake.operators.quality import TableChecks, completeness, divergence, drift
from ledgerlake.plans.problems import P4_TAGS_SQL
from ledgerlake.plans.warehouse import AS_OF_DATES, CHAIN_SQL, LINK_PARTS, Build
from ledgerlake.session import cut, spread
from ledgerlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def report_sql(*checks: tuple[str, str, str], before: str = "") -> str:
    """SQL of report rows: (name, expected, actual) as scalar expressions."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST(({e}) AS VARCHAR) AS expected, CAST(({a}) AS VARCHAR) AS actual" for n, e, a in checks)
    return f"{before} SELECT *, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS result FROM ({rows})"


def bad(source: str, condition: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {condition}"


def repeated(source: str, *columns: str) -> str:
    c = ", ".join(columns)
    return f"SELECT count(*) FROM (SELECT 1 FROM {source} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in columns)} GROUP BY {c} HAVING count(*) > 1)"


def lost(source: str, column: str, parent: str, parent_column: str) -> str:
    return f"SELECT count(DISTINCT {column}) FROM {source} WHERE {column} NOT IN (SELECT {parent_column} FROM {parent} WHERE {parent_column} IS NOT NULL)"


# --- Q1, Q3: structural reports of the delivered tables


@query(
    "q3_verify_hub_company",
    report_sql(
        ("02_hk_unique", "0", repeated("hub_company", "hub_company_hk")),
        ("03_hk_not_null", "0", bad("hub_company", "hub_company_hk IS NULL")),
        ("04_hk_length_64", "0", bad("hub_company", "length(hub_company_hk) <> 64")),
        ("05_cik_unique", "0", repeated("hub_company", "cik")),
        ("07_hash_reproducible", "0", bad("hub_company", "hub_company_hk IS DISTINCT FROM upper(sha256(cik))")),
        ("08_load_datetime_valid", "0", bad("hub_company", "load_datetime IS NULL OR load_datetime > TIMESTAMPTZ '2026-12-31 00:00:00+00'")),
        ("09_record_source_constant", "0", bad("hub_company", "record_source IS NOT NULL AND record_source NOT IN ('sec_edgar.companyfacts')")),
    ),
)
def _(spark, d):
    h = table(spark, d, "hub_company")
    late = F.col("load_datetime").isNull() | (F.col("load_datetime") > F.lit("2026-12-31").cast("timestamp"))
    return (
        TableChecks(h).not_null("03_hk_not_null", "hub_company_hk").length("04_hk_length_64", "hub_company_hk", 64).reproducible("07_hash_reproducible", "hub_company_hk", key_hash("cik"))
        .none("08_load_datetime_valid", late).accepted("09_record_source_constant", "record_source", ["sec_edgar.companyfacts"]).unique("02_hk_unique", "hub_company_hk").unique("05_cik_unique", "cik").report()
    )


@query(
    "q3_verify_link_company_filing",
    report_sql(
        ("06_link_hk_unique", "0", repeated("link_company_filing", "link_company_filing_hk")),
        ("07_link_hk_not_null", "0", bad("link_company_filing", "link_company_filing_hk IS NULL")),
        ("08_link_hk_length_64", "0", bad("link_company_filing", "length(link_company_filing_hk) <> 64")),
        ("09_link_composite_hash_reproducible", "0", bad("link_company_filing", "link_company_filing_hk IS DISTINCT FROM upper(sha256(cik || '||' || accession_number))")),
        ("10_link_fk_closure_company", "0", lost("link_company_filing", "hub_company_hk", "hub_company", "hub_company_hk")),
        ("11_link_fk_closure_filing", "0", lost("link_company_filing", "hub_filing_hk", "hub_filing", "hub_filing_hk")),
    ),
)
def _(spark, d):
    link = table(spark, d, "link_company_filing")
    return (
        TableChecks(link).not_null("07_link_hk_not_null", "link_company_filing_hk").length("08_link_hk_length_64", "link_company_filing_hk", 64)
        .reproducible("09_link_composite_hash_reproducible", "link_company_filing_hk", key_hash("cik", "accession_number")).unique("06_link_hk_unique", "link_company_filing_hk")
        .relationship("10_link_fk_closure_company", "hub_company_hk", table(spark, d, "hub_company"), "hub_company_hk").relationship("11_link_fk_closure_filing", "hub_filing_hk", table(spark, d, "hub_filing"), "hub_filing_hk").report()
    )


_SATS = {"sat_filing_metadata": ("hub_filing_hk", "hub_filing"), "sat_company_metadata": ("hub_company_hk", "hub_company"), "sat_concept_value": ("link_filing_concept_period_hk", None)}


def _sat_checks(name: str, parent: str, hub: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = table(spark, d, name)
        c = TableChecks(s).not_null("02_sat_hk_not_null", f"{name}_hk").length("03_sat_hk_length_64", f"{name}_hk", 64).not_null("04_hashdiff_not_null", "hashdiff").length("05_hashdiff_length_64", "hashdiff", 64)
        c = c.unique("01_sat_hk_unique", f"{name}_hk").unique("07_sat_composite_pk_unique", parent, "load_datetime")
        if hub:
            c = c.relationship("06_sat_fk_closure", parent, table(spark, d, hub), parent).same_count("08_sat_parent_coverage_parity", table(spark, d, hub).select(parent), s.select(parent))
        return c.report()

    return run


for _name, (_parent, _hub) in _SATS.items():
    _checks = [("02_sat_hk_not_null", "0", bad(_name, f"{_name}_hk IS NULL")), ("03_sat_hk_length_64", "0", bad(_name, f"length({_name}_hk) <> 64")), ("04_hashdiff_not_null", "0", bad(_name, "hashdiff IS NULL")), ("05_hashdiff_length_64", "0", bad(_name, "length(hashdiff) <> 64")),
               ("01_sat_hk_unique", "0", repeated(_name, f"{_name}_hk")), ("07_sat_composite_pk_unique", "0", repeated(_name, _parent, "load_datetime"))]
    if _hub:
        _checks += [("06_sat_fk_closure", "0", lost(_name, _parent, _hub, _parent)), ("08_sat_parent_coverage_parity", f"SELECT count(DISTINCT {_parent}) FROM {_hub}", f"SELECT count(DISTINCT {_parent}) FROM {_name}")]
    query(f"q3_verify_{_name}", report_sql(*_checks))(_sat_checks(_name, _parent, _hub))


#: Payload of each satellite's hashdiff.
_PAYLOAD = {"sat_filing_metadata": ("form_type", "filed_date"), "sat_company_metadata": ("entity_name",), "sat_concept_value": ("value", "unit")}
_SOURCE = "sec_edgar.companyfacts"


def _hash_checks(df: DataFrame, hk: str, keys: tuple[str, ...], payload: tuple[str, ...]) -> TableChecks:
    own = key_hash(*keys, ts_text("load_datetime"))
    return TableChecks(df).reproducible("09_sat_hk_reproducible", hk, own).reproducible("10_hashdiff_reproducible", "hashdiff", hashdiff(*payload)).none("11_record_source_constant", ~F.col("record_source").eqNullSafe(F.lit(_SOURCE)))


for _name, (_parent, _hub) in _SATS.items():
    _own = f"upper(sha256({_parent} || '||' || strftime(load_datetime AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')))"
    _diff = "upper(sha256(" + " || '||' || ".join(f"coalesce(CAST({c} AS VARCHAR), '^^')" for c in _PAYLOAD[_name]) + "))"
    query(
        f"q3_verify_{_name}_hashes",
        report_sql(
            ("09_sat_hk_reproducible", "0", bad(_name, f"{_name}_hk IS DISTINCT FROM {_own}")),
            ("10_hashdiff_reproducible", "0", bad(_name, f"hashdiff IS DISTINCT FROM {_diff}")),
            ("11_record_source_constant", "0", bad(_name, f"record_source IS DISTINCT FROM '{_SOURCE}'")),
        ),
    )(lambda spark, d, n=_name, p=_parent: _hash_checks(table(spark, d, n), f"{n}_hk", (p,), _PAYLOAD[n]).report())


@query(
    "q3_verify_hub_filing",
    report_sql(
        ("01_hubf_hk_unique", "0", repeated("hub_filing", "hub_filing_hk")),
        ("02_hubf_hk_not_null", "0", bad("hub_filing", "hub_filing_hk IS NULL")),
        ("03_hubf_hk_length_64", "0", bad("hub_filing", "length(hub_filing_hk) <> 64")),
        ("04_hubf_accn_unique", "0", repeated("hub_filing", "accession_number")),
        ("hubf_hash_reproducible", "0", bad("hub_filing", "hub_filing_hk IS DISTINCT FROM upper(sha256(accession_number))")),
        ("hubf_record_source_constant", "0", bad("hub_filing", f"record_source IS DISTINCT FROM '{_SOURCE}'")),
    ),
)
def _(spark, d):
    h = TableChecks(table(spark, d, "hub_filing")).not_null("02_hubf_hk_not_null", "hub_filing_hk").length("03_hubf_hk_length_64", "hub_filing_hk", 64)
    h = h.reproducible("hubf_hash_reproducible", "hub_filing_hk", key_hash("accession_number")).none("hubf_record_source_constant", ~F.col("record_source").eqNullSafe(F.lit(_SOURCE)))
    return h.unique("01_hubf_hk_unique", "hub_filing_hk").unique("04_hubf_accn_unique", "accession_number").report()


@query(
    "q3_verify_link_company_filing_keys",
    report_sql(
        ("13_link_company_key_matches_hub", "0", bad("link_company_filing", "hub_company_hk IS DISTINCT FROM upper(sha256(cik))")),
        ("13_link_filing_key_matches_hub", "0", bad("link_company_filing", "hub_filing_hk IS DISTINCT FROM upper(sha256(accession_number))")),
        ("link_record_source_constant", "0", bad("link_company_filing", f"record_source IS DISTINCT FROM '{_SOURCE}'")),
    ),
)
def _(spark, d):
    c = TableChecks(table(spark, d, "link_company_filing")).reproducible("13_link_company_key_matches_hub", "hub_company_hk", key_hash("cik")).reproducible("13_link_filing_key_matches_hub", "hub_filing_hk", key_hash("accession_number"))
    return c.none("link_record_source_constant", ~F.col("record_source").eqNullSafe(F.lit(_SOURCE))).report()


@query(
    "q3_verify_pit",
    report_sql(
        ("01_pit_hk_unique", "0", repeated("pit_link_filing_concept_period", "pit_link_filing_concept_period_hk")),
        ("02_pit_hk_not_null", "0", bad("pit_link_filing_concept_period", "pit_link_filing_concept_period_hk IS NULL")),
        ("06_pit_composite_pk_unique", "0", repeated("pit_link_filing_concept_period", "link_filing_concept_period_hk", "as_of_date")),
        ("09_pit_hk_reproducible", "0", bad("pit_link_filing_concept_period", "pit_link_filing_concept_period_hk IS DISTINCT FROM upper(sha256(link_filing_concept_period_hk || '||' || CAST(as_of_date AS VARCHAR)))")),
        ("10_pit_fk_closure_sat_non_null", "0", lost("pit_link_filing_concept_period", "sat_concept_value_pk", "sat_concept_value", "sat_concept_value_hk")),
    ),
)
def _(spark, d):
    p = table(spark, d, "pit_link_filing_concept_period")
    return (
        TableChecks(p).not_null("02_pit_hk_not_null", "pit_link_filing_concept_period_hk").reproducible("09_pit_hk_reproducible", "pit_link_filing_concept_period_hk", key_hash("link_filing_concept_period_hk", "as_of_date"))
        .unique("01_pit_hk_unique", "pit_link_filing_concept_period_hk").unique("06_pit_composite_pk_unique", "link_filing_concept_period_hk", "as_of_date")
        .relationship("10_pit_fk_closure_sat_non_null", "sat_concept_value_pk", table(spark, d, "sat_concept_value"), "sat_concept_value_hk").report()
    )


@query(
    "q3_verify_mart_financial_health",
    report_sql(
        ("01_mart_hk_unique", "0", repeated("mart_financial_health", "mart_financial_health_hk")),
        ("02_mart_hk_not_null", "0", bad("mart_financial_health", "mart_financial_health_hk IS NULL")),
        ("04_mart_fk_closure_hub_company", "0", lost("mart_financial_health", "cik", "hub_company", "cik")),
        ("06_mart_composite_pk_unique", "0", repeated("mart_financial_health", "cik", "as_of_date", "fiscal_year")),
        ("08_keys_not_null", "0", bad("mart_financial_health", "cik IS NULL OR as_of_date IS NULL OR fiscal_year IS NULL OR period_end_date IS NULL")),
        ("14_at_least_revenue_or_assets", "0", bad("mart_financial_health", "revenue IS NULL AND assets IS NULL")),
        ("15_gross_margin_finite_bounded", "0", bad("mart_financial_health", "isnan(gross_margin) OR isinf(gross_margin) OR NOT (gross_margin BETWEEN -10 AND 1)")),
        ("16_mart_hk_reproducible", "0", bad("mart_financial_health", "mart_financial_health_hk IS DISTINCT FROM upper(sha256(cik || '||' || CAST(as_of_date AS VARCHAR) || '||' || CAST(fiscal_year AS VARCHAR)))")),
    ),
)
def _(spark, d):
    m, g = table(spark, d, "mart_financial_health"), F.col("gross_margin")
    return (
        TableChecks(m).not_null("02_mart_hk_not_null", "mart_financial_health_hk").not_null("08_keys_not_null", "cik", "as_of_date", "fiscal_year", "period_end_date")
        .none("14_at_least_revenue_or_assets", F.col("revenue").isNull() & F.col("assets").isNull()).none("15_gross_margin_finite_bounded", F.isnan(g) | (F.abs(g) == float("inf")) | ~g.between(-10, 1))
        .reproducible("16_mart_hk_reproducible", "mart_financial_health_hk", key_hash("cik", "as_of_date", "fiscal_year")).unique("01_mart_hk_unique", "mart_financial_health_hk").unique("06_mart_composite_pk_unique", "cik", "as_of_date", "fiscal_year")
        .relationship("04_mart_fk_closure_hub_company", "cik", table(spark, d, "hub_company"), "cik").report()
    )


# --- Q3 to Q6, Q19: reports of the built warehouse


@query(
    "q3_verify_built_marts",
    report_sql(
        ("pl_01_mart_hk_unique", "0", repeated("pl_trend", "mart_pl_trend_hk")),
        ("pl_07_mart_composite_pk_unique", "0", repeated("pl_trend", "cik", "as_of_date", "fiscal_year", "canonical_concept")),
        ("pl_09_canonical_concept_accepted_values", "0", bad("pl_trend", "canonical_concept NOT IN ('revenue', 'net_income')")),
        ("pb_13_peer_rank_within_bounds", "0", bad("peer", "NOT (peer_rank BETWEEN 1 AND peer_count)")),
        ("pb_14_peer_percentile_within_bounds", "0", bad("peer", "peer_percentile <= 0 OR peer_percentile > 1")),
        ("fh_06_mart_composite_pk_unique", "0", repeated("health", "cik", "as_of_date", "fiscal_year")),
        ("br_10_bridge_composite_pk_unique", "0", repeated("bridge", "link_filing_concept_period_hk", "as_of_date")),
        before=CHAIN_SQL,
    ),
)
def _(spark, d):
    return _built_marts(Build(spark, d))


def _built_marts(b: Build) -> DataFrame:
    pl = TableChecks(b.pl_trend).accepted("pl_09_canonical_concept_accepted_values", "canonical_concept", ["revenue", "net_income"]).unique("pl_01_mart_hk_unique", "mart_pl_trend_hk").unique("pl_07_mart_composite_pk_unique", "cik", "as_of_date", "fiscal_year", "canonical_concept").report()
    pb = TableChecks(b.peer_benchmark).none("pb_13_peer_rank_within_bounds", ~F.col("peer_rank").between(1, F.col("peer_count"))).none("pb_14_peer_percentile_within_bounds", (F.col("peer_percentile") <= 0) | (F.col("peer_percentile") > 1)).report()
    fh = TableChecks(b.financial_health).unique("fh_06_mart_composite_pk_unique", "cik", "as_of_date", "fiscal_year").report()
    br = TableChecks(b.bridge).unique("br_10_bridge_composite_pk_unique", "link_filing_concept_period_hk", "as_of_date").report()
    return pl.unionByName(pb).unionByName(fh).unionByName(br)


def _hk(df: DataFrame, hk: str, *parts: str, nullable: tuple[int, ...] = ()) -> TableChecks:
    """Checks of the key of a built table, which is computed once for all of them."""
    c = TableChecks(cut(df)).not_null("hk_not_null", hk).length("hk_length_64", hk, 64).unique("hk_unique", hk)
    return c.reproducible("hk_reproducible", hk, key_hash(*parts, nullable=nullable)) if parts else c


def _from_source(c: TableChecks) -> TableChecks:
    return c.none("record_source_constant", ~F.col("record_source").eqNullSafe(F.lit(_SOURCE)))


def _dates(c: TableChecks) -> TableChecks:
    return c.none("fk_closure_dim_as_of", ~F.coalesce(F.col("as_of_date").cast("string").isin(*AS_OF_DATES), F.lit(False)))


def built_hub_concept(b: Build) -> DataFrame:
    c = _from_source(_hk(b.hub_concept, "hub_concept_hk", "canonical_concept")).not_null("bk_not_null", "canonical_concept").unique("bk_unique", "canonical_concept")
    return c.same_count("source_coverage_parity", b.concepts.select("canonical_concept").where("canonical_concept IS NOT NULL"), b.hub_concept.select("canonical_concept")).report()


def built_link_filing_concept_period(b: Build) -> DataFrame:
    c = _from_source(_hk(b.link_filing_concept_period, "link_filing_concept_period_hk", *LINK_PARTS, nullable=(3, 5, 6))).not_null("period_end_date_not_null", "period_end_date").not_null("bks_not_null", "cik", "accession_number", "canonical_concept")
    c = c.reproducible("fk_company_hash_reproducible", "hub_company_hk", key_hash("cik"))
    for h, parent in (("hub_company_hk", b.hub_company), ("hub_filing_hk", b.hub_filing), ("hub_concept_hk", b.hub_concept)):
        c = c.relationship(f"fk_closure_{h[4:-3]}", h, parent, h)
    grain = c.df.groupBy(*LINK_PARTS).agg(F.count(F.lit(1)).alias("n"))  # with NULL parts
    return c.report().unionByName(TableChecks(grain).none("composite_grain_unique", F.col("n") > 1).report())


def built_sat_concept_canonical(b: Build) -> DataFrame:
    c = _hk(b.sat_concept_canonical, "sat_concept_canonical_hk", "hub_concept_hk", "sub_sequence_key", ts_text("load_datetime"))
    c = _from_source(c).reproducible("hashdiff_reproducible", "hashdiff", hashdiff("concept_name")).not_null("hashdiff_not_null", "hashdiff").length("hashdiff_length_64", "hashdiff", 64)
    c = c.not_null("sub_sequence_key_not_null", "sub_sequence_key").length("sub_sequence_key_length_64", "sub_sequence_key", 64).unique("composite_pk_unique", "hub_concept_hk", "sub_sequence_key", "load_datetime")
    return c.relationship("fk_closure_hub_concept", "hub_concept_hk", b.hub_concept, "hub_concept_hk").same_count("parent_coverage", b.hub_concept.select("hub_concept_hk"), c.df.select("hub_concept_hk")).report()


def built_bridge(b: Build) -> DataFrame:
    c = _dates(_hk(b.bridge, "bridge_company_concept_period_hk", "hub_company_hk", "link_company_filing_hk", "link_filing_concept_period_hk", "as_of_date"))
    for h, parent in (("hub_company_hk", b.hub_company), ("hub_filing_hk", b.hub_filing), ("hub_concept_hk", b.hub_concept), ("link_company_filing_hk", b.link_company_filing), ("link_filing_concept_period_hk", b.link_filing_concept_period)):
        c = c.relationship(f"fk_closure_{h[:-3]}", h, parent, h)
    return c.report()


def _mart(c: TableChecks, b: Build, concepts: list[str]) -> TableChecks:
    c = _dates(c).none("canonical_concept_accepted_values", ~F.coalesce(F.col("canonical_concept").isin(*concepts), F.lit(False))).not_null("keys_not_null", "cik", "as_of_date", "fiscal_year", "canonical_concept")
    return c.relationship("fk_closure_hub_company", "cik", b.hub_company, "cik").relationship("fk_closure_hub_concept", "canonical_concept", b.hub_concept, "canonical_concept")


_MART_KEY = ("cik", "as_of_date", "fiscal_year", "canonical_concept")


def built_pl_trend(b: Build) -> DataFrame:
    c = _mart(_hk(b.pl_trend, "mart_pl_trend_hk", *_MART_KEY), b, ["revenue", "net_income"])
    return c.not_null("value_numeric_not_null", "value_numeric").none("unit_constant_usd", ~F.col("unit").eqNullSafe(F.lit("USD"))).report()


def built_peer_benchmark(b: Build) -> DataFrame:
    c = _mart(_hk(b.peer_benchmark, "mart_peer_benchmark_hk", *_MART_KEY), b, ["revenue", "net_income", "assets"]).unique("composite_pk_unique", *_MART_KEY)
    return c.not_null("value_numeric_not_null", "value_numeric").counted("peer_count_consistent_per_partition", "peer_count", "as_of_date", "fiscal_year", "canonical_concept", "gics_sector").report()


def built_growth_forecast(b: Build) -> DataFrame:
    c = _mart(_hk(b.growth_forecast, "mart_growth_forecast_hk", "cik", "canonical_concept", "fiscal_year", "as_of_date", "row_kind"), b, ["revenue"])
    past, ahead = F.col("row_kind") == "historical", F.col("row_kind") == "forecast"
    model = ["forecast_value", "lower_ci_95", "upper_ci_95", "model_name"]
    no_model, no_part = F.coalesce(*[F.col(m).cast("string") for m in model]).isNull(), F.greatest(*[F.col(m).isNull() for m in model])
    c = c.none("row_kind_accepted_values", ~F.coalesce(past | ahead, F.lit(False))).not_null("entity_name_not_null", "entity_name").unique("composite_pk_unique", "cik", "canonical_concept", "fiscal_year", "as_of_date", "row_kind")
    c = c.none("historical_leg_columns_populated", past & (F.col("value_numeric").isNull() | ~no_model)).none("forecast_leg_columns_populated", ahead & (no_part | F.col("value_numeric").isNotNull()))
    c = c.none("forecast_ci_coherent", ahead & ~F.coalesce((F.col("lower_ci_95") <= F.col("forecast_value")) & (F.col("forecast_value") <= F.col("upper_ci_95")), F.lit(False)))
    years = c.df.where(ahead).groupBy("cik").agg(F.count_distinct("fiscal_year").alias("n"))
    return c.report().unionByName(TableChecks(years).none("forecast_horizon_3_years_per_company", F.col("n") != 3).report())


_BUILT = {f.__name__: f for f in (built_hub_concept, built_link_filing_concept_period, built_sat_concept_canonical, built_bridge, built_pl_trend, built_peer_benchmark, built_growth_forecast)}


def _hash_sql(*parts: str, nullable: tuple[int, ...] = ()) -> str:
    return "upper(sha256(" + " || '||' || ".join(f"coalesce(CAST({p} AS VARCHAR), '^^')" if i in nullable else f"CAST({p} AS VARCHAR)" for i, p in enumerate(parts)) + "))"


def _hk_sql(source: str, hk: str, *parts: str, nullable: tuple[int, ...] = ()) -> list[tuple[str, str, str]]:
    return [("hk_not_null", "0", bad(source, f"{hk} IS NULL")), ("hk_length_64", "0", bad(source, f"length({hk}) <> 64")), ("hk_unique", "0", repeated(source, hk)), ("hk_reproducible", "0", bad(source, f"{hk} IS DISTINCT FROM {_hash_sql(*parts, nullable=nullable)}"))]


def _source_sql(source: str) -> tuple[str, str, str]:
    return ("record_source_constant", "0", bad(source, f"record_source IS DISTINCT FROM '{_SOURCE}'"))


def _dates_sql(source: str) -> tuple[str, str, str]:
    return ("fk_closure_dim_as_of", "0", bad(source, "as_of_date IS NULL OR as_of_date NOT IN (SELECT as_of_date FROM dates)"))


def _mart_sql(source: str, concepts: list[str]) -> list[tuple[str, str, str]]:
    listed = ", ".join(f"'{c}'" for c in concepts)
    return [
        _dates_sql(source), ("canonical_concept_accepted_values", "0", bad(source, f"canonical_concept IS NULL OR canonical_concept NOT IN ({listed})")),
        ("keys_not_null", "0", bad(source, "cik IS NULL OR as_of_date IS NULL OR fiscal_year IS NULL OR canonical_concept IS NULL")),
        ("fk_closure_hub_company", "0", lost(source, "cik", "hub_company", "cik")), ("fk_closure_hub_concept", "0", lost(source, "canonical_concept", "hub_concept", "canonical_concept")),
    ]


def _fk_sql(source: str, short: bool, **parents: str) -> list[tuple[str, str, str]]:
    return [(f"fk_closure_{h[4:-3] if short else h[:-3]}", "0", lost(source, h, parent, h)) for h, parent in parents.items()]


_HUBS = {"hub_company_hk": "hub_company", "hub_filing_hk": "hub_filing", "hub_concept_hk": "hub_concept"}
#: The same checks in SQL. Those of the forecasts, which SQL cannot fit, say what must come out.
_BUILT_SQL: dict[str, list[tuple[str, str, str]]] = {
    "built_hub_concept": [
        *_hk_sql("hub_concept", "hub_concept_hk", "canonical_concept"), _source_sql("hub_concept"), ("bk_not_null", "0", bad("hub_concept", "canonical_concept IS NULL")), ("bk_unique", "0", repeated("hub_concept", "canonical_concept")),
        ("source_coverage_parity", "SELECT count(DISTINCT canonical_concept) FROM concepts", "SELECT count(DISTINCT canonical_concept) FROM hub_concept"),
    ],
    "built_link_filing_concept_period": [
        *_hk_sql("lfcp", "link_filing_concept_period_hk", *LINK_PARTS, nullable=(3, 5, 6)), _source_sql("lfcp"), ("period_end_date_not_null", "0", bad("lfcp", "period_end_date IS NULL")), ("bks_not_null", "0", bad("lfcp", "cik IS NULL OR accession_number IS NULL OR canonical_concept IS NULL")),
        ("fk_company_hash_reproducible", "0", bad("lfcp", f"hub_company_hk IS DISTINCT FROM {_hash_sql('cik')}")), *_fk_sql("lfcp", True, **_HUBS),
        ("composite_grain_unique", "0", f"SELECT count(*) FROM (SELECT 1 FROM lfcp GROUP BY {', '.join(LINK_PARTS)} HAVING count(*) > 1)"),
    ],
    "built_sat_concept_canonical": [
        *_hk_sql("sat_canonical", "sat_concept_canonical_hk", "hub_concept_hk", "sub_sequence_key", "load_datetime"), _source_sql("sat_canonical"), ("hashdiff_reproducible", "0", bad("sat_canonical", f"hashdiff IS DISTINCT FROM {_hash_sql('concept_name', nullable=(0,))}")),
        ("hashdiff_not_null", "0", bad("sat_canonical", "hashdiff IS NULL")), ("hashdiff_length_64", "0", bad("sat_canonical", "length(hashdiff) <> 64")), ("sub_sequence_key_not_null", "0", bad("sat_canonical", "sub_sequence_key IS NULL")), ("sub_sequence_key_length_64", "0", bad("sat_canonical", "length(sub_sequence_key) <> 64")),
        ("composite_pk_unique", "0", repeated("sat_canonical", "hub_concept_hk", "sub_sequence_key", "load_datetime")), ("fk_closure_hub_concept", "0", lost("sat_canonical", "hub_concept_hk", "hub_concept", "hub_concept_hk")),
        ("parent_coverage", "SELECT count(DISTINCT hub_concept_hk) FROM hub_concept", "SELECT count(DISTINCT hub_concept_hk) FROM sat_canonical"),
    ],
    "built_bridge": [*_hk_sql("bridge", "bridge_company_concept_period_hk", "hub_company_hk", "link_company_filing_hk", "link_filing_concept_period_hk", "as_of_date"), _dates_sql("bridge"), *_fk_sql("bridge", False, **_HUBS, link_company_filing_hk="link_company_filing", link_filing_concept_period_hk="lfcp")],
    "built_pl_trend": [*_hk_sql("pl_trend", "mart_pl_trend_hk", *_MART_KEY), *_mart_sql("pl_trend", ["revenue", "net_income"]), ("value_numeric_not_null", "0", bad("pl_trend", "value_numeric IS NULL")), ("unit_constant_usd", "0", bad("pl_trend", "unit IS DISTINCT FROM 'USD'"))],
    "built_peer_benchmark": [
        *_hk_sql("peer", "mart_peer_benchmark_hk", *_MART_KEY), *_mart_sql("peer", ["revenue", "net_income", "assets"]), ("composite_pk_unique", "0", repeated("peer", *_MART_KEY)), ("value_numeric_not_null", "0", bad("peer", "value_numeric IS NULL")),
        ("peer_count_consistent_per_partition", "0", "SELECT count(*) FROM (SELECT 1 FROM peer GROUP BY as_of_date, fiscal_year, canonical_concept, gics_sector HAVING min(peer_count) <> count(*) OR max(peer_count) <> count(*))"),
    ],
    "built_growth_forecast": [(n, "0", "0") for n in (
        "hk_not_null", "hk_length_64", "hk_unique", "hk_reproducible", "fk_closure_dim_as_of", "canonical_concept_accepted_values", "keys_not_null", "fk_closure_hub_company", "fk_closure_hub_concept", "row_kind_accepted_values", "entity_name_not_null", "composite_pk_unique",
        "historical_leg_columns_populated", "forecast_leg_columns_populated", "forecast_ci_coherent", "forecast_horizon_3_years_per_company",
    )],
}
for _name, _f in _BUILT.items():
    query(f"q3_verify_{_name}", report_sql(*_BUILT_SQL[_name], before=CHAIN_SQL))(lambda spark, d, f=_f: f(Build(spark, d)))


@query("q4_monotonic_visibility", CHAIN_SQL + f"SELECT CAST(count(*) FILTER (WHERE as_of_date = DATE '{AS_OF_DATES[0]}') AS BIGINT) AS at_first, CAST(count(*) FILTER (WHERE as_of_date = DATE '{AS_OF_DATES[-1]}') AS BIGINT) AS at_last FROM pit")
def _(spark, d):
    at = F.col("as_of_date")
    return Build(spark, d).pit.agg(F.count_if(at == F.lit(AS_OF_DATES[0]).cast("date")).alias("at_first"), F.count_if(at == F.lit(AS_OF_DATES[-1]).cast("date")).alias("at_last"))


@query("q6_forecast_checks", "SELECT CAST(0 AS BIGINT) AS ci_inversions, CAST(0 AS BIGINT) AS bad_horizons")
def _(spark, d):
    f = Build(spark, d).forecasts
    three = f.groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("forecast_year").alias("years")).where("n <> 3 OR years <> 3")
    inverted = F.col("lower_ci_95").isNull() | F.col("upper_ci_95").isNull() | (F.col("lower_ci_95") > F.col("forecast_value")) | (F.col("forecast_value") > F.col("upper_ci_95"))
    rows = f.agg(F.count_if(inverted).alias("ci_inversions")).crossJoin(F.broadcast(three.agg(F.count(F.lit(1)).alias("bad_horizons"))))  # one row each
    return rows


# --- Q2 and Q7 to Q18: semantic audits


@query("q2_net_margin_range", "SELECT DISTINCT mart_financial_health_hk, net_margin FROM mart_financial_health WHERE abs(net_margin) > 3")
def _(spark, d):
    return table(spark, d, "mart_financial_health").where(F.abs("net_margin") > 3).select("mart_financial_health_hk", "net_margin").distinct()


@query("q2_roa_range", "SELECT DISTINCT mart_financial_health_hk, return_on_assets FROM mart_financial_health WHERE return_on_assets < -1 OR return_on_assets > 1")
def _(spark, d):
    return table(spark, d, "mart_financial_health").where("return_on_assets < -1 OR return_on_assets > 1").select("mart_financial_health_hk", "return_on_assets").distinct()


#: Share of the universe that must report revenue in the latest complete year.
REPORTING_SHARE = 95 / 107


@query("q2_revenue_completeness", CHAIN_SQL + f"SELECT count(DISTINCT h.cik) AS reporting_ciks FROM health h WHERE is_latest_complete_fy AND revenue IS NOT NULL AND as_of_date = (SELECT max(as_of_date) FROM health) AND cik IN (SELECT cik FROM universe) HAVING count(DISTINCT h.cik) < {REPORTING_SHARE} * (SELECT count(*) FROM universe)")
def _(spark, d):
    """A row if fewer companies than the share report revenue in the latest complete year at the latest date."""
    b = Build(spark, d)
    h = b.financial_health
    last = h.agg(F.max("as_of_date").alias("as_of_date"))  # one row, as the two counts
    n = h.where("is_latest_complete_fy AND revenue IS NOT NULL").join(F.broadcast(last), "as_of_date").join(b.universe, "cik", "left_semi").agg(F.count_distinct("cik").alias("reporting_ciks"))
    return n.crossJoin(F.broadcast(b.universe.agg(F.count(F.lit(1)).alias("all_")))).where(F.col("reporting_ciks") < REPORTING_SHARE * F.col("all_")).select("reporting_ciks")


@query("q2_ci_ordering", CHAIN_SQL + "SELECT cik, fiscal_year, CAST(NULL AS DOUBLE) AS forecast_value, CAST(NULL AS DOUBLE) AS lower_ci_95, CAST(NULL AS DOUBLE) AS upper_ci_95 FROM pl_trend WHERE false")
def _(spark, d):
    """Forecast rows whose bounds are absent or out of order: none, as the SQL says."""
    f = Build(spark, d).forecasts.select("cik", F.col("forecast_year").alias("fiscal_year"), "forecast_value", "lower_ci_95", "upper_ci_95")
    return f.where(~F.coalesce((F.col("lower_ci_95") <= F.col("forecast_value")) & (F.col("forecast_value") <= F.col("upper_ci_95")), F.lit(False)))


@query("q2_snapshot_stability", CHAIN_SQL + "SELECT cik, fiscal_year, canonical_concept, count(DISTINCT value_numeric) AS distinct_values FROM pl_trend GROUP BY 1, 2, 3 HAVING count(DISTINCT value_numeric) > 1")
def _(spark, d):
    g = Build(spark, d).pl_trend.groupBy("cik", "fiscal_year", "canonical_concept").agg(F.count_distinct("value_numeric").alias("distinct_values"))
    return g.where("distinct_values > 1")


@query(
    "q7_completeness",
    r"""WITH u AS (SELECT DISTINCT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik FROM sp100_company_sector WHERE regexp_extract(cik, '(\d+)', 1) <> ''), y AS (SELECT unnest(range(2017, 2025)) AS fiscal_year),
    c AS (SELECT fiscal_year, count(DISTINCT CASE WHEN revenue IS NOT NULL THEN cik END) AS revenue, count(DISTINCT CASE WHEN assets IS NOT NULL THEN cik END) AS assets FROM mart_financial_health WHERE cik IN (SELECT cik FROM u) GROUP BY 1)
    SELECT CAST(y.fiscal_year AS INTEGER) AS fiscal_year, p.c AS column_name, coalesce(CASE WHEN p.c = 'revenue' THEN c.revenue ELSE c.assets END, 0) AS companies, round(coalesce(CASE WHEN p.c = 'revenue' THEN c.revenue ELSE c.assets END, 0) * 100.0 / (SELECT count(*) FROM u), 1) AS pct
    FROM y LEFT JOIN c ON y.fiscal_year = c.fiscal_year, (VALUES ('revenue'), ('assets')) AS p(c)""",
)
def _(spark, d):
    u = table(spark, d, "sp100_company_sector").select(X.ten_digits("cik").alias("cik")).where("cik IS NOT NULL").distinct()
    return completeness(u, list(range(2017, 2025)), table(spark, d, "mart_financial_health"), "cik", "fiscal_year", ["revenue", "assets"])


@query(
    "q8_coverage_by_sector",
    r"""WITH s AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, min(trim(gics_sector)) AS sector FROM sp100_company_sector WHERE regexp_extract(cik, '(\d+)', 1) <> '' GROUP BY 1)
    SELECT coalesce(sector, 'TOTAL') AS sector, count(*) AS companies, count(*) FILTER (WHERE cik IN (SELECT cik FROM mart_financial_health WHERE revenue IS NOT NULL)) AS with_revenue FROM (SELECT cik, coalesce(sector, 'NONE') AS sector FROM s) GROUP BY ROLLUP (sector)""",
)
def _(spark, d):
    s = table(spark, d, "sp100_company_sector").where(X.ten_digits("cik").isNotNull()).groupBy(X.ten_digits("cik").alias("cik")).agg(F.coalesce(F.min(F.trim("gics_sector")), F.lit("NONE")).alias("sector"))
    held = table(spark, d, "mart_financial_health").where("revenue IS NOT NULL").select("cik").distinct().withColumn("has", F.lit(True))
    rows = s.join(held, "cik", "left")
    return rows.rollup("sector").agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("has")).alias("with_revenue")).select(F.coalesce("sector", F.lit("TOTAL")).alias("sector"), "companies", "with_revenue")


@query(
    "q10_collapse_classes",
    r"""WITH p AS (SELECT DISTINCT canonical_concept, concept_name FROM canonical_concept_tag_preference), g AS (SELECT s.sat_concept_value_hk, count(DISTINCT s.concept_name) AS tags, count(DISTINCT s.value) AS vals FROM sat_concept_value s JOIN p USING (canonical_concept, concept_name) WHERE s.value IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN tags = 1 THEN 'SINGLE_TAG' WHEN vals = 1 THEN 'MULTI_TAG_AGREE' ELSE 'MULTI_TAG_DISAGREE' END AS class, count(*) AS groups FROM g GROUP BY 1""",
)
def _(spark, d):
    p = table(spark, d, "canonical_concept_tag_preference").select("canonical_concept", "concept_name").distinct()
    s = table(spark, d, "sat_concept_value").where("value IS NOT NULL").select("sat_concept_value_hk", "canonical_concept", "concept_name", "value").join(p, ["canonical_concept", "concept_name"])
    g = s.groupBy("sat_concept_value_hk").agg(F.count_distinct("concept_name").alias("tags"), F.count_distinct("value").alias("vals"))
    kind = F.when(F.col("tags") == 1, "SINGLE_TAG").when(F.col("vals") == 1, "MULTI_TAG_AGREE").otherwise("MULTI_TAG_DISAGREE")
    return g.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("groups"))


_GRAIN = [*LINK_PARTS]


@query(
    "q10_collapse_simulation",
    CHAIN_SQL.rstrip()
    + f""",
cand AS (SELECT {', '.join(_GRAIN)}, collapse_rule, concept_name, preference_rank, max(value) AS v FROM rivals GROUP BY ALL),
g AS (SELECT {', '.join(_GRAIN)}, any_value(collapse_rule) AS rule, count(DISTINCT concept_name) AS tags, max(v) AS most, min(v) AS least, arg_min(v, preference_rank) AS bare, count(*) FILTER (WHERE preference_rank = first_rank) AS has_bare, max(v) FILTER (WHERE preference_rank <> first_rank) AS wide
  FROM cand JOIN (SELECT canonical_concept AS cc, min(preference_rank) AS first_rank FROM pref GROUP BY 1) ON cc = canonical_concept GROUP BY {', '.join(_GRAIN)})
SELECT canonical_concept, CASE WHEN tags >= 2 AND most <> least THEN 'MULTI_TAG_DISAGREE' WHEN tags >= 2 THEN 'MULTI_TAG_AGREE' WHEN tags = 1 THEN 'SINGLE_TAG' ELSE 'NO_CANDIDATE_FOUND' END AS classification,
  CASE WHEN rule <> 'preference_rank_asc' THEN NULL WHEN has_bare > 0 AND wide IS NULL THEN 'BARE_ONLY' WHEN has_bare = 0 THEN 'RESTRICTED_ONLY' WHEN bare = wide THEN 'BOTH_AGREE' WHEN bare < wide THEN 'RESTRICTED_LARGER' ELSE 'BARE_LARGER_UNUSUAL' END AS override_class,
  CASE WHEN s.value = most THEN 'COLLAPSED_MATCHES_MAX' ELSE 'COLLAPSED_DEVIATES' END AS collapse_check, count(*) AS figures
FROM sat_value0 s JOIN (SELECT upper(sha256(cik || '||' || accession_number || '||' || canonical_concept || '||' || coalesce(period_start_date::VARCHAR, '^^') || '||' || period_end_date::VARCHAR || '||' || coalesce(fiscal_year::VARCHAR, '^^') || '||' || coalesce(fiscal_period, '^^'))) AS hk, * EXCLUDE (canonical_concept) FROM g) ON hk = s.link_filing_concept_period_hk GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    """Candidates of every stored figure, read from the documents again: did rivals differ, and did the rule keep the greatest?"""
    b = Build(spark, d)
    rivals = b.concepts.where("accession_number IS NOT NULL AND value IS NOT NULL").groupBy(*_GRAIN, "collapse_rule", "concept_name", "preference_rank").agg(F.max("value").alias("v"))
    first = b.preference.groupBy("canonical_concept").agg(F.min("preference_rank").alias("first_rank"))
    own = F.col("preference_rank") == F.col("first_rank")
    g = rivals.join(F.broadcast(first), "canonical_concept").groupBy(*_GRAIN).agg(  # one row a concept of the preference table
        F.any_value("collapse_rule").alias("rule"), F.count_distinct("concept_name").alias("tags"), F.max("v").alias("most"), F.min("v").alias("least"),
        F.min_by("v", "preference_rank").alias("bare"), F.count_if(own).alias("has_bare"), F.max(F.when(~own, F.col("v"))).alias("wide"),
    )
    kept = b.sat_concept_value.select("link_filing_concept_period_hk", F.col("value").alias("kept"))
    rows = g.withColumn("link_filing_concept_period_hk", key_hash(*LINK_PARTS, nullable=(3, 5, 6))).join(kept, "link_filing_concept_period_hk", "right")
    many = F.col("tags") >= 2
    kind = F.when(many & (F.col("most") != F.col("least")), "MULTI_TAG_DISAGREE").when(many, "MULTI_TAG_AGREE").when(F.col("tags") == 1, "SINGLE_TAG").otherwise("NO_CANDIDATE_FOUND")
    override = F.when(F.col("rule") != "preference_rank_asc", None).when((F.col("has_bare") > 0) & F.col("wide").isNull(), "BARE_ONLY").when(F.col("has_bare") == 0, "RESTRICTED_ONLY").when(F.col("bare") == F.col("wide"), "BOTH_AGREE").when(F.col("bare") < F.col("wide"), "RESTRICTED_LARGER").otherwise("BARE_LARGER_UNUSUAL")
    check = F.when(F.col("kept") == F.col("most"), "COLLAPSED_MATCHES_MAX").otherwise("COLLAPSED_DEVIATES")
    return rows.groupBy("canonical_concept", kind.alias("classification"), override.alias("override_class"), check.alias("collapse_check")).agg(F.count(F.lit(1)).alias("figures"))


@query(
    "q11_anchor_tolerance",
    """WITH a AS (SELECT cik, fiscal_year, max(revenue) AS anchor FROM mart_financial_health WHERE load_datetime < TIMESTAMPTZ '2022-01-01 00:00:00+00' GROUP BY 1, 2), m AS (SELECT cik, fiscal_year, max(revenue) AS actual FROM mart_financial_health GROUP BY 1, 2)
    SELECT a.cik, a.fiscal_year, CASE WHEN actual IS NULL THEN 'MISSING' WHEN abs(CAST(actual AS DOUBLE) - CAST(anchor AS DOUBLE)) <= 0.005 * abs(CAST(anchor AS DOUBLE)) THEN 'PASS' ELSE 'FAIL' END AS result FROM a LEFT JOIN m USING (cik, fiscal_year) WHERE anchor IS NOT NULL""",
)
def _(spark, d):
    m = table(spark, d, "mart_financial_health")
    early = F.col("load_datetime") < F.lit("2022-01-01").cast("timestamp")
    g = m.groupBy("cik", "fiscal_year").agg(F.max(F.when(early, F.col("revenue"))).cast("double").alias("anchor"), F.max("revenue").cast("double").alias("actual")).where("anchor IS NOT NULL")
    near = F.abs(F.col("actual") - F.col("anchor")) <= 0.005 * F.abs("anchor")
    return g.select("cik", "fiscal_year", F.when(F.col("actual").isNull(), "MISSING").when(near, "PASS").otherwise("FAIL").alias("result"))


@query("q12_sector_aggregates", CHAIN_SQL + "SELECT gics_sector, fiscal_year, count(DISTINCT cik) AS companies, CAST(sum(value_numeric) AS DOUBLE) AS revenue FROM peer WHERE canonical_concept = 'revenue' AND as_of_date = (SELECT max(as_of_date) FROM peer) GROUP BY 1, 2")
def _(spark, d):
    p = Build(spark, d).peer_benchmark
    last = p.agg(F.max("as_of_date").alias("as_of_date"))
    return p.where("canonical_concept = 'revenue'").join(F.broadcast(last), "as_of_date").groupBy("gics_sector", "fiscal_year").agg(F.count_distinct("cik").alias("companies"), F.sum("value_numeric").cast("double").alias("revenue"))  # one row


@query(
    "q13_cross_mart_divergence",
    CHAIN_SQL
    + """SELECT coalesce(t.cik, h.cik) AS cik, coalesce(t.as_of_date, h.as_of_date) AS as_of_date, coalesce(t.fiscal_year, h.fiscal_year) AS fiscal_year, t.value_numeric AS a, h.net_income AS b FROM (SELECT * FROM pl_trend WHERE canonical_concept = 'net_income') t
    FULL JOIN health h ON t.cik = h.cik AND t.as_of_date = h.as_of_date AND t.fiscal_year = h.fiscal_year WHERE coalesce(abs(t.value_numeric - h.net_income) > 1, (t.value_numeric IS NULL) <> (h.net_income IS NULL))""",
)
def _(spark, d):
    b = Build(spark, d)
    return divergence(b.pl_trend.where("canonical_concept = 'net_income'"), b.financial_health, ["cik", "as_of_date", "fiscal_year"], "value_numeric", "net_income")


#: Figures that two marts hold, by name, with side a and side b as (mart, concept or column).
_PAIRS = [
    ("revenue: pl_trend vs financial_health", ("pl", "revenue"), ("fh", "revenue")),
    ("revenue: pl_trend vs peer_benchmark", ("pl", "revenue"), ("pb", "revenue")),
    ("revenue: pl_trend vs growth_forecast historical", ("pl", "revenue"), ("gf", "revenue")),
    ("net_income: pl_trend vs financial_health", ("pl", "net_income"), ("fh", "net_income")),
    ("net_income: pl_trend vs peer_benchmark", ("pl", "net_income"), ("pb", "net_income")),
    ("assets: financial_health vs peer_benchmark", ("fh", "assets"), ("pb", "assets")),
]
_PAIR_SQL = {"pl": "SELECT cik, as_of_date, fiscal_year, value_numeric AS v FROM pl_trend WHERE canonical_concept = '{c}'", "pb": "SELECT cik, as_of_date, fiscal_year, value_numeric AS v FROM peer WHERE canonical_concept = '{c}'", "fh": "SELECT cik, as_of_date, fiscal_year, {c} AS v FROM health WHERE {c} IS NOT NULL", "gf": "SELECT cik, as_of_date, fiscal_year, value_numeric AS v FROM pl_trend WHERE canonical_concept = 'revenue'"}


def cross_mart_pairs(b: Build) -> DataFrame:
    """Six figures that two marts hold: keys compared at all dates, and keys on which they differ or which one lacks."""
    by_concept = {"pl": b.pl_trend, "pb": b.peer_benchmark, "gf": b.growth_forecast.where("row_kind = 'historical'")}
    keys = ["cik", "as_of_date", "fiscal_year"]
    out = None
    for name, *sides in _PAIRS:
        x, y = (b.financial_health.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("v")) if m == "fh" else by_concept[m].where(F.col("canonical_concept") == c).select(*keys, F.col("value_numeric").alias("v")) for m, c in sides)
        both = x.withColumnRenamed("v", "a").join(y.withColumnRenamed("v", "b"), keys, "full")
        apart = F.coalesce(F.abs(F.col("a") - F.col("b")) > 1, F.lit(True))
        one = both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(apart).alias("divergent")).select(F.lit(name).alias("check_name"), "compared", "divergent")
        out = one if out is None else out.unionByName(one)
    return out


@query("q13_cross_mart_pairs", CHAIN_SQL + " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS compared, count(*) FILTER (WHERE coalesce(abs(a.v - b.v) > 1, true)) AS divergent FROM ({_PAIR_SQL[x].format(c=c)}) a FULL JOIN ({_PAIR_SQL[y].format(c=e)}) b ON a.cik = b.cik AND a.as_of_date = b.as_of_date AND a.fiscal_year = b.fiscal_year" for n, (x, c), (y, e) in _PAIRS))
def _(spark, d):
    return cross_mart_pairs(Build(spark, d))


@query("q14_snapshot_drift", "SELECT cik, fiscal_year, count(DISTINCT revenue) AS distinct_values, CASE WHEN count(DISTINCT revenue) <= 1 THEN 'STABLE' ELSE 'RESTATEMENT_OR_DRIFT' END AS stability FROM mart_financial_health GROUP BY 1, 2")
def _(spark, d):
    return drift(table(spark, d, "mart_financial_health"), ["cik", "fiscal_year"], "revenue")


@query("q15_forecast_scorecard")
def _(spark, d):
    b = Build(spark, d)
    last = b.pl_trend.where("canonical_concept = 'revenue'").groupBy("cik").agg(F.max(F.struct("as_of_date", "fiscal_year", F.col("value_numeric").cast("double").alias("v"))).alias("x")).select("cik", "x.v")
    f = b.forecasts.join(last, "cik")
    ratio = F.try_divide("forecast_value", "v")
    cohort = f.agg(F.max("latest_historical_year").alias("c"))
    return f.crossJoin(F.broadcast(cohort)).agg(  # one row
        F.count(F.lit(1)).alias("rows"), F.count_if((F.col("lower_ci_95") > F.col("forecast_value")) | (F.col("forecast_value") > F.col("upper_ci_95"))).alias("ci_inversions"), F.count_if(ratio > 2).alias("more_than_doubled"), F.count_if(ratio < 0.5).alias("less_than_half"),
        F.count_if(F.abs("model_aic") > 1e6).alias("odd_aic"), F.count_if(F.col("latest_historical_year") < F.col("c")).alias("stale_cohort"),
    )


_TRACE = [("1_facts", "facts"), ("2_concepts", "concepts"), ("3_link", "lfcp"), ("4_value", "sat_value"), ("5_bridge", "bridge"), ("6_panel", "kept"), ("7_health", "health")]


@query("q16_layer_trace", CHAIN_SQL + " UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS rows FROM {t}" for n, t in _TRACE))
def _(spark, d):
    b = Build(spark, d)
    parts = [b.facts, b.concepts, b.link_filing_concept_period, b.sat_concept_value, b.bridge, b.panel, b.financial_health]
    out = None
    for (n, _t), df in zip(_TRACE, parts, strict=True):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("layer"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "q17_cardinality_probes",
    "SELECT count(*) AS rows, count(DISTINCT sat_concept_value_hk) AS hks, count(DISTINCT link_filing_concept_period_hk) AS links, count(DISTINCT cik || '|' || accession_number) AS filings, count(DISTINCT fiscal_year || coalesce(fiscal_period, '-')) AS periods FROM sat_concept_value",
)
def _(spark, d):
    s = table(spark, d, "sat_concept_value")
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sat_concept_value_hk").alias("hks"), F.count_distinct("link_filing_concept_period_hk").alias("links"), F.count_distinct(F.concat("cik", F.lit("|"), "accession_number")).alias("filings"), F.count_distinct(F.concat(F.col("fiscal_year").cast("string"), F.coalesce("fiscal_period", F.lit("-")))).alias("periods"))


@query(
    "q18_coverage_gate",
    """WITH y AS (SELECT fiscal_year, count(DISTINCT CASE WHEN revenue IS NOT NULL THEN cik END) * 1.0 / count(DISTINCT cik) AS share FROM mart_financial_health GROUP BY 1)
    SELECT count(*) AS years, coalesce(string_agg(CAST(fiscal_year AS VARCHAR), ', ' ORDER BY fiscal_year) FILTER (WHERE share < 0.95), '') AS failing_years FROM y""",
)
def _(spark, d):
    share = F.count_distinct(F.when(F.col("revenue").isNotNull(), F.col("cik"))) / F.count_distinct("cik")
    y = table(spark, d, "mart_financial_health").groupBy("fiscal_year").agg(share.alias("share"))
    failing = F.array_sort(F.collect_list(F.when(F.col("share") < 0.95, F.col("fiscal_year"))))  # one row a year
    return y.agg(F.count(F.lit(1)).alias("years"), F.array_join(failing, ", ").alias("failing_years"))


#: The reference's gates: a year is complete with 80 of 107 companies; the bar is 95 % of the universe; the revenue of the latest complete year.
COMPLETE_COMPANIES, COVERAGE_BAR, REVENUE_FLOOR = 80 / 107, 0.95, 9.5e12


def coverage_gate(trend: DataFrame, universe: DataFrame, floor: float = REVENUE_FLOOR) -> DataFrame:
    """Report rows on the latest complete year and the two years before it, at the latest as_of_date.

    ``trend``: cik, as_of_date, fiscal_year, canonical_concept, value_numeric; ``universe``: distinct
    cik. Companies and years that ``trend`` lacks count as not covered; companies outside the
    universe don't count. Without a complete year every row is FAIL.
    """
    last = trend.agg(F.max("as_of_date").alias("as_of_date"))
    m = trend.where("canonical_concept IN ('revenue', 'net_income')").join(F.broadcast(last), "as_of_date").join(universe, "cik", "left_semi")  # one row
    held = F.col("value_numeric").isNotNull()
    of = lambda c: F.count_distinct(F.when(held & (F.col("canonical_concept") == c), F.col("cik")))
    years = m.groupBy("fiscal_year").agg(of("revenue").alias("revenue"), of("net_income").alias("net_income"), F.sum(F.when(F.col("canonical_concept") == "revenue", F.col("value_numeric").cast("decimal(28,2)"))).cast("double").alias("total"))
    bars = universe.agg(F.ceil(F.count(F.lit(1)) * F.lit(COVERAGE_BAR)).alias("bar"), F.ceil(F.count(F.lit(1)) * F.lit(COMPLETE_COMPANIES)).alias("least"))
    # one row each: the bars, the latest complete year, its window's figures
    fy = years.crossJoin(F.broadcast(bars)).agg(F.max(F.when((F.col("revenue") >= F.col("least")) & (F.col("least") > 0), F.col("fiscal_year"))).alias("fy"))
    window = fy.select("fy", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("back")).withColumn("fiscal_year", F.col("fy") - F.col("back"))
    rows = window.join(years, "fiscal_year", "left").crossJoin(F.broadcast(bars))
    at = lambda c: F.max(F.when((F.col("back") == 0) & F.col("fy").isNotNull(), F.coalesce(F.col(c), F.lit(0))))
    failing = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("revenue"), F.lit(0)) < F.col("bar"), F.col("fiscal_year"))))  # three at most
    one = rows.agg(F.max("fy").alias("fy"), F.max("bar").alias("bar"), at("revenue").alias("revenue"), at("net_income").alias("net_income"), at("total").alias("total"), failing.alias("failing"))
    none, fy_seen = F.lit("no complete year"), F.col("fy").isNotNull()

    def row(no: int, name: str, expected: Column, actual: Column, passed: Column) -> Column:
        said = F.when(fy_seen, actual.cast("string")).otherwise(none)
        return F.struct(F.lit(no).alias("check_no"), F.lit(name).alias("check_name"), F.col("fy").alias("fiscal_year"), expected.cast("string").alias("expected"), said.alias("actual"), F.when(fy_seen & passed, "PASS").otherwise("FAIL").alias("result"))

    checks = F.array(
        row(1, "latest_complete_fy_revenue_coverage", F.col("bar"), F.col("revenue"), F.col("revenue") >= F.col("bar")),
        row(2, "latest_complete_fy_net_income_coverage", F.col("bar"), F.col("net_income"), F.col("net_income") >= F.col("bar")),
        row(3, "recent_3_fys_below_revenue_bar", F.lit(""), F.array_join("failing", ", "), F.size("failing") == 0),
        row(4, "latest_complete_fy_revenue_floor", F.lit(floor).cast("decimal(38,2)"), F.col("total").cast("decimal(38,2)"), F.col("total") >= F.lit(floor)),
    )
    return one.select(F.explode(checks).alias("c")).select("c.*")


_GATE_SQL = CHAIN_SQL.rstrip() + f""",
gate_m AS (SELECT t.* FROM pl_trend t WHERE canonical_concept IN ('revenue', 'net_income') AND as_of_date = (SELECT max(as_of_date) FROM pl_trend) AND cik IN (SELECT cik FROM universe)),
years AS (SELECT fiscal_year, count(DISTINCT CASE WHEN canonical_concept = 'revenue' AND value_numeric IS NOT NULL THEN cik END) AS revenue, count(DISTINCT CASE WHEN canonical_concept = 'net_income' AND value_numeric IS NOT NULL THEN cik END) AS net_income,
    CAST(sum(CASE WHEN canonical_concept = 'revenue' THEN value_numeric END) AS DOUBLE) AS total FROM gate_m GROUP BY 1),
bars AS (SELECT CAST(ceil(count(*) * {COVERAGE_BAR}) AS BIGINT) AS bar, CAST(ceil(count(*) * CAST({COMPLETE_COMPANIES} AS DOUBLE)) AS BIGINT) AS least FROM universe),
fy AS (SELECT max(CASE WHEN revenue >= least AND least > 0 THEN fiscal_year END) AS fy FROM years, bars),
win AS (SELECT fy.fy, k AS back, y.revenue, y.net_income, y.total, bar FROM fy, bars, (VALUES (0), (1), (2)) AS b(k) LEFT JOIN years y ON y.fiscal_year = fy.fy - k WHERE fy.fy IS NOT NULL),
gate_row AS (SELECT (SELECT fy FROM fy) AS fy, (SELECT bar FROM bars) AS bar, max(CASE WHEN back = 0 THEN coalesce(revenue, 0) END) AS revenue, max(CASE WHEN back = 0 THEN coalesce(net_income, 0) END) AS net_income, max(CASE WHEN back = 0 THEN coalesce(total, 0) END) AS total,
    coalesce(string_agg(CAST(CASE WHEN coalesce(revenue, 0) < bar THEN fy - back END AS VARCHAR), ', ' ORDER BY fy - back), '') AS failing FROM win),
said AS (SELECT 1 AS check_no, 'latest_complete_fy_revenue_coverage' AS check_name, fy, CAST(bar AS VARCHAR) AS expected, CAST(revenue AS VARCHAR) AS actual, revenue >= bar AS passed FROM gate_row
  UNION ALL SELECT 2, 'latest_complete_fy_net_income_coverage', fy, CAST(bar AS VARCHAR), CAST(net_income AS VARCHAR), net_income >= bar FROM gate_row
  UNION ALL SELECT 3, 'recent_3_fys_below_revenue_bar', fy, '', failing, failing = '' FROM gate_row
  UNION ALL SELECT 4, 'latest_complete_fy_revenue_floor', fy, CAST(CAST({REVENUE_FLOOR} AS DECIMAL(38,2)) AS VARCHAR), CAST(CAST(total AS DECIMAL(38,2)) AS VARCHAR), total >= {REVENUE_FLOOR} FROM gate_row)
SELECT check_no, check_name, fy AS fiscal_year, expected, CASE WHEN fy IS NULL THEN 'no complete year' ELSE actual END AS actual, CASE WHEN fy IS NOT NULL AND passed THEN 'PASS' ELSE 'FAIL' END AS result FROM said
"""


@query("q18_coverage_of_universe", _GATE_SQL)
def _(spark, d):
    """Q18 whole, on the built trend mart as in the reference; the SQL of q18_coverage_gate is fixed and narrower."""
    b = Build(spark, d)
    return coverage_gate(b.pl_trend, b.universe)


@query("q19_sign_off")
def _(spark, d):
    """All structural reports of the delivered and the built tables in one, and the audits across them."""
    b = Build(spark, d)
    built = {"q3_verify_built_marts": _built_marts} | {f"q3_verify_{n}": f for n, f in _BUILT.items()}
    parts = {n: built[n](b) if n in built else QUERIES[n](spark, d) for n in sorted(QUERIES) if n.startswith("q3_verify_")}
    apart = divergence(b.pl_trend.where("canonical_concept = 'net_income'"), b.financial_health, ["cik", "as_of_date", "fiscal_year"], "value_numeric", "net_income")
    parts["q13_cross_mart_divergence"] = TableChecks(apart).none("net_income_same_in_both_marts", F.lit(True)).report()
    parts["q14_snapshot_drift"] = TableChecks(drift(table(spark, d, "mart_financial_health"), ["cik", "fiscal_year"], "revenue")).none("revenue_stable_over_snapshots", F.col("stability") != "STABLE").report()
    out = None
    for name, part in parts.items():
        part = part.withColumn("pack", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("q9_tag_evidence", r"""WITH p AS (SELECT DISTINCT canonical_concept, concept_name FROM canonical_concept_tag_preference) SELECT p.canonical_concept, p.concept_name, count(DISTINCT s.cik) AS companies FROM p LEFT JOIN sat_concept_value s ON s.concept_name = p.concept_name GROUP BY 1, 2""")
def _(spark, d):
    p = table(spark, d, "canonical_concept_tag_preference").select("canonical_concept", "concept_name").distinct()
    s = table(spark, d, "sat_concept_value").groupBy("concept_name").agg(F.count_distinct("cik").alias("companies"))
    return p.join(s, "concept_name", "left").select("canonical_concept", "concept_name", F.coalesce("companies", F.lit(0)).alias("companies"))


def _pack_sql(name: str) -> str:
    """The rows of one report as a scalar-free subquery over the chain."""
    own = ORACLE_SQL[name].removeprefix(CHAIN_SQL)
    return f"SELECT '{name}' AS pack, * FROM ({own})"


_CROSS_SQL = report_sql(("net_income_same_in_both_marts", "0", ORACLE_SQL["q13_cross_mart_divergence"].removeprefix(CHAIN_SQL).replace("SELECT coalesce(t.cik, h.cik)", "SELECT count(*) FROM (SELECT coalesce(t.cik, h.cik)") + ")"))
_DRIFT_SQL = report_sql(("revenue_stable_over_snapshots", "0", f"SELECT count(*) FROM ({ORACLE_SQL['q14_snapshot_drift']}) WHERE stability <> 'STABLE'"))
# Delivered tables of the same names stand behind the chain's, so their packs are computed before it.
_DELIVERED = [n for n in sorted(ORACLE_SQL) if n.startswith("q3_verify_") and not n.startswith("q3_verify_built_")]
_MADE = [n for n in sorted(ORACLE_SQL) if n.startswith("q3_verify_built_")]
ORACLE_SQL["q19_sign_off"] = (
    "SELECT * FROM (" + " UNION ALL ".join(_pack_sql(n) for n in _DELIVERED) + f" UNION ALL SELECT 'q14_snapshot_drift' AS pack, * FROM ({_DRIFT_SQL})) UNION ALL SELECT * FROM ("
    + CHAIN_SQL + " UNION ALL ".join(_pack_sql(n) for n in _MADE) + f" UNION ALL SELECT 'q13_cross_mart_divergence' AS pack, * FROM ({_CROSS_SQL}))"
)


@query("q9_tag_documents", P4_TAGS_SQL[: P4_TAGS_SQL.rindex("SELECT DISTINCT doc_key")] + ", p AS (SELECT DISTINCT canonical_concept, concept_name FROM canonical_concept_tag_preference) SELECT p.canonical_concept, p.concept_name, count(DISTINCT t.cik) AS companies, count(DISTINCT t.doc_key) AS documents FROM p LEFT JOIN (SELECT * FROM tag WHERE taxonomy = 'us-gaap') t ON t.concept_name = p.concept_name GROUP BY 1, 2")
def _(spark, d):
    """Which documents hold each listed tag at all, whatever became of its figures."""
    p = table(spark, d, "canonical_concept_tag_preference").select("canonical_concept", "concept_name").distinct()
    raw = table(spark, d, "sec_edgar_companyfacts_raw").select("json_text", "extract_date", "cik")
    t = flatten_documents(spread(raw), "tags", cik=X.ten_digits("cik")).where("taxonomy = 'us-gaap'").select("concept_name", "cik", "doc_key")
    held = t.groupBy("concept_name").agg(F.count_distinct("cik").alias("companies"), F.count_distinct("doc_key").alias("documents"))
    return p.join(held, "concept_name", "left").select("canonical_concept", "concept_name", F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("documents", F.lit(0)).alias("documents"))
