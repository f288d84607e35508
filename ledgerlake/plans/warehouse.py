"""The warehouse from raw documents to marts, parsed once.

``Build`` holds every table as a lazy DataFrame; the parsed facts, the annual panel and the trend
mart, which several tables read, are materialised once each. Each table's SQL is one link of a chain of common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.functions.hashing import key_hash, ts_text
from ledgerlake.operators import marts as M
from ledgerlake.operators.forecast import forecast
from ledgerlake.operators.nested import flatten_documents
from ledgerlake.operators.vault import asof_expand, collapse, latest_rows, load_hub, load_link, load_satellite
from ledgerlake.session import cut, spread
from ledgerlake.sources.tables import table

LOAD_TS = datetime(2026, 6, 1)
AS_OF_DATES = [*(f"{y}-12-31" for y in range(2014, 2025)), "2025-06-30"]
LINK_PARTS = ["cik", "accession_number", "canonical_concept", "period_start_date", "period_end_date", "fiscal_year", "fiscal_period"]
PANEL_CONCEPTS = ["revenue", "gross_profit", "operating_income", "net_income", "assets", "liabilities", "stockholders_equity", "cash_and_equivalents", "operating_cash_flow", "cost_of_revenue", "liabilities_and_se", "stockholders_equity_including_nci", "minority_interest"]
#: Share of the companies with revenue that makes a year complete.
COMPLETE_SHARE = 0.5


class Build:
    """All tables of the warehouse for one directory of raw tables."""

    def __init__(self, spark: SparkSession, d: str, load_ts: datetime = LOAD_TS, existing: Callable[[str], DataFrame | None] = lambda name: None):
        self.spark, self.d, self.load_ts, self.existing = spark, d, load_ts, existing

    @cached_property
    def universe(self) -> DataFrame:
        return table(self.spark, self.d, "sp100_company_sector").select(X.ten_digits("cik").alias("cik")).where("cik IS NOT NULL").distinct()

    @cached_property
    def sectors(self) -> DataFrame:
        s = table(self.spark, self.d, "sp100_company_sector").select(X.ten_digits("cik").alias("cik"), F.btrim("gics_sector").alias("gics_sector"), F.btrim("gics_industry_group").alias("gics_industry_group"))
        return s.where("cik IS NOT NULL").groupBy("cik").agg(F.min("gics_sector").alias("gics_sector"), F.min("gics_industry_group").alias("gics_industry_group"))

    @cached_property
    def preference(self) -> DataFrame:
        return table(self.spark, self.d, "canonical_concept_tag_preference").distinct()

    @cached_property
    def facts(self) -> DataFrame:
        """Typed entries of us-gaap tags in USD; one pass over the documents."""
        raw = table(self.spark, self.d, "sec_edgar_companyfacts_raw")
        e = flatten_documents(spread(raw.select("json_text", "extract_date", "cik")), "entries", cik=X.ten_digits("cik"))
        typed = e.where("taxonomy = 'us-gaap' AND unit = 'USD'").select(
            "cik",
            F.col("extract_date").try_cast("date").alias("extract_date"),
            "concept_name",
            F.col("accn").alias("accession_number"),
            F.col("form").alias("form_type"),
            F.col("filed").try_cast("date").alias("filed_date"),
            F.col("start").try_cast("date").alias("period_start_date"),
            F.col("end").try_cast("date").alias("period_end_date"),
            F.col("fy").try_cast("int").alias("fiscal_year"),
            F.col("fp").alias("fiscal_period"),
            F.col("val").try_cast("decimal(28,2)").alias("value"),
        )
        return cut(typed.distinct())

    @cached_property
    def concepts(self) -> DataFrame:
        """Facts of the universe under listed tags with their canonical concept."""
        return self.facts.join(self.universe, "cik", "left_semi").join(F.broadcast(self.preference), "concept_name")

    @cached_property
    def cover(self) -> DataFrame:
        c = table(self.spark, self.d, "sec_edgar_companyfacts").select(X.ten_digits("cik").alias("cik"), X.iso_day("extract_date").alias("day"), F.regexp_replace(F.btrim("entityname", F.lit(" \t\r\n")), r"\s+", " ").alias("entity_name"))
        return c.where("cik IS NOT NULL").join(self.universe, "cik", "left_semi")

    @cached_property
    def hub_company(self) -> DataFrame:
        return load_hub(self.cover, self.existing("hub_company"), "cik", "hub_company_hk", self.load_ts, "sec_edgar.companyfacts")

    @cached_property
    def hub_concept(self) -> DataFrame:
        return load_hub(self.concepts, self.existing("hub_concept"), "canonical_concept", "hub_concept_hk", self.load_ts, "sec_edgar.companyfacts")

    @cached_property
    def hub_filing(self) -> DataFrame:
        return load_hub(self.concepts, self.existing("hub_filing"), "accession_number", "hub_filing_hk", self.load_ts, "sec_edgar.companyfacts")

    @cached_property
    def link_company_filing(self) -> DataFrame:
        rows = self.concepts.where("accession_number IS NOT NULL")
        return load_link(rows, self.existing("link_company_filing"), ["cik", "accession_number"], "link_company_filing_hk", {"hub_company_hk": "cik", "hub_filing_hk": "accession_number"}, self.load_ts, "sec_edgar.companyfacts")

    @cached_property
    def link_filing_concept_period(self) -> DataFrame:
        rows = self.concepts.where("accession_number IS NOT NULL")
        parents = {"hub_company_hk": "cik", "hub_filing_hk": "accession_number", "hub_concept_hk": "canonical_concept"}
        return load_link(rows, self.existing("link_filing_concept_period"), LINK_PARTS, "link_filing_concept_period_hk", parents, self.load_ts, "sec_edgar.companyfacts", nullable=("period_start_date", "fiscal_year", "fiscal_period"))

    @cached_property
    def sat_filing_metadata(self) -> DataFrame:
        rows = self.concepts.where("accession_number IS NOT NULL").withColumn("hub_filing_hk", key_hash("accession_number"))
        return load_satellite(rows, self.existing("sat_filing_metadata"), "hub_filing_hk", ["form_type", "filed_date"], "sat_filing_metadata_hk", self.load_ts, "sec_edgar.companyfacts", keep=("accession_number",))

    @cached_property
    def sat_company_metadata(self) -> DataFrame:
        """The name on the latest snapshot of each company."""
        last = self.cover.groupBy("cik").agg(F.max(F.struct("day", "entity_name")).alias("x")).select("cik", "x.entity_name").withColumn("hub_company_hk", key_hash("cik"))
        return load_satellite(last, self.existing("sat_company_metadata"), "hub_company_hk", ["entity_name"], "sat_company_metadata_hk", self.load_ts, "sec_edgar.companyfacts", keep=("cik",))

    @cached_property
    def sat_concept_canonical(self) -> DataFrame:
        rows = self.concepts.select("canonical_concept", "concept_name").distinct().withColumns({"hub_concept_hk": key_hash("canonical_concept"), "sub_sequence_key": key_hash("concept_name")})
        return load_satellite(rows, self.existing("sat_concept_canonical"), "hub_concept_hk", ["concept_name"], "sat_concept_canonical_hk", self.load_ts, "sec_edgar.companyfacts", child_key="sub_sequence_key", keep=("canonical_concept",))

    @cached_property
    def collapsed(self) -> DataFrame:
        rows = self.concepts.where("accession_number IS NOT NULL AND value IS NOT NULL").select(*LINK_PARTS, "concept_name", "value", "preference_rank", "collapse_rule").distinct()
        return collapse(rows, LINK_PARTS, "collapse_rule", "preference_rank", "value")

    @cached_property
    def sat_concept_value(self) -> DataFrame:
        rows = self.collapsed.withColumns({"link_filing_concept_period_hk": key_hash(*LINK_PARTS, nullable=(3, 5, 6)), "unit": F.lit("USD")})
        return load_satellite(rows, self.existing("sat_concept_value"), "link_filing_concept_period_hk", ["value", "unit"], "sat_concept_value_hk", self.load_ts, "sec_edgar.companyfacts", keep=tuple(LINK_PARTS))

    @cached_property
    def current_names(self) -> DataFrame:
        return latest_rows(self.sat_company_metadata.select("hub_company_hk", "cik", "load_datetime", "entity_name"), ["hub_company_hk"])

    @cached_property
    def filed(self) -> DataFrame:
        """The filing date now in force per filing (of one load's rivals the latest date)."""
        return latest_rows(self.sat_filing_metadata.select("hub_filing_hk", "load_datetime", "filed_date"), ["hub_filing_hk"]).select("hub_filing_hk", "filed_date")

    @cached_property
    def dated(self) -> DataFrame:
        """Each link with its filing date: one row per link, no as-of dates yet."""
        return self.link_filing_concept_period.drop("load_datetime", "record_source").join(self.filed, "hub_filing_hk").where("filed_date IS NOT NULL")

    @cached_property
    def paired(self) -> DataFrame:
        """The dated links with their company-filing link."""
        return self.dated.join(self.link_company_filing.select("link_company_filing_hk", "hub_company_hk", "hub_filing_hk"), ["hub_company_hk", "hub_filing_hk"])

    @cached_property
    def current_values(self) -> DataFrame:
        """The value now in force per link."""
        values = latest_rows(self.sat_concept_value.select("link_filing_concept_period_hk", "load_datetime", "sat_concept_value_hk", "value", "unit"), ["link_filing_concept_period_hk"])
        return values.withColumnsRenamed({"sat_concept_value_hk": "sat_concept_value_pk", "load_datetime": "sat_concept_value_ldts"})

    @cached_property
    def pit(self) -> DataFrame:
        """Each link at each date it was visible, with the coordinates of its value."""
        links = self.dated.select("link_filing_concept_period_hk", "filed_date").join(self.current_values, "link_filing_concept_period_hk", "left")
        rows = asof_expand(links, AS_OF_DATES, "filed_date")
        return rows.select(key_hash("link_filing_concept_period_hk", "as_of_date").alias("pit_link_filing_concept_period_hk"), "link_filing_concept_period_hk", "as_of_date", "sat_concept_value_pk", "sat_concept_value_ldts")

    @cached_property
    def bridge(self) -> DataFrame:
        """The walk company - filing - concept at each date."""
        rows = asof_expand(self.paired, AS_OF_DATES, "filed_date")
        return rows.select(
            key_hash("hub_company_hk", "link_company_filing_hk", "link_filing_concept_period_hk", "as_of_date").alias("bridge_company_concept_period_hk"),
            "hub_company_hk", "hub_filing_hk", "hub_concept_hk", "link_company_filing_hk", "link_filing_concept_period_hk", "period_end_date", "fiscal_year", "fiscal_period", "as_of_date",
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Annual figures per company, date, year and concept; the year is that of the period's end."""
        return cut(self.panel_rows())

    def panel_rows(self) -> DataFrame:
        """The panel as a plan: everything is joined at the grain of links, which are expanded to dates last."""
        annual = F.col("canonical_concept").isin(*M.POINT_IN_TIME) | M.annual_span()
        names = self.hub_company.select("hub_company_hk").join(self.current_names.select("hub_company_hk", "entity_name"), "hub_company_hk")
        links = self.paired.where("fiscal_period = 'FY' OR fiscal_period IS NULL").where(F.col("canonical_concept").isin(*PANEL_CONCEPTS) & annual)
        rows = links.withColumn("fiscal_year", F.year("period_end_date")).join(self.current_values, "link_filing_concept_period_hk").join(names, "hub_company_hk")
        return asof_expand(rows, AS_OF_DATES, "filed_date").select("cik", "entity_name", "as_of_date", "fiscal_year", "canonical_concept", "accession_number", "period_end_date", "period_start_date", F.col("value").alias("value_numeric"), "unit")

    def deduped(self, *concepts: str, spanned: bool = False) -> DataFrame:
        rows = self.panel.where(F.col("canonical_concept").isin(*concepts))
        if spanned:
            rows = rows.where(M.annual_span())
        return M.latest_filed(rows.drop("period_start_date"), ["cik", "as_of_date", "fiscal_year", "canonical_concept"], ["accession_number", "period_end_date", "value_numeric"])

    def _complete(self, rows: DataFrame) -> DataFrame:
        companies = rows.agg((F.count_distinct("cik") * F.lit(COMPLETE_SHARE)).alias("least_"))
        last = rows.agg(F.max("as_of_date").alias("last_"))
        per_year = rows.join(F.broadcast(last), F.col("as_of_date") == F.col("last_")).groupBy("fiscal_year").agg(F.count_distinct("cik").alias("n"))
        return per_year.join(F.broadcast(companies), F.col("n") >= F.col("least_")).agg(F.max("fiscal_year").alias("latest_complete_fy"))

    @cached_property
    def pl_trend(self) -> DataFrame:
        from pyspark.sql import Window

        rows = self.deduped("revenue", "net_income", spanned=True)
        grown = M.guarded_growth(rows, ["cik", "canonical_concept", "as_of_date"], "fiscal_year", "value_numeric")
        peers = Window.partitionBy("as_of_date", "fiscal_year", "canonical_concept").orderBy(F.col("yoy_pct").desc_nulls_last())
        flagged = grown.withColumn("yoy_rank", F.dense_rank().over(peers)).crossJoin(F.broadcast(self._complete(rows.where("canonical_concept = 'revenue'"))))  # one row
        return cut(flagged.select(
            key_hash("cik", "as_of_date", "fiscal_year", "canonical_concept").alias("mart_pl_trend_hk"), "cik", "entity_name", "as_of_date", "fiscal_year", "canonical_concept", "value_numeric", "unit", "period_end_date",
            F.round("yoy_pct", 6).alias("yoy_pct"), F.col("yoy_rank").cast("int").alias("yoy_rank"), F.coalesce(F.col("fiscal_year") == F.col("latest_complete_fy"), F.lit(False)).alias("is_latest_complete_fy"),
        ))

    @cached_property
    def peer_benchmark(self) -> DataFrame:
        rows = self.deduped("revenue", "net_income", "assets").join(self.sectors, "cik", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.lit("UNCATEGORIZED")) for c in ("gics_sector", "gics_industry_group")})
        p = M.peer_statistics(rows, ["as_of_date", "fiscal_year", "canonical_concept", "gics_sector"], "value_numeric")
        return p.select(
            key_hash("cik", "as_of_date", "fiscal_year", "canonical_concept").alias("mart_peer_benchmark_hk"), "cik", "entity_name", "as_of_date", "fiscal_year", "canonical_concept", "gics_sector", "gics_industry_group", "value_numeric", "unit",
            "peer_count", F.round("peer_mean", 0).alias("peer_mean"), "peer_median", F.round("peer_stddev", 0).alias("peer_stddev"), "peer_min", "peer_max", "peer_rank", F.round("peer_percentile", 12).alias("peer_percentile"), "period_end_date",
        )

    @cached_property
    def financial_health(self) -> DataFrame:
        rows = self.deduped(*PANEL_CONCEPTS)
        wide = M.pivot_values(rows, ["cik", "entity_name", "as_of_date", "fiscal_year"], "canonical_concept", "value_numeric", PANEL_CONCEPTS, {"period_end_date": F.max("period_end_date")})
        full = M.with_ratios(M.derive_missing(wide)).crossJoin(F.broadcast(self._complete(rows.where("canonical_concept = 'revenue'"))))  # one row
        money = ["revenue", "gross_profit", "operating_income", "net_income", "assets", "liabilities", "stockholders_equity", "cash_and_equivalents", "operating_cash_flow"]
        return full.select(
            key_hash("cik", "as_of_date", "fiscal_year").alias("mart_financial_health_hk"), "cik", "entity_name", "as_of_date", "fiscal_year", "period_end_date",
            *[F.col(c).cast("decimal(28,2)").alias(c) for c in money], *[F.round(r, 6).alias(r) for r in M.RATIOS], F.coalesce(F.col("fiscal_year") == F.col("latest_complete_fy"), F.lit(False)).alias("is_latest_complete_fy"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Three years ahead of each company's revenue at the latest date."""
        revenue = self.pl_trend.where("canonical_concept = 'revenue'")
        last = revenue.agg(F.max("as_of_date").alias("last_"))
        rows = revenue.join(F.broadcast(last), F.col("as_of_date") == F.col("last_"))
        return forecast(rows, "cik", "fiscal_year", "value_numeric").crossJoin(F.broadcast(last)).withColumnsRenamed({"key": "cik", "last_": "as_of_date"})

    @cached_property
    def growth_forecast(self) -> DataFrame:
        """The historical leg and, aligned with typed NULLs, the forecast leg."""
        past = self.pl_trend.where("canonical_concept = 'revenue'").select("cik", "entity_name", "as_of_date", "fiscal_year", "canonical_concept", "value_numeric").withColumn("row_kind", F.lit("historical"))
        names = self.current_names.select("cik", "entity_name")
        ahead = self.forecasts.join(names, "cik").withColumn("canonical_concept", F.lit("revenue")).withColumn("row_kind", F.lit("forecast")).withColumnRenamed("forecast_year", "fiscal_year")
        both = past.unionByName(ahead, allowMissingColumns=True)
        return both.select(key_hash("cik", "canonical_concept", "fiscal_year", "as_of_date", "row_kind").alias("mart_growth_forecast_hk"), "*")


def _query(name: str, *drop: str, **change) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = getattr(Build(spark, d), name)
        return df.withColumn("load_datetime", ts_text("load_datetime")) if "load_datetime" in df.columns else df

    return run


CHAIN_SQL = r"""
WITH doc AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, TRY_CAST(extract_date AS DATE) AS extract_date, CAST(json_text AS JSON) AS j FROM sec_edgar_companyfacts_raw WHERE json_valid(json_text)),
tag AS (SELECT cik, extract_date, t.key AS concept_name, json_extract(t.value, '$.units.USD') AS a FROM doc, json_each(j, '$.facts."us-gaap"') t WHERE json_type(j, '$.facts."us-gaap"') = 'OBJECT' AND json_type(t.value) = 'OBJECT'),
entry AS (SELECT cik, extract_date, concept_name, t.value AS e FROM tag, json_each(a) t WHERE json_type(a) = 'ARRAY' UNION ALL SELECT cik, extract_date, concept_name, a FROM tag WHERE json_type(a) = 'OBJECT'),
facts AS (SELECT DISTINCT cik, extract_date, concept_name, json_extract_string(e, '$.accn') AS accession_number, json_extract_string(e, '$.form') AS form_type, TRY_CAST(json_extract_string(e, '$.filed') AS DATE) AS filed_date,
    TRY_CAST(json_extract_string(e, '$.start') AS DATE) AS period_start_date, TRY_CAST(json_extract_string(e, '$.end') AS DATE) AS period_end_date, TRY_CAST(json_extract_string(e, '$.fy') AS INTEGER) AS fiscal_year,
    json_extract_string(e, '$.fp') AS fiscal_period, TRY_CAST(json_extract_string(e, '$.val') AS DECIMAL(28,2)) AS value FROM entry WHERE json_type(e) = 'OBJECT'),
universe AS (SELECT DISTINCT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik FROM sp100_company_sector WHERE regexp_extract(cik, '(\d+)', 1) <> ''),
sectors AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, min(trim(gics_sector)) AS gics_sector, min(trim(gics_industry_group)) AS gics_industry_group FROM sp100_company_sector WHERE regexp_extract(cik, '(\d+)', 1) <> '' GROUP BY 1),
pref AS (SELECT DISTINCT * FROM canonical_concept_tag_preference),
concepts AS (SELECT f.*, p.canonical_concept, p.preference_rank, p.collapse_rule FROM facts f JOIN pref p ON f.concept_name = p.concept_name WHERE f.cik IN (SELECT cik FROM universe)),
filed_concepts AS (SELECT * FROM concepts WHERE accession_number IS NOT NULL),
cover AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, replace(regexp_extract(trim(extract_date), '^(\d{4}-?\d{2}-?\d{2})', 1), '-', '') AS day,
    regexp_replace(trim(entityname, E' \t\r\n'), '\s+', ' ', 'g') AS entity_name FROM sec_edgar_companyfacts WHERE lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') IN (SELECT cik FROM universe)),
hub_company AS (SELECT DISTINCT upper(sha256(cik)) AS hub_company_hk, cik, '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM cover),
hub_concept AS (SELECT DISTINCT upper(sha256(canonical_concept)) AS hub_concept_hk, canonical_concept, '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM concepts),
hub_filing AS (SELECT DISTINCT upper(sha256(accession_number)) AS hub_filing_hk, accession_number, '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM filed_concepts),
link_company_filing AS (SELECT DISTINCT upper(sha256(cik || '||' || accession_number)) AS link_company_filing_hk, upper(sha256(cik)) AS hub_company_hk, upper(sha256(accession_number)) AS hub_filing_hk, cik, accession_number,
    '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM filed_concepts),
lfcp AS (SELECT DISTINCT upper(sha256(cik || '||' || accession_number || '||' || canonical_concept || '||' || coalesce(period_start_date::VARCHAR, '^^') || '||' || period_end_date::VARCHAR || '||' || coalesce(fiscal_year::VARCHAR, '^^') || '||' || coalesce(fiscal_period, '^^'))) AS link_filing_concept_period_hk,
    upper(sha256(cik)) AS hub_company_hk, upper(sha256(accession_number)) AS hub_filing_hk, upper(sha256(canonical_concept)) AS hub_concept_hk, cik, accession_number, canonical_concept, period_start_date, period_end_date, fiscal_year, fiscal_period,
    '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM filed_concepts),
sat_filing AS (SELECT DISTINCT upper(sha256(upper(sha256(accession_number)) || '||' || '2026-06-01 00:00:00.000000')) AS sat_filing_metadata_hk, upper(sha256(accession_number)) AS hub_filing_hk, accession_number, form_type, filed_date,
    upper(sha256(coalesce(form_type, '^^') || '||' || coalesce(filed_date::VARCHAR, '^^'))) AS hashdiff, '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM filed_concepts),
last_name AS (SELECT cik, (max({'d': day, 'n': entity_name})).n AS entity_name FROM cover GROUP BY 1),
sat_company AS (SELECT upper(sha256(upper(sha256(cik)) || '||' || '2026-06-01 00:00:00.000000')) AS sat_company_metadata_hk, upper(sha256(cik)) AS hub_company_hk, cik, entity_name, upper(sha256(coalesce(entity_name, '^^'))) AS hashdiff,
    '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM last_name),
sat_canonical AS (SELECT DISTINCT upper(sha256(upper(sha256(canonical_concept)) || '||' || upper(sha256(concept_name)) || '||' || '2026-06-01 00:00:00.000000')) AS sat_concept_canonical_hk, upper(sha256(canonical_concept)) AS hub_concept_hk, upper(sha256(concept_name)) AS sub_sequence_key,
    canonical_concept, concept_name, upper(sha256(concept_name)) AS hashdiff, '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM concepts),
rivals AS (SELECT DISTINCT cik, accession_number, canonical_concept, period_start_date, period_end_date, fiscal_year, fiscal_period, concept_name, value, preference_rank, collapse_rule FROM filed_concepts WHERE value IS NOT NULL),
collapsed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, accession_number, canonical_concept, period_start_date, period_end_date, fiscal_year, fiscal_period
    ORDER BY CASE WHEN collapse_rule = 'preference_rank_asc' THEN preference_rank END ASC NULLS LAST, CASE WHEN collapse_rule <> 'preference_rank_asc' THEN value END DESC NULLS LAST, preference_rank, value DESC, concept_name) AS rn FROM rivals) WHERE rn = 1),
sat_value0 AS (SELECT upper(sha256(cik || '||' || accession_number || '||' || canonical_concept || '||' || coalesce(period_start_date::VARCHAR, '^^') || '||' || period_end_date::VARCHAR || '||' || coalesce(fiscal_year::VARCHAR, '^^') || '||' || coalesce(fiscal_period, '^^'))) AS link_filing_concept_period_hk,
    cik, accession_number, canonical_concept, period_start_date, period_end_date, fiscal_year, fiscal_period, value, 'USD' AS unit FROM collapsed),
sat_value AS (SELECT upper(sha256(link_filing_concept_period_hk || '||' || '2026-06-01 00:00:00.000000')) AS sat_concept_value_hk, *, upper(sha256(value::VARCHAR || '||' || unit)) AS hashdiff, '2026-06-01 00:00:00.000000' AS load_datetime, 'sec_edgar.companyfacts' AS record_source FROM sat_value0),
filed AS (SELECT hub_filing_hk, max(filed_date) AS filed_date FROM sat_filing GROUP BY 1),
dates AS (SELECT unnest([@DATES@]) AS as_of_date),
visible AS (SELECT l.*, d.as_of_date FROM lfcp l JOIN filed f ON l.hub_filing_hk = f.hub_filing_hk JOIN dates d ON f.filed_date <= d.as_of_date),
pit AS (SELECT upper(sha256(v.link_filing_concept_period_hk || '||' || as_of_date::VARCHAR)) AS pit_link_filing_concept_period_hk, v.link_filing_concept_period_hk, as_of_date, s.sat_concept_value_hk AS sat_concept_value_pk FROM visible v LEFT JOIN sat_value s ON v.link_filing_concept_period_hk = s.link_filing_concept_period_hk),
bridge AS (SELECT upper(sha256(v.hub_company_hk || '||' || c.link_company_filing_hk || '||' || v.link_filing_concept_period_hk || '||' || as_of_date::VARCHAR)) AS bridge_company_concept_period_hk, v.hub_company_hk, v.hub_filing_hk, v.hub_concept_hk, c.link_company_filing_hk,
    v.link_filing_concept_period_hk, period_end_date, fiscal_year, fiscal_period, as_of_date FROM visible v JOIN link_company_filing c ON v.hub_company_hk = c.hub_company_hk AND v.hub_filing_hk = c.hub_filing_hk),
panel AS (SELECT h.cik, n.entity_name, b.as_of_date, year(s.period_end_date)::INTEGER AS fiscal_year, s.canonical_concept, s.accession_number, s.period_end_date, s.period_start_date, s.value AS value_numeric, s.unit,
    coalesce(date_diff('day', s.period_start_date, s.period_end_date) BETWEEN 350 AND 380, false) AS annual
  FROM bridge b JOIN pit p ON b.link_filing_concept_period_hk = p.link_filing_concept_period_hk AND b.as_of_date = p.as_of_date AND p.sat_concept_value_pk IS NOT NULL
  JOIN sat_value s ON s.link_filing_concept_period_hk = b.link_filing_concept_period_hk JOIN hub_company h ON h.hub_company_hk = b.hub_company_hk JOIN sat_company n ON n.hub_company_hk = b.hub_company_hk WHERE b.fiscal_period = 'FY' OR b.fiscal_period IS NULL),
kept AS (SELECT * FROM panel WHERE annual OR canonical_concept IN ('assets', 'liabilities', 'liabilities_and_se', 'stockholders_equity', 'stockholders_equity_including_nci', 'minority_interest', 'cash_and_equivalents')),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, as_of_date, fiscal_year, canonical_concept ORDER BY accession_number DESC NULLS LAST, period_end_date DESC NULLS LAST, value_numeric DESC NULLS LAST) AS rn FROM kept) WHERE rn = 1),
trend0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, as_of_date, fiscal_year, canonical_concept ORDER BY accession_number DESC, period_end_date DESC, value_numeric DESC) AS rn FROM panel WHERE annual AND canonical_concept IN ('revenue', 'net_income')) WHERE rn = 1),
lagged AS (SELECT *, lag(fiscal_year) OVER w AS last_year, lag(CAST(value_numeric AS DOUBLE)) OVER w AS last_value FROM trend0 WINDOW w AS (PARTITION BY cik, canonical_concept, as_of_date ORDER BY fiscal_year)),
grown AS (SELECT *, CASE WHEN last_year = fiscal_year - 1 THEN (CAST(value_numeric AS DOUBLE) - last_value) / nullif(abs(last_value), 0) END AS yoy FROM lagged),
complete AS (SELECT max(fiscal_year) AS fy FROM (SELECT fiscal_year, count(DISTINCT cik) AS n FROM trend0 WHERE canonical_concept = 'revenue' AND as_of_date = (SELECT max(as_of_date) FROM trend0 WHERE canonical_concept = 'revenue') GROUP BY 1)
    WHERE n >= (SELECT 0.5 * count(DISTINCT cik) FROM trend0 WHERE canonical_concept = 'revenue')),
pl_trend AS (SELECT upper(sha256(cik || '||' || as_of_date::VARCHAR || '||' || fiscal_year::VARCHAR || '||' || canonical_concept)) AS mart_pl_trend_hk, cik, entity_name, as_of_date, fiscal_year, canonical_concept, value_numeric, unit, period_end_date, round(yoy, 6) AS yoy_pct,
    CAST(dense_rank() OVER (PARTITION BY as_of_date, fiscal_year, canonical_concept ORDER BY yoy DESC NULLS LAST) AS INTEGER) AS yoy_rank, coalesce(fiscal_year = fy, false) AS is_latest_complete_fy FROM grown, complete),
peer0 AS (SELECT o.*, coalesce(s.gics_sector, 'UNCATEGORIZED') AS gics_sector, coalesce(s.gics_industry_group, 'UNCATEGORIZED') AS gics_industry_group FROM one o LEFT JOIN sectors s ON o.cik = s.cik WHERE canonical_concept IN ('revenue', 'net_income', 'assets')),
stats AS (SELECT as_of_date, fiscal_year, canonical_concept, gics_sector, count(*) AS peer_count, round(avg(CAST(value_numeric AS DOUBLE)), 0) AS peer_mean, quantile_disc(value_numeric, 0.5) AS peer_median, round(stddev_samp(CAST(value_numeric AS DOUBLE)), 0) AS peer_stddev, min(value_numeric) AS peer_min, max(value_numeric) AS peer_max FROM peer0 GROUP BY 1, 2, 3, 4),
peer AS (SELECT upper(sha256(cik || '||' || as_of_date::VARCHAR || '||' || fiscal_year::VARCHAR || '||' || canonical_concept)) AS mart_peer_benchmark_hk, cik, entity_name, as_of_date, fiscal_year, canonical_concept, gics_sector, gics_industry_group, value_numeric, unit, peer_count, peer_mean, peer_median, peer_stddev, peer_min, peer_max,
    CAST(rank() OVER (PARTITION BY as_of_date, fiscal_year, canonical_concept, gics_sector ORDER BY value_numeric DESC) AS INTEGER) AS peer_rank, round(cume_dist() OVER (PARTITION BY as_of_date, fiscal_year, canonical_concept, gics_sector ORDER BY value_numeric), 12) AS peer_percentile, period_end_date
  FROM peer0 JOIN stats USING (as_of_date, fiscal_year, canonical_concept, gics_sector)),
wide AS (SELECT cik, entity_name, as_of_date, fiscal_year, max(period_end_date) AS period_end_date, @PIVOT@ FROM one GROUP BY 1, 2, 3, 4),
derived AS (SELECT cik, entity_name, as_of_date, fiscal_year, period_end_date, revenue, coalesce(gross_profit, revenue - cost_of_revenue) AS gross_profit, operating_income, net_income, assets,
    coalesce(liabilities, liabilities_and_se - coalesce(stockholders_equity, stockholders_equity_including_nci - minority_interest)) AS liabilities, coalesce(stockholders_equity, stockholders_equity_including_nci - minority_interest) AS stockholders_equity, cash_and_equivalents, operating_cash_flow FROM wide),
complete_all AS (SELECT max(fiscal_year) AS fy FROM (SELECT fiscal_year, count(DISTINCT cik) AS n FROM one WHERE canonical_concept = 'revenue' AND as_of_date = (SELECT max(as_of_date) FROM one WHERE canonical_concept = 'revenue') GROUP BY 1) WHERE n >= (SELECT 0.5 * count(DISTINCT cik) FROM one WHERE canonical_concept = 'revenue')),
health AS (SELECT upper(sha256(cik || '||' || as_of_date::VARCHAR || '||' || fiscal_year::VARCHAR)) AS mart_financial_health_hk, cik, entity_name, as_of_date, fiscal_year, period_end_date, @MONEY@, @RATIOS@, coalesce(fiscal_year = fy, false) AS is_latest_complete_fy FROM derived, complete_all)
"""

_MONEY = ["revenue", "gross_profit", "operating_income", "net_income", "assets", "liabilities", "stockholders_equity", "cash_and_equivalents", "operating_cash_flow"]
CHAIN_SQL = (
    CHAIN_SQL.replace("@DATES@", ", ".join(f"DATE '{x}'" for x in AS_OF_DATES))
    .replace("@PIVOT@", ", ".join(f"max(CASE WHEN canonical_concept = '{c}' THEN value_numeric END) AS {c}" for c in PANEL_CONCEPTS))
    .replace("@MONEY@", ", ".join(f"CAST({c} AS DECIMAL(28,2)) AS {c}" for c in _MONEY))
    .replace("@RATIOS@", ", ".join(f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6) AS {n}" for n, (a, b) in M.RATIOS.items()))
)

_TABLES = {
    "d1_facts": ("facts", "facts"),
    "d2_concepts_canonical": ("concepts", "concepts"),
    "d3_hub_company": ("hub_company", "hub_company"),
    "d4_hub_concept": ("hub_concept", "hub_concept"),
    "d5_hub_filing": ("hub_filing", "hub_filing"),
    "d6_link_company_filing": ("link_company_filing", "link_company_filing"),
    "d7_link_filing_concept_period": ("link_filing_concept_period", "lfcp"),
    "d8_sat_filing_metadata": ("sat_filing_metadata", "sat_filing"),
    "d9_sat_company_metadata": ("sat_company_metadata", "sat_company"),
    "d10_sat_concept_canonical": ("sat_concept_canonical", "sat_canonical"),
    "d11_sat_concept_value": ("sat_concept_value", "sat_value"),
    "d14_bridge_company_concept_period": ("bridge", "bridge"),
    "d15_mart_pl_trend": ("pl_trend", "pl_trend"),
    "d16_mart_peer_benchmark": ("peer_benchmark", "peer"),
    "d17_mart_financial_health": ("financial_health", "health"),
}


def d12_as_of_dates(spark: SparkSession, d: str) -> DataFrame:
    """The as-of spine: literal dates and their years."""
    return spark.createDataFrame([(x,) for x in AS_OF_DATES], "x string").select(F.to_date("x").alias("as_of_date"), F.year(F.to_date("x")).alias("as_of_year"))


def d13_pit(spark: SparkSession, d: str) -> DataFrame:
    return Build(spark, d).pit.withColumn("sat_concept_value_ldts", ts_text("sat_concept_value_ldts"))


def d18_growth_forecast(spark: SparkSession, d: str) -> DataFrame:
    return Build(spark, d).growth_forecast


def d18_growth_history(spark: SparkSession, d: str) -> DataFrame:
    return Build(spark, d).growth_forecast.where("row_kind = 'historical'").select("mart_growth_forecast_hk", "cik", "entity_name", "as_of_date", "fiscal_year", "canonical_concept", "value_numeric", "row_kind")


def d19_forecast(spark: SparkSession, d: str) -> DataFrame:
    return Build(spark, d).forecasts


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(attr) for n, (attr, _) in _TABLES.items()} | {
    "d12_dim_as_of_dates": d12_as_of_dates,
    "d13_pit_link_filing_concept_period": d13_pit,
    "d18_mart_growth_forecast": d18_growth_forecast,
    "d18_growth_history": d18_growth_history,
    "d19_forecast": d19_forecast,
}

ORACLE_SQL: dict[str, str] = {n: CHAIN_SQL + f"SELECT * FROM {cte}" for n, (_, cte) in _TABLES.items()} | {
    "d12_dim_as_of_dates": CHAIN_SQL + "SELECT as_of_date, CAST(year(as_of_date) AS INTEGER) AS as_of_year FROM dates",
    "d13_pit_link_filing_concept_period": CHAIN_SQL + "SELECT pit.*, s.load_datetime AS sat_concept_value_ldts FROM pit LEFT JOIN sat_value s ON s.sat_concept_value_hk = pit.sat_concept_value_pk",
    "d18_growth_history": CHAIN_SQL + "SELECT upper(sha256(cik || '||' || canonical_concept || '||' || fiscal_year::VARCHAR || '||' || as_of_date::VARCHAR || '||historical')) AS mart_growth_forecast_hk, cik, entity_name, as_of_date, fiscal_year, canonical_concept, value_numeric, 'historical' AS row_kind FROM pl_trend WHERE canonical_concept = 'revenue'",
}
