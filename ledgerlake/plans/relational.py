"""Relational constructs of the inventory on the star-schema and filing tables.

Each entry is a query and its SQL under one name; the prefix is the inventory group (scans and
sinks s, predicates pred, joins j, aggregations a, windows w, top-k and set operations o, scalar
functions f).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.functions.hashing import hashdiff, key_hash
from ledgerlake.operators.marts import guarded_growth, latest_complete_year, peer_statistics
from ledgerlake.operators.vault import asof_expand, collapse, latest_rows
from ledgerlake.session import file_system, scratch
from ledgerlake.sources.bronze import bronze_checks, write_documents, write_forecasts
from ledgerlake.sources.tables import read_cover, read_documents, read_forecasts, read_seed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    """Register a query over a table reader together with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, d: f(lambda t: table(spark, d, t))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


def day(c: str) -> F.Column:
    return F.to_date(c)


# --- scans and sinks


@query("s3_key_padding", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))


@query("s9_literal_rows", "SELECT * FROM (VALUES ('revenue', 1), ('net_income', 2), ('assets', 3)) AS v(concept, ordinal)")
def _(t):
    return t("region").sparkSession.sql("SELECT * FROM VALUES ('revenue', 1), ('net_income', 2), ('assets', 3) AS v(concept, ordinal)")


@query("s10_staging_projection", "SELECT o_orderkey AS filing_key, CAST(o_orderdate AS DATE) AS filed_date, o_orderpriority AS form_type FROM orders")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("filing_key"), day("o_orderdate").alias("filed_date"), F.col("o_orderpriority").alias("form_type"))


def s6_partition_pruning(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned Parquet sink and a scan that reads the wanted folders only."""
    at = f"{scratch(spark, 'filings')}/table"
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("filed_year"), F.col("o_orderstatus").alias("status"))
    o.repartition("filed_year").write.partitionBy("filed_year", "status").parquet(at)
    back = spark.read.schema("o_orderkey long, o_totalprice double, filed_year string, status string").parquet(at)
    return back.where("filed_year = '1997'").groupBy("filed_year", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))


QUERIES["s6_partition_pruning"] = s6_partition_pruning
ORACLE_SQL["s6_partition_pruning"] = "SELECT '1997' AS filed_year, o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 2"


def s12_incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """Source-filtered append; the second load of the same batch adds nothing."""
    from ledgerlake.operators.vault import load_hub
    from ledgerlake.plans.warehouse import LOAD_TS

    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cik"), "o_orderdate")
    at = f"{scratch(spark, 'hub')}/table"
    for batch in (rows.where("o_orderdate < '1998-01-01'"), rows, rows):
        old = spark.read.parquet(at) if batch is not None and _exists(spark, at) else None
        load_hub(batch, old, "cik", "hub_hk", LOAD_TS, "orders").write.mode("append").parquet(at)
    return spark.read.parquet(at).select("hub_hk", "cik")


#: One document a company and snapshot: of several the greatest text.
_DOCS_SQL = r"WITH doc AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, extract_date, max(json_text) AS t FROM sec_edgar_companyfacts_raw WHERE json_text <> '' AND regexp_extract(cik, '(\d+)', 1) <> '' AND extract_date IS NOT NULL GROUP BY 1, 2) "


def _bronze(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The raw documents laid out as files, and where."""
    raw = table(spark, d, "sec_edgar_companyfacts_raw").where("json_text <> '' AND extract_date IS NOT NULL").select(X.ten_digits("cik").alias("cik"), "extract_date", "json_text")
    docs = raw.where("cik IS NOT NULL").groupBy("cik", "extract_date").agg(F.max("json_text").alias("json_text"))
    at = f"{scratch(spark, 'bronze')}/raw"
    write_documents(docs, at)
    return at, docs


def s5_text_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written to ``extract_date=/cik=`` folders and read back whole."""
    back = read_documents(spark, _bronze(spark, d)[0])
    return back.select("cik", F.coalesce("extract_date", F.lit("")).alias("extract_date"), F.length(F.regexp_replace("json_text", r"\n\z", "")).alias("chars"))


def s15_object_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks over the files' metadata: count, companies, dates, sizes, contents under several companies."""
    at, docs = _bronze(spark, d)
    return bronze_checks(spark, at, docs.count()).where("check_name <> '2_distinct_cik'")


QUERIES["s5_text_scan"] = s5_text_scan
ORACLE_SQL["s5_text_scan"] = _DOCS_SQL + r"SELECT cik, extract_date, CAST(length(t) AS INTEGER) AS chars FROM doc"
QUERIES["s15_object_checks"] = s15_object_checks
ORACLE_SQL["s15_object_checks"] = _DOCS_SQL + """SELECT *, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS result FROM (
    SELECT '1_file_count' AS check_name, CAST(count(*) AS VARCHAR) AS expected, CAST(count(*) AS VARCHAR) AS actual FROM doc
    UNION ALL SELECT '3_dates_valid', '0', CAST(count(*) FILTER (WHERE TRY_CAST(extract_date AS DATE) IS NULL) AS VARCHAR) FROM doc UNION ALL SELECT '4_size_positive', '0', '0'
    UNION ALL SELECT '5_no_shared_content', '0', CAST(count(*) AS VARCHAR) FROM (SELECT 1 FROM doc GROUP BY t HAVING count(DISTINCT cik) > 1))"""


def s4_json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Typed cover fields by a FAILFAST scan of JSON documents, one a line."""
    at = f"{scratch(spark, 'cover')}/json"
    c = table(spark, d, "sec_edgar_companyfacts").where("cik IS NOT NULL")
    c.select(F.to_json(F.struct("cik", F.col("entityname").alias("entityName")))).write.text(at)
    return read_cover(spark, at, lines=True).select("cik", "entityname").distinct()


QUERIES["s4_json_scan"] = s4_json_scan
ORACLE_SQL["s4_json_scan"] = "SELECT DISTINCT cik, entityname FROM sec_edgar_companyfacts WHERE cik IS NOT NULL"


def s8_csv_seed(spark: SparkSession, d: str) -> DataFrame:
    """A CSV seed with header, quotes and a pinned schema."""
    at = f"{scratch(spark, 'seed')}/csv"
    columns = ["cik", "ticker", "entity_name", "gics_sector", "gics_industry_group"]
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, d, "sp100_company_sector").select(*columns).where("cik IS NOT NULL").write.options(**keep).csv(at, header=True, quote='"', escape='"', quoteAll=True)
    return read_seed(spark, at, ", ".join(f"{c} string" for c in columns)).distinct()


QUERIES["s8_csv_seed"] = s8_csv_seed
ORACLE_SQL["s8_csv_seed"] = "SELECT DISTINCT cik, nullif(ticker, '') AS ticker, nullif(entity_name, '') AS entity_name, nullif(gics_sector, '') AS gics_sector, nullif(gics_industry_group, '') AS gics_industry_group FROM sp100_company_sector WHERE cik IS NOT NULL"


def s13_partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """Figures written by concept and date, partition columns read back as text."""
    at = f"{scratch(spark, 'surface')}/parquet"
    m = table(spark, d, "mart_financial_health").where("revenue IS NOT NULL AND as_of_date IS NOT NULL")
    write_forecasts(m.select("cik", F.col("fiscal_year").alias("forecast_year"), F.col("revenue").alias("forecast_value"), F.lit("revenue").alias("canonical_concept"), F.col("as_of_date").cast("string").alias("as_of_date")), at)
    back = read_forecasts(spark, at, "cik string, forecast_year int, forecast_value decimal(28,2), canonical_concept string, as_of_date string")
    return back.groupBy("canonical_concept", "as_of_date").agg(F.count(F.lit(1)).alias("n"), F.sum("forecast_value").cast("double").alias("total"))


QUERIES["s13_partitioned_sink"] = s13_partitioned_sink
ORACLE_SQL["s13_partitioned_sink"] = "SELECT 'revenue' AS canonical_concept, CAST(as_of_date AS VARCHAR) AS as_of_date, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS total FROM mart_financial_health WHERE revenue IS NOT NULL AND as_of_date IS NOT NULL GROUP BY 2"


def _exists(spark: SparkSession, path: str) -> bool:
    fs, make = file_system(spark, path)
    return fs.exists(make(path))


QUERIES["s12_incremental_append"] = s12_incremental_append
ORACLE_SQL["s12_incremental_append"] = "SELECT DISTINCT upper(sha256(CAST(o_custkey AS VARCHAR))) AS hub_hk, CAST(o_custkey AS VARCHAR) AS cik FROM orders"

# --- projections and predicates


@query("pred01_universe_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return t("orders").select("o_orderkey", "o_custkey").join(t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


@query("pred02_in_list", "SELECT p_partkey, p_type FROM part WHERE p_size IN (1, 5, 9, 14, 23)")
def _(t):
    return t("part").where(F.col("p_size").isin(1, 5, 9, 14, 23)).select("p_partkey", "p_type")


@query("pred03_fy_or_null", "SELECT DISTINCT sat_concept_value_hk, fiscal_period FROM sat_concept_value WHERE fiscal_period = 'FY' OR fiscal_period IS NULL")
def _(t):
    return t("sat_concept_value").where("fiscal_period = 'FY' OR fiscal_period IS NULL").select("sat_concept_value_hk", "fiscal_period").distinct()


@query("pred04_period_span", "SELECT DISTINCT sat_concept_value_hk FROM sat_concept_value WHERE date_diff('day', period_start_date, period_end_date) BETWEEN 350 AND 380")
def _(t):
    return t("sat_concept_value").where(F.datediff("period_end_date", "period_start_date").between(350, 380)).select("sat_concept_value_hk").distinct()


@query(
    "pred05_conditional_span",
    "SELECT canonical_concept, count(*) AS n FROM sat_concept_value WHERE canonical_concept IN ('assets', 'liabilities', 'cash_and_equivalents') OR date_diff('day', period_start_date, period_end_date) BETWEEN 350 AND 380 GROUP BY 1",
)
def _(t):
    stock = F.col("canonical_concept").isin("assets", "liabilities", "cash_and_equivalents")
    return t("sat_concept_value").where(stock | F.datediff("period_end_date", "period_start_date").between(350, 380)).groupBy("canonical_concept").agg(F.count(F.lit(1)).alias("n"))


@query("pred06_null_guards", "SELECT count(*) AS n FROM sat_concept_value WHERE accession_number IS NOT NULL AND value IS NOT NULL AND unit IS NOT NULL")
def _(t):
    return t("sat_concept_value").where("accession_number IS NOT NULL AND value IS NOT NULL AND unit IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))


@query("pred07_scalar_subquery", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def _(t):
    o = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return o.join(F.broadcast(o.agg(F.max("y").alias("y"))), "y").select("o_orderkey")  # one row


@query("pred08_visibility", "SELECT o_orderkey, a.d AS as_of_date FROM orders JOIN (VALUES (DATE '1996-12-31'), (DATE '1998-12-31'), (DATE '2000-12-31')) AS a(d) ON CAST(o_orderdate AS DATE) <= a.d")
def _(t):
    return asof_expand(t("orders").select("o_orderkey", day("o_orderdate").alias("filed")), ["1996-12-31", "1998-12-31", "2000-12-31"], "filed").select("o_orderkey", "as_of_date")


@query("pred09_searched_case", "SELECT CASE WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.03 THEN 'MID' ELSE 'LOW' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    band = F.when(F.col("l_discount") >= 0.07, "HIGH").when(F.col("l_discount") >= 0.03, "MID").otherwise("LOW")
    return t("lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("pred10_range_checks", "SELECT count(*) FILTER (WHERE NOT (gross_margin BETWEEN -10 AND 1)) AS outside, count(*) FILTER (WHERE isnan(gross_margin) OR isinf(gross_margin)) AS odd FROM mart_financial_health")
def _(t):
    g = F.col("gross_margin")
    return t("mart_financial_health").agg(F.count_if(~g.between(-10, 1)).alias("outside"), F.count_if(F.isnan(g) | (F.abs(g) == float("inf"))).alias("odd"))


@query(
    "pred11_tags_in_one_pass",
    "SELECT p.canonical_concept, count(*) AS n FROM sat_concept_value s JOIN (SELECT DISTINCT canonical_concept, concept_name FROM canonical_concept_tag_preference) p ON s.concept_name = p.concept_name GROUP BY 1",
)
def _(t):
    listed = t("canonical_concept_tag_preference").select("canonical_concept", "concept_name").distinct()
    return t("sat_concept_value").select("concept_name").join(listed, "concept_name").groupBy("canonical_concept").agg(F.count(F.lit(1)).alias("n"))


# --- joins


@query("j01_inner_single_key", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query(
    "j02_inner_composite_key",
    "SELECT count(*) AS n FROM (SELECT DISTINCT cik, accession_number FROM link_company_filing) l JOIN (SELECT DISTINCT cik, accession_number FROM sat_concept_value) s ON l.cik = s.cik AND l.accession_number = s.accession_number",
)
def _(t):
    k = ["cik", "accession_number"]
    return t("link_company_filing").select(*k).distinct().join(t("sat_concept_value").select(*k).distinct(), k).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j03_join_chain",
    """SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def _(t):
    by_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("amount"))  # before the joins, not after
    rows = by_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.sum("amount").cast("double").alias("amount"))


@query(
    "j04_left_default",
    """SELECT m.cik, coalesce(s.sector, 'UNCATEGORIZED') AS sector FROM (SELECT DISTINCT cik FROM mart_financial_health) m
    LEFT JOIN (SELECT lpad(trim(cik), 10, '0') AS cik, min(trim(gics_sector)) AS sector FROM sp100_company_sector GROUP BY 1) s ON m.cik = s.cik""",
)
def _(t):
    s = t("sp100_company_sector").groupBy(F.lpad(F.trim("cik"), 10, "0").alias("cik")).agg(F.min(F.trim("gics_sector")).alias("sector"))
    return t("mart_financial_health").select("cik").distinct().join(s, "cik", "left").withColumn("sector", F.coalesce("sector", F.lit("UNCATEGORIZED")))


@query("j05_left_extra_predicate", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND year(o_orderdate) = 1999 GROUP BY 1")
def _(t):
    o = t("orders").where(F.year("o_orderdate") == 1999).select("o_custkey", "o_orderkey")
    return t("customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(
    "j06_three_way_outer",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS k, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    s AS (SELECT s_suppkey AS k, s_name FROM supplier) SELECT coalesce(a.k, r.k, s.k) AS k, a, r, s_name FROM a FULL JOIN r ON a.k = r.k FULL JOIN s ON coalesce(a.k, r.k) = s.k""",
)
def _(t):
    def part(flag: str, name: str) -> DataFrame:
        return t("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias(name))

    return part("A", "a").join(part("R", "r"), "k", "full").join(t("supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", "full")


@query("j07_scalar_cross", "SELECT n_name, (SELECT count(*) FROM customer) AS customers FROM nation")
def _(t):
    return t("nation").select("n_name").crossJoin(F.broadcast(t("customer").agg(F.count(F.lit(1)).alias("customers"))))  # one row


@query("j09_anti_hash", "SELECT DISTINCT upper(sha256(accession_number)) AS hk, accession_number FROM sat_filing_metadata WHERE upper(sha256(accession_number)) NOT IN (SELECT hub_filing_hk FROM hub_filing)")
def _(t):
    rows = t("sat_filing_metadata").where("accession_number IS NOT NULL").select("accession_number").distinct().select(key_hash("accession_number").alias("hk"), "accession_number")
    return rows.join(t("hub_filing").select(F.col("hub_filing_hk").alias("hk")), "hk", "left_anti")


@query(
    "j10_changed_against_latest",
    """WITH old AS (SELECT hub_company_hk, entity_name FROM (SELECT *, row_number() OVER (PARTITION BY hub_company_hk ORDER BY load_datetime DESC, entity_name DESC NULLS LAST) AS rn FROM sat_company_metadata WHERE load_datetime < TIMESTAMPTZ '2020-01-01 00:00:00+00') WHERE rn = 1)
    SELECT DISTINCT hub_company_hk, entity_name FROM sat_company_metadata n WHERE load_datetime >= TIMESTAMPTZ '2020-01-01 00:00:00+00' AND entity_name IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM old WHERE old.hub_company_hk = n.hub_company_hk AND old.entity_name IS NOT DISTINCT FROM n.entity_name)""",
)
def _(t):
    s = t("sat_company_metadata").select("hub_company_hk", "load_datetime", "entity_name")
    known = latest_rows(s.where("load_datetime < '2020-01-01'"), ["hub_company_hk"]).select("hub_company_hk", hashdiff("entity_name").alias("h"))
    new = s.where("load_datetime >= '2020-01-01' AND entity_name IS NOT NULL").select("hub_company_hk", "entity_name", hashdiff("entity_name").alias("h")).distinct()
    return new.join(known, ["hub_company_hk", "h"], "left_anti").drop("h")


@query("j11_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def _(t):
    return t("customer").select("c_custkey").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j12_unnest", "SELECT c_custkey, y.y AS fiscal_year FROM customer, unnest([1996, 1997, 1998]) AS y(y)")
def _(t):
    return t("customer").select("c_custkey", F.explode(F.array(*map(F.lit, (1996, 1997, 1998)))).alias("fiscal_year"))


@query(
    "j13_aggregate_join_back",
    "SELECT o_orderkey, o_totalprice FROM orders o JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders GROUP BY 1) x ON o.o_custkey = x.k AND o.o_totalprice = x.m",
)
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    w = Window.partitionBy("o_custkey")  # one exchange instead of two
    return o.withColumn("m", F.max("o_totalprice").over(w)).where("o_totalprice = m").select("o_orderkey", "o_totalprice")


@query("j14_fk_closure", "SELECT count(*) AS orphans FROM (SELECT DISTINCT hub_filing_hk FROM sat_filing_metadata) s WHERE hub_filing_hk NOT IN (SELECT hub_filing_hk FROM hub_filing)")
def _(t):
    return t("sat_filing_metadata").select("hub_filing_hk").distinct().join(t("hub_filing").select("hub_filing_hk"), "hub_filing_hk", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


# --- aggregations


@query("a01_counts", "SELECT count(*) AS n, count(value) AS valued, count(DISTINCT cik) AS companies FROM sat_concept_value")
def _(t):
    return t("sat_concept_value").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("valued"), F.count_distinct("cik").alias("companies"))


@query("a02_distinct_expression", "SELECT count(DISTINCT cik || '|' || canonical_concept) AS pairs FROM sat_concept_value")
def _(t):
    return t("sat_concept_value").agg(F.count_distinct(F.concat("cik", F.lit("|"), "canonical_concept")).alias("pairs"))


@query("a03_conditional_distinct", "SELECT fiscal_year, count(DISTINCT CASE WHEN canonical_concept = 'revenue' THEN cik END) AS with_revenue, count(DISTINCT CASE WHEN canonical_concept = 'assets' THEN cik END) AS with_assets FROM sat_concept_value GROUP BY 1")
def _(t):
    c = F.col("canonical_concept")
    return t("sat_concept_value").groupBy("fiscal_year").agg(F.count_distinct(F.when(c == "revenue", F.col("cik"))).alias("with_revenue"), F.count_distinct(F.when(c == "assets", F.col("cik"))).alias("with_assets"))


@query(
    "a04_basic_aggregates",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, round(avg(l_discount), 6) AS avg_disc, min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_tax").alias("min_tax"), F.max("l_tax").alias("max_tax"), F.count(F.lit(1)).alias("n")
    )


@query("a05_stddev", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd FROM customer GROUP BY 1")
def _(t):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"))


@query("a06_median_element", "SELECT n_regionkey, quantile_disc(c_acctbal, 0.5) AS med FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    # The exact element at the rank of the median; accuracy bounds the summary kept per group.
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.percentile_approx("c_acctbal", 0.5, 1_000_000).alias("med"))


@query(
    "a07_pivot",
    """SELECT accession_number, max(CASE WHEN canonical_concept = 'revenue' THEN value END) AS revenue, max(CASE WHEN canonical_concept = 'net_income' THEN value END) AS net_income, max(CASE WHEN canonical_concept = 'assets' THEN value END) AS assets
    FROM sat_concept_value WHERE fiscal_period = 'FY' GROUP BY 1""",
)
def _(t):
    return t("sat_concept_value").where("fiscal_period = 'FY'").groupBy("accession_number").pivot("canonical_concept", ["revenue", "net_income", "assets"]).agg(F.max("value"))


@query("a08_conditional_sum", "SELECT count(*) AS n, CAST(sum(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_shipdate").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_shipdate") < F.col("o_orderdate"), 1).otherwise(0)).alias("early"))


@query("a09_rollup_total", "SELECT coalesce(c_mktsegment, 'TOTAL') AS segment, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)")
def _(t):
    return t("customer").rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("c_mktsegment", F.lit("TOTAL")).alias("segment"), "n")


@query("a10_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@query("a12_distinct_tuple", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("a13_array_join", "SELECT canonical_concept, string_agg(DISTINCT concept_name, ', ' ORDER BY concept_name) AS tags FROM canonical_concept_tag_preference GROUP BY 1")
def _(t):
    return t("canonical_concept_tag_preference").groupBy("canonical_concept").agg(F.array_join(F.sort_array(F.collect_set("concept_name")), ", ").alias("tags"))


@query(
    "a14_unpivot_coverage",
    """SELECT concept, count(*) AS missing FROM (SELECT unnest([CASE WHEN revenue IS NULL THEN 'revenue' END, CASE WHEN net_income IS NULL THEN 'net_income' END, CASE WHEN assets IS NULL THEN 'assets' END]) AS concept FROM mart_financial_health) WHERE concept IS NOT NULL GROUP BY 1""",
)
def _(t):
    flags = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("revenue", "net_income", "assets")])
    return t("mart_financial_health").select(F.explode(flags).alias("concept")).where("concept IS NOT NULL").groupBy("concept").agg(F.count(F.lit(1)).alias("missing"))


@query("a15_scalars_as_columns", "SELECT (SELECT count(*) FROM hub_company) AS companies, (SELECT count(*) FROM hub_filing) AS filings, (SELECT count(*) FROM link_company_filing) AS links")
def _(t):
    out = None
    for name, n in (("hub_company", "companies"), ("hub_filing", "filings"), ("link_company_filing", "links")):
        one = t(name).agg(F.count(F.lit(1)).alias(n))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


YEARS = "SELECT o_custkey, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2"


def _yearly(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))


@query("a16_latest_complete_year", f"WITH y AS ({YEARS}) SELECT CAST(max(y) AS INTEGER) AS latest_complete_fy FROM (SELECT y, count(DISTINCT o_custkey) AS n FROM y GROUP BY 1) WHERE n >= 0.75 * (SELECT count(*) FROM customer)")
def _(t):
    return latest_complete_year(_yearly(t), "o_custkey", "y", F.lit(0.75 * t("customer").count()))


# --- windows


@query(
    "w1_collapse_mixed_rules",
    r"""WITH p AS (SELECT DISTINCT * FROM canonical_concept_tag_preference), r AS (SELECT DISTINCT s.sat_concept_value_hk, s.canonical_concept, s.concept_name, s.value, p.preference_rank, p.collapse_rule FROM sat_concept_value s JOIN p ON s.canonical_concept = p.canonical_concept AND s.concept_name = p.concept_name WHERE s.value IS NOT NULL)
    SELECT sat_concept_value_hk, concept_name, value FROM (SELECT *, row_number() OVER (PARTITION BY sat_concept_value_hk, canonical_concept ORDER BY CASE WHEN collapse_rule = 'preference_rank_asc' THEN preference_rank END ASC NULLS LAST, CASE WHEN collapse_rule <> 'preference_rank_asc' THEN value END DESC NULLS LAST, preference_rank, value DESC, concept_name) AS rn FROM r) WHERE rn = 1""",
)
def _(t):
    rows = t("sat_concept_value").where("value IS NOT NULL").select("sat_concept_value_hk", "canonical_concept", "concept_name", "value")
    rows = rows.join(t("canonical_concept_tag_preference").distinct(), ["canonical_concept", "concept_name"]).distinct()
    return collapse(rows, ["sat_concept_value_hk", "canonical_concept"], "collapse_rule", "preference_rank", "value").select("sat_concept_value_hk", "concept_name", "value")


@query("w2_comparative_dedup", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def _(t):
    best = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("b"))
    return best.select("l_orderkey", "l_linenumber", "b.l_partkey")


@query("w3_latest_satellite_row", "SELECT accession_number, filed_date FROM (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY load_datetime DESC, filed_date DESC NULLS LAST) AS rn FROM sat_filing_metadata) WHERE rn = 1")
def _(t):
    return latest_rows(t("sat_filing_metadata").select("accession_number", "load_datetime", "filed_date"), ["accession_number"]).drop("load_datetime")


@query("w4_guarded_growth", f"WITH y AS ({YEARS}) SELECT o_custkey, CAST(y AS INTEGER) AS y, round(CASE WHEN lag(y) OVER w = y - 1 THEN (v - lag(v) OVER w) / nullif(abs(lag(v) OVER w), 0) END, 6) AS yoy_pct FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY y)")
def _(t):
    return guarded_growth(_yearly(t), ["o_custkey"], "y", "v").select("o_custkey", "y", F.round("yoy_pct", 6).alias("yoy_pct"))


@query("w5_dense_rank_nulls_last", f"WITH y AS ({YEARS}), g AS (SELECT o_custkey, y, CASE WHEN lag(y) OVER w = y - 1 THEN (v - lag(v) OVER w) / nullif(abs(lag(v) OVER w), 0) END AS g FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY y)) SELECT o_custkey, CAST(y AS INTEGER) AS y, CAST(dense_rank() OVER (PARTITION BY y ORDER BY g DESC NULLS LAST) AS INTEGER) AS yoy_rank FROM g")
def _(t):
    g = guarded_growth(_yearly(t), ["o_custkey"], "y", "v")
    return g.select("o_custkey", "y", F.dense_rank().over(Window.partitionBy("y").orderBy(F.col("yoy_pct").desc_nulls_last())).alias("yoy_rank"))


@query(
    "w6_peer_statistics",
    """WITH x AS (SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer), s AS (SELECT c_nationkey, count(*) AS peer_count, round(avg(CAST(v AS DOUBLE)), 4) AS peer_mean, quantile_disc(v, 0.5) AS peer_median, round(stddev_samp(CAST(v AS DOUBLE)), 4) AS peer_stddev, min(v) AS peer_min, max(v) AS peer_max FROM x GROUP BY 1)
    SELECT c_custkey, peer_count, peer_mean, peer_median, peer_stddev, peer_min, peer_max, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) AS INTEGER) AS peer_rank, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY v), 12) AS peer_percentile FROM x JOIN s USING (c_nationkey)""",
)
def _(t):
    p = peer_statistics(t("customer").select("c_custkey", "c_nationkey", money("c_acctbal").alias("v")), ["c_nationkey"], "v")
    return p.select("c_custkey", "peer_count", F.round("peer_mean", 4).alias("peer_mean"), "peer_median", F.round("peer_stddev", 4).alias("peer_stddev"), "peer_min", "peer_max", "peer_rank", F.round("peer_percentile", 12).alias("peer_percentile"))


# --- top-k and set operations


@query("o1_case_order", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return t("orders").orderBy(rank, F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("o2_top_one", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("o3_top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("o3_top_n_within_group", "SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rn FROM customer) WHERE rn <= 5")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")  # a group limit is pushed below the exchange
    return t("customer").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("c_nationkey", "c_custkey", "rn")


@query("o4_union_typed_nulls", "SELECT s_suppkey AS k, s_name AS name, CAST(NULL AS VARCHAR) AS segment, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'customer' FROM customer")
def _(t):
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    return s.unionByName(c, allowMissingColumns=True).select("k", "name", "segment", "kind")


# --- scalar functions


@query("f1_json_scalar", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("f2_json_tag_exists", "SELECT DISTINCT lpad(trim(cik), 10, '0') AS cik, json_exists(json_text, '$.facts.\"us-gaap\".TurnoverTotal') AS has_tag FROM sec_edgar_companyfacts_raw WHERE json_valid(json_text)")
def _(t):
    from ledgerlake.operators.nested import flatten_documents

    raw = t("sec_edgar_companyfacts_raw")
    docs = flatten_documents(raw, "documents", cik=X.ten_digits("cik")).where("is_valid").select("doc_key", "cik")
    tags = flatten_documents(raw, "tags", cik=X.ten_digits("cik")).where("taxonomy = 'us-gaap' AND concept_name = 'TurnoverTotal'").select("doc_key").distinct().withColumn("t", F.lit(True))
    return docs.join(tags, "doc_key", "left").select("cik", F.coalesce("t", F.lit(False)).alias("has_tag")).distinct()


@query("f3_hashes", "SELECT c_custkey, upper(sha256(lpad(CAST(c_custkey AS VARCHAR), 10, '0'))) AS hk, upper(sha256(c_name || '||' || coalesce(c_mktsegment, '^^'))) AS hd FROM customer")
def _(t):
    return t("customer").select("c_custkey", key_hash(F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("hk"), key_hash("c_name", "c_mktsegment", nullable=(1,)).alias("hd"))


@query("f4_null_safe_hash", "SELECT DISTINCT sat_concept_value_hk, upper(sha256(cik || '||' || coalesce(CAST(period_start_date AS VARCHAR), '^^') || '||' || coalesce(fiscal_period, '^^'))) AS hk FROM sat_concept_value")
def _(t):
    return t("sat_concept_value").select("sat_concept_value_hk", key_hash("cik", "period_start_date", "fiscal_period", nullable=(1, 2)).alias("hk")).distinct()


@query("f5_try_cast", "SELECT doc_id, TRY_CAST(source AS INTEGER) AS as_int, TRY_CAST(CAST(n_chars AS VARCHAR) AS DECIMAL(28,2)) AS as_decimal FROM documents")
def _(t):
    return t("documents").select("doc_id", F.col("source").try_cast("int").alias("as_int"), F.col("n_chars").cast("string").try_cast("decimal(28,2)").alias("as_decimal"))


@query("f6_null_and_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit_price, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)), 8).alias("unit_price"), F.greatest("l_discount", "l_tax").alias("hi"), F.least("l_discount", "l_tax").alias("lo"))


@query("f7_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.datediff(day("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days"))


@query("f8_strings", "SELECT p_partkey, length(p_name) AS n, substr(p_type, 1, 4) AS kind, p_brand || '-' || p_type AS label FROM part")
def _(t):
    return t("part").select("p_partkey", F.length("p_name").cast("long").alias("n"), F.substring("p_type", 1, 4).alias("kind"), F.concat("p_brand", F.lit("-"), "p_type").alias("label"))
