"""Queries p1 to p6: the general data problems on the filing tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import text as X
from ledgerlake.operators.history import HistoryStore, raw_changes
from ledgerlake.operators.known_at import DAY_US, known_at
from ledgerlake.operators.nested import flatten_documents
from ledgerlake.operators.orphans import orphan_references
from ledgerlake.operators.profile import NUMBER_PROFILE, column_profile
from ledgerlake.operators.snapshots import snapshot_changes
from ledgerlake.session import cut, spread
from ledgerlake.sources.tables import table

# --- 1 references to records that do not exist


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "link_company_filing").select(
        X.pack_key("link_company_filing_hk").alias("row_key"),
        "load_datetime",
        X.pack_key(X.key_text("hub_company_hk")).alias("company"),
        X.pack_key(X.key_text("hub_filing_hk")).alias("filing"),
    )
    links = (
        packed.groupBy("row_key")
        .agg(F.min(F.struct("load_datetime", "company", "filing")).alias("first"))
        .select(
            "row_key",
            F.col("first.load_datetime").alias("ref_ts"),
            F.explode(
                F.create_map(
                    F.lit("link_company_filing.hub_company_hk"), F.col("first.company"),
                    F.lit("link_company_filing.hub_filing_hk"), F.col("first.filing"),
                )
            ).alias("relation", "ref_key"),
        )
    )
    sectors = table(spark, d, "sp100_company_sector").select(
        X.pack_key(X.ten_digits("cik")).alias("row_key"),
        F.lit(None).cast("timestamp").alias("ref_ts"),
        F.lit("sp100_company_sector.cik").alias("relation"),
        X.pack_key(X.ten_digits("cik")).alias("ref_key"),
    )
    companies, filings = table(spark, d, "hub_company"), table(spark, d, "hub_filing")
    parents = (
        companies.select(F.lit("link_company_filing.hub_company_hk").alias("relation"), X.pack_key(X.key_text("hub_company_hk")).alias("ref_key"), F.col("load_datetime").alias("parent_ts"))
        .unionByName(filings.select(F.lit("link_company_filing.hub_filing_hk").alias("relation"), X.pack_key(X.key_text("hub_filing_hk")).alias("ref_key"), F.col("load_datetime").alias("parent_ts")))
        .unionByName(companies.select(F.lit("sp100_company_sector.cik").alias("relation"), X.pack_key(X.ten_digits("cik")).alias("ref_key"), F.lit(None).cast("timestamp").alias("parent_ts")))
    )
    found = orphan_references(links.unionByName(sectors), parents)
    # A row key has one reference time here, so the distinct references are distinct cases.
    return found.select(
        F.substring_index("relation", ".", 1).alias("table_name"),
        F.substring_index("relation", ".", -1).alias("column_name"),
        X.unpack_key("row_key").alias("row_key"),
        F.coalesce(F.date_format("ref_ts", "yyyy-MM"), F.lit("all")).alias("period"),
    )


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, column and period."""
    return p1_found(spark, d).groupBy("table_name", "column_name", "period").agg(F.count(F.lit(1)).alias("orphans"))


P1_SQL = r"""
WITH link AS (
  SELECT link_company_filing_hk AS row_key, min(load_datetime) AS ts,
         arg_min(upper(trim(hub_company_hk, E' \t\r\n')), load_datetime) AS c, arg_min(upper(trim(hub_filing_hk, E' \t\r\n')), load_datetime) AS f
  FROM link_company_filing GROUP BY 1),
hc AS (SELECT upper(trim(hub_company_hk, E' \t\r\n')) AS k, min(load_datetime) AS ts FROM hub_company GROUP BY 1),
hf AS (SELECT upper(trim(hub_filing_hk, E' \t\r\n')) AS k, min(load_datetime) AS ts FROM hub_filing GROUP BY 1),
s AS (SELECT DISTINCT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS row_key FROM sp100_company_sector WHERE regexp_extract(cik, '(\d+)', 1) <> ''),
found AS (
  SELECT 'link_company_filing' AS table_name, 'hub_company_hk' AS column_name, row_key, strftime(link.ts AT TIME ZONE 'UTC', '%Y-%m') AS period
  FROM link LEFT JOIN hc ON hc.k = link.c WHERE link.c IS NOT NULL AND (hc.k IS NULL OR hc.ts > link.ts)
  UNION SELECT 'link_company_filing', 'hub_filing_hk', row_key, strftime(link.ts AT TIME ZONE 'UTC', '%Y-%m')
  FROM link LEFT JOIN hf ON hf.k = link.f WHERE link.f IS NOT NULL AND (hf.k IS NULL OR hf.ts > link.ts)
  UNION SELECT 'sp100_company_sector', 'cik', row_key, 'all' FROM s
  WHERE CAST(row_key AS BIGINT) NOT IN (SELECT CAST(cik AS BIGINT) FROM hub_company WHERE cik IS NOT NULL))
"""

# --- 2 what changed between full snapshots


def _company_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "sec_edgar_companyfacts"), X.ten_digits("cik"), X.iso_day("extract_date"), {"entityname": X.same_name("entityname")}
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _company_changes(spark, d).select(F.col("snapshot_key").alias("cik"), F.col("to_date").alias("extract_date"), "change")


P2_SQL = r"""
WITH s AS (
  SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik,
         replace(regexp_extract(trim(extract_date), '^(\d{4}-?\d{2}-?\d{2})', 1), '-', '') AS day,
         lower(trim(regexp_replace(entityname, '\s+', ' ', 'g'))) AS name
  FROM sec_edgar_companyfacts),
one AS (SELECT cik, day, max(name) AS name FROM s WHERE cik <> '' AND day <> '' GROUP BY 1, 2),
days AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM one)),
pairs AS (
  SELECT coalesce(n.cik, o.cik) AS cik, coalesce(n.to_day, o.to_day) AS day,
         CASE WHEN o.cik IS NULL THEN 'added' WHEN n.cik IS NULL THEN 'removed' WHEN n.name <> o.name THEN 'changed' END AS change
  FROM (SELECT one.cik, one.name, days.day AS to_day FROM one JOIN days ON one.day = days.day WHERE days.before IS NOT NULL) n
  FULL JOIN (SELECT one.cik, one.name, days.day AS to_day FROM one JOIN days ON one.day = days.before) o ON n.cik = o.cik AND n.to_day = o.to_day)
SELECT cik, substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) AS extract_date, change FROM pairs WHERE change IS NOT NULL
"""

# --- 3 column-level data quality profile

PROFILED = ["revenue", "net_income", "gross_margin", "as_of_date"]


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column and load of mart_financial_health."""
    return _profile(spark, d).select(*NUMBER_PROFILE).withColumn("ks_distance", F.round("ks_distance", 9))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    loads = F.date_format("load_datetime", "yyyy-MM-dd")
    v = F.col("v")
    too_late = v > F.unix_date(F.to_date("load_key")).cast("double")
    return column_profile(
        table(spark, d, "mart_financial_health"),
        loads,
        PROFILED,
        violations={"revenue": v < 0, "gross_margin": (v > 1) | (v < -10), "as_of_date": too_late | (v < F.unix_date(F.lit("2000-01-01").cast("date")).cast("double"))},
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    step = Window.partitionBy("column_name").orderBy("load_key")  # one row per load and column
    null_share = F.col("nulls") / F.col("rows")
    valued = F.col("rows") - F.col("nulls") - F.col("nans")
    top_share = F.try_divide(F.col("top_rows"), valued)
    p = _profile(spark, d).withColumns({"null_share": null_share, "top_share": top_share})
    p = p.withColumns({f"last_{c}": F.lag(c).over(step) for c in ("null_share", "top_share", "q50")})
    ratio = F.try_divide("q50", "last_q50")
    has_last = F.col("last_null_share").isNotNull()
    issues = {
        "null_rate": has_last & (F.col("null_share") - F.col("last_null_share") > 0.10),
        "median_shift": (F.col("column_name") != "as_of_date") & ((ratio < 0.2) | (ratio > 5)),
        "dominant_value": has_last & (F.col("top_share") > 0.15) & (F.col("top_share") > 2 * F.coalesce("last_top_share", F.lit(0.0))),
        "out_of_range": F.col("violations") > 0,
        "not_finite": (F.col("nans") + F.col("infinite")) > 0,
    }
    return (
        p.select(F.col("load_key").alias("load_date"), "column_name", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in issues.items()])).alias("issue"))
        .where("issue IS NOT NULL")
        .distinct()
    )


P3_SQL = """
WITH cells AS (
  SELECT strftime(load_datetime AT TIME ZONE 'UTC', '%Y-%m-%d') AS load_date, u.c AS column_name, u.v AS v
  FROM mart_financial_health, unnest([
    {'c': 'revenue', 'v': CAST(revenue AS DOUBLE)}, {'c': 'net_income', 'v': CAST(net_income AS DOUBLE)},
    {'c': 'gross_margin', 'v': gross_margin}, {'c': 'as_of_date', 'v': CAST(date_diff('day', DATE '1970-01-01', as_of_date) AS DOUBLE)}]) AS t(u)
  WHERE load_datetime IS NOT NULL),
tops AS (SELECT load_date, column_name, max(n) AS top FROM (
  SELECT load_date, column_name, v, count(*) AS n FROM cells WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
base AS (
  SELECT load_date, column_name, count(*) AS n, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS null_share,
    count(*) FILTER (WHERE v IS NOT NULL AND NOT isnan(v)) AS valued, count(*) FILTER (WHERE isnan(v) OR isinf(v)) AS odd,
    median(v) FILTER (WHERE isfinite(v)) AS med,
    count(*) FILTER (WHERE isfinite(v) AND ((column_name = 'revenue' AND v < 0) OR (column_name = 'gross_margin' AND (v > 1 OR v < -10))
      OR (column_name = 'as_of_date' AND (v > date_diff('day', DATE '1970-01-01', CAST(load_date AS DATE)) OR v < 10957)))) AS bad
  FROM cells GROUP BY 1, 2),
p AS (SELECT base.*, top / nullif(valued, 0) AS top_share,
    lag(null_share) OVER w AS last_null, lag(med) OVER w AS last_med, lag(top / nullif(valued, 0)) OVER w AS last_top, lag(n) OVER w AS last_n
  FROM base LEFT JOIN tops USING (load_date, column_name) WINDOW w AS (PARTITION BY column_name ORDER BY load_date))
SELECT load_date, column_name, 'null_rate' AS issue FROM p WHERE null_share - last_null > 0.10
UNION ALL SELECT load_date, column_name, 'median_shift' FROM p WHERE column_name <> 'as_of_date' AND (med / nullif(last_med, 0) < 0.2 OR med / nullif(last_med, 0) > 5)
UNION ALL SELECT load_date, column_name, 'dominant_value' FROM p WHERE last_n IS NOT NULL AND top_share > 0.15 AND top_share > 2 * coalesce(last_top, 0)
UNION ALL SELECT load_date, column_name, 'out_of_range' FROM p WHERE bad > 0
UNION ALL SELECT load_date, column_name, 'not_finite' FROM p WHERE odd > 0
"""

P3_PROFILE_SQL = P3_SQL[: P3_SQL.index("tops AS")].replace("AS load_date", "AS load_key", 1) + """
f AS (SELECT column_name, load_key, v, count(*) AS n FROM cells WHERE isfinite(v) GROUP BY 1, 2, 3),
tot AS (SELECT column_name, load_key, CAST(sum(n) AS BIGINT) AS total, lag(CAST(sum(n) AS BIGINT)) OVER (PARTITION BY column_name ORDER BY load_key) AS last_total, lag(load_key) OVER (PARTITION BY column_name ORDER BY load_key) AS last_key FROM f GROUP BY 1, 2),
pairing AS (SELECT t.column_name, t.load_key, t.total, t.last_total, f.v, sum(CASE WHEN f.load_key = t.load_key THEN f.n ELSE 0 END) AS a, sum(CASE WHEN f.load_key = t.last_key THEN f.n ELSE 0 END) AS b
  FROM tot t JOIN f ON f.column_name = t.column_name AND f.load_key IN (t.load_key, t.last_key) WHERE t.last_key IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
ks AS (SELECT column_name, load_key, max(abs(ca / total - cb / last_total)) AS ks FROM (SELECT *, CAST(sum(a) OVER w AS DOUBLE) AS ca, CAST(sum(b) OVER w AS DOUBLE) AS cb FROM pairing WINDOW w AS (PARTITION BY column_name, load_key ORDER BY v)) GROUP BY 1, 2),
q AS (SELECT column_name, load_key, list_sort(list(v)) AS l, count(*) AS n FROM cells WHERE isfinite(v) GROUP BY 1, 2),
tops AS (SELECT column_name, load_key, max(n) AS top_rows, count(*) AS vals FROM (SELECT column_name, load_key, v, count(*) AS n FROM cells WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
base AS (SELECT column_name, load_key, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE isnan(v)) AS nans, count(*) FILTER (WHERE isinf(v)) AS infinite,
  min(v) FILTER (WHERE isfinite(v)) AS min_value, max(v) FILTER (WHERE isfinite(v)) AS max_value,
  count(*) FILTER (WHERE isfinite(v) AND ((column_name = 'revenue' AND v < 0) OR (column_name = 'gross_margin' AND (v > 1 OR v < -10)) OR (column_name = 'as_of_date' AND (v > date_diff('day', DATE '1970-01-01', CAST(load_key AS DATE)) OR v < 10957)))) AS violations
  FROM cells GROUP BY 1, 2)
SELECT base.*, coalesce(vals, 0) AS distinct_values, coalesce(top_rows, 0) AS top_rows,
  (l[CAST(floor((n - 1) * 0.25) AS BIGINT) + 1] + l[CAST(ceil((n - 1) * 0.25) AS BIGINT) + 1]) / 2 AS q25, (l[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] + l[CAST(ceil((n - 1) * 0.5) AS BIGINT) + 1]) / 2 AS q50, (l[CAST(floor((n - 1) * 0.75) AS BIGINT) + 1] + l[CAST(ceil((n - 1) * 0.75) AS BIGINT) + 1]) / 2 AS q75,
  round(ks, 9) AS ks_distance, lag(base.load_key) OVER (PARTITION BY base.column_name ORDER BY base.load_key) AS previous_load
FROM base LEFT JOIN tops USING (column_name, load_key) LEFT JOIN q USING (column_name, load_key) LEFT JOIN ks USING (column_name, load_key)
"""

#: Tables whose every column is profiled: the text form of their loads, and patterns their texts should match.
_HASH = "^[0-9A-F]{64}$"
WHOLE_TABLES = {
    "mart_financial_health": ("yyyy-MM-dd", {"mart_financial_health_hk": _HASH, "cik": "^[0-9]{10}$"}),
    "sat_filing_metadata": ("yyyy-MM", {"sat_filing_metadata_hk": _HASH, "hashdiff": _HASH, "hub_filing_hk": _HASH, "accession_number": "^[0-9]{10}-[0-9]{2}-[0-9]{6}$", "form_type": "^[0-9]{1,2}-[A-Z](/A)?$"}),
}
_P3_COLUMNS = ["rows", "nulls", "nans", "infinite", "distinct_values", "top_rows", "min_value", "max_value", "q50", "min_text", "max_text", "median_text", "blanks", "min_length", "max_length", "patterns", "top_pattern", "top_pattern_rows", "pattern_violations"]


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column, text columns included, of two tables: load by load."""
    out = None
    for name, (loads, patterns) in WHOLE_TABLES.items():
        one = column_profile(table(spark, d, name), F.date_format("load_datetime", loads), patterns=patterns)
        one = one.select(F.lit(name).alias("table_name"), "column_name", "load_key", *_P3_COLUMNS, F.round("ks_distance", 9).alias("ks_distance"))
        out = one if out is None else out.unionByName(one)
    return out


#: Kind of each column in the SQL: number, day, time or text.
_P3_KINDS = {
    "mart_financial_health": {c: "text" for c in ("mart_financial_health_hk", "cik", "entity_name", "record_source")}
    | {"as_of_date": "day", "period_end_date": "day", "load_datetime": "time"}
    | {c: "number" for c in ("fiscal_year", "revenue", "gross_profit", "operating_income", "net_income", "assets", "liabilities", "stockholders_equity", "cash_and_equivalents", "operating_cash_flow", "gross_margin", "operating_margin", "net_margin", "return_on_assets", "return_on_equity", "debt_to_equity", "operating_cf_margin", "cash_to_assets", "is_latest_complete_fy")},
    "sat_filing_metadata": {c: "text" for c in ("sat_filing_metadata_hk", "hashdiff", "hub_filing_hk", "accession_number", "form_type", "record_source")} | {"filed_date": "day", "load_datetime": "time"},
}


def _p3_cells(name: str) -> str:
    loads, patterns = WHOLE_TABLES[name]
    form = {"number": "CAST({c} AS DOUBLE)", "day": "CAST(date_diff('day', DATE '1970-01-01', {c}) AS DOUBLE)", "time": "CAST(epoch_us({c}) AS DOUBLE)", "text": "CASE WHEN {c} IS NOT NULL THEN 0.0 END"}
    items = ", ".join(f"{{'c': '{c}', 'k': '{k}', 'v': {form[k].format(c=c)}, 't': {c if k == 'text' else 'CAST(NULL AS VARCHAR)'}, 'p': {f"regexp_matches({c}, '{patterns[c]}')" if c in patterns else 'true'}}}" for c, k in _P3_KINDS[name].items())
    sql = loads.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
    return f"SELECT '{name}' AS table_name, u.c AS column_name, strftime(load_datetime AT TIME ZONE 'UTC', '{sql}') AS load_key, u.k AS kind, u.v AS v, u.t AS t, u.p AS p FROM {name}, unnest([{items}]) AS x(u) WHERE load_datetime IS NOT NULL"


P3_COLUMNS_SQL = "WITH cells AS (" + " UNION ALL ".join(map(_p3_cells, WHOLE_TABLES)) + r""" ),
f AS (SELECT table_name, column_name, load_key, kind, v, coalesce(t, '') AS t, count(*) AS n FROM cells WHERE isfinite(v) GROUP BY 1, 2, 3, 4, 5, 6),
tot AS (SELECT table_name, column_name, load_key, CAST(sum(n) AS BIGINT) AS total, lag(CAST(sum(n) AS BIGINT)) OVER (PARTITION BY table_name, column_name ORDER BY load_key) AS last_total, lag(load_key) OVER (PARTITION BY table_name, column_name ORDER BY load_key) AS last_key FROM f GROUP BY 1, 2, 3),
pairing AS (SELECT t.table_name, t.column_name, t.load_key, t.total, t.last_total, f.v, f.t, sum(CASE WHEN f.load_key = t.load_key THEN f.n ELSE 0 END) AS a, sum(CASE WHEN f.load_key = t.last_key THEN f.n ELSE 0 END) AS b
  FROM tot t JOIN f ON f.table_name = t.table_name AND f.column_name = t.column_name AND f.load_key IN (t.load_key, t.last_key) WHERE t.last_key IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7),
ks AS (SELECT table_name, column_name, load_key, round(max(abs(ca / total - cb / last_total)), 9) AS ks_distance FROM (SELECT *, CAST(sum(a) OVER w AS DOUBLE) AS ca, CAST(sum(b) OVER w AS DOUBLE) AS cb FROM pairing WINDOW w AS (PARTITION BY table_name, column_name, load_key ORDER BY v, t)) GROUP BY 1, 2, 3),
q AS (SELECT table_name, column_name, load_key, list_sort(list(v)) AS l, list_sort(list(t)) AS lt, count(*) AS n FROM cells WHERE isfinite(v) GROUP BY 1, 2, 3),
tops AS (SELECT table_name, column_name, load_key, max(n) AS top_rows, count(*) AS vals FROM (SELECT table_name, column_name, load_key, v, t, count(*) AS n FROM cells WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3),
shape AS (SELECT table_name, column_name, load_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\p{Lu}+', 'A', 'g'), '\p{Ll}+', 'a', 'g'), '\p{Nd}+', '9', 'g'), '\s+', ' ', 'g'), '[Aa9]*(?:[Aa]9|9[Aa])[Aa9]*', 'X', 'g') AS pattern, count(*) AS n FROM cells WHERE t IS NOT NULL GROUP BY 1, 2, 3, 4),
shapes AS (SELECT table_name, column_name, load_key, count(*) AS patterns, (max({'n': n, 'p': pattern})).p AS top_pattern, max(n) AS top_pattern_rows FROM shape GROUP BY 1, 2, 3),
base AS (SELECT table_name, column_name, load_key, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE isnan(v)) AS nans, count(*) FILTER (WHERE isinf(v)) AS infinite,
  min(v) FILTER (WHERE isfinite(v) AND kind <> 'text') AS min_value, max(v) FILTER (WHERE isfinite(v) AND kind <> 'text') AS max_value, min(t) AS min_text, max(t) AS max_text, count(*) FILTER (WHERE trim(t) = '') AS blanks,
  CAST(min(length(t)) AS INTEGER) AS min_length, CAST(max(length(t)) AS INTEGER) AS max_length, count(*) FILTER (WHERE t IS NOT NULL AND NOT p) AS pattern_violations FROM cells GROUP BY 1, 2, 3)
SELECT base.*, coalesce(vals, 0) AS distinct_values, coalesce(top_rows, 0) AS top_rows, CASE WHEN min_text IS NULL THEN (l[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] + l[CAST(ceil((n - 1) * 0.5) AS BIGINT) + 1]) / 2 END AS q50,
  CASE WHEN min_text IS NOT NULL THEN lt[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] END AS median_text, coalesce(patterns, 0) AS patterns, top_pattern, coalesce(top_pattern_rows, 0) AS top_pattern_rows, ks_distance
FROM base LEFT JOIN tops USING (table_name, column_name, load_key) LEFT JOIN q USING (table_name, column_name, load_key) LEFT JOIN ks USING (table_name, column_name, load_key) LEFT JOIN shapes USING (table_name, column_name, load_key)
"""

# --- 4 deeply nested semi-structured records


def _raw(kind: str, **options):
    def query(spark: SparkSession, d: str) -> DataFrame:
        raw = table(spark, d, "sec_edgar_companyfacts_raw").select("json_text", "extract_date", "cik")
        return flatten_documents(spread(raw), kind, cik=X.ten_digits("cik"), **options)

    return query


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    entries = _raw("entries", fields=("accn",))(spark, d)
    return entries.select("cik", "extract_date", "taxonomy", "concept_name", "unit", "entry_no", F.coalesce("accn", F.lit("")).alias("accn")).distinct()


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    return _raw("documents")(spark, d).distinct()


def p4_tags(spark: SparkSession, d: str) -> DataFrame:
    return _raw("tags")(spark, d).distinct()


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """All entry fields; the operator gives ``val`` as written, here it is a number (NULL if it is none)."""
    return _raw("entries")(spark, d).withColumn("val", F.col("val").try_cast("double")).distinct()


P4_SQL = r"""
WITH doc AS (SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, extract_date, CAST(json_text AS JSON) AS j FROM sec_edgar_companyfacts_raw WHERE json_valid(json_text)),
tax AS (SELECT cik, extract_date, t.key AS taxonomy, t.value AS v FROM doc, json_each(j, '$.facts') t WHERE json_type(j, '$.facts') = 'OBJECT'),
tag AS (SELECT cik, extract_date, taxonomy, t.key AS concept_name, json_extract(t.value, '$.units') AS u FROM tax, json_each(v) t WHERE json_type(v) = 'OBJECT' AND json_type(t.value) = 'OBJECT'),
unit AS (SELECT cik, extract_date, taxonomy, concept_name, t.key AS unit, t.value AS a FROM tag, json_each(u) t WHERE json_type(u) = 'OBJECT'),
entry AS (
  SELECT cik, extract_date, taxonomy, concept_name, unit, CAST(t.key AS INTEGER) AS entry_no, t.value AS e FROM unit, json_each(a) t WHERE json_type(a) = 'ARRAY'
  UNION ALL SELECT cik, extract_date, taxonomy, concept_name, unit, 0, a FROM unit WHERE json_type(a) = 'OBJECT')
SELECT DISTINCT cik, extract_date, taxonomy, concept_name, unit, entry_no, coalesce(json_extract_string(e, '$.accn'), '') AS accn FROM entry WHERE json_type(e) = 'OBJECT'
"""

P4_ENTRIES_SQL = P4_SQL[: P4_SQL.index("SELECT DISTINCT")].replace("AS cik, extract_date, CAST", "AS cik, extract_date, sha256(concat_ws('|', lpad(ltrim(regexp_extract(cik, '(\\d+)', 1), '0'), 10, '0'), extract_date, json_text)) AS doc_key, CAST").replace("SELECT cik, extract_date", "SELECT doc_key, cik, extract_date")

_P4_DOC = r"SELECT lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0') AS cik, extract_date, sha256(concat_ws('|', lpad(ltrim(regexp_extract(cik, '(\d+)', 1), '0'), 10, '0'), extract_date, json_text)) AS doc_key, coalesce(json_valid(json_text), false) AS is_valid, CASE WHEN json_valid(json_text) THEN CAST(json_text AS JSON) END AS j FROM sec_edgar_companyfacts_raw"
_P4_TEXT = "CASE WHEN json_type({j}, '$.{f}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({j}, '$.{f}') END AS {n}"
P4_DOCUMENTS_SQL = f"""
WITH doc AS ({_P4_DOC}),
tax AS (SELECT doc_key, count(DISTINCT t.key) AS n FROM doc, json_each(j, '$.facts') t WHERE json_type(j, '$.facts') = 'OBJECT' AND json_type(t.value) = 'OBJECT' GROUP BY 1)
SELECT DISTINCT doc.doc_key, cik, extract_date, is_valid, {_P4_TEXT.format(j='j', f='entityName', n='entity_name')}, {_P4_TEXT.format(j='j', f='cik', n='document_cik')}, CAST(coalesce(tax.n, 0) AS INTEGER) AS n_taxonomies
FROM doc LEFT JOIN tax ON doc.doc_key = tax.doc_key
"""
P4_TAGS_SQL = f"""
WITH doc AS ({_P4_DOC}),
tax AS (SELECT doc_key, cik, extract_date, t.key AS taxonomy, t.value AS v FROM doc, json_each(j, '$.facts') t WHERE json_type(j, '$.facts') = 'OBJECT'),
tag AS (SELECT doc_key, cik, extract_date, taxonomy, t.key AS concept_name, t.value AS g FROM tax, json_each(v) t WHERE json_type(v) = 'OBJECT' AND json_type(t.value) = 'OBJECT')
SELECT DISTINCT doc_key, cik, extract_date, taxonomy, concept_name, {_P4_TEXT.format(j='g', f='label', n='label')}, {_P4_TEXT.format(j='g', f='description', n='description')}, CASE WHEN json_type(g, '$.units') = 'OBJECT' THEN CAST(len(json_keys(g, '$.units')) AS INTEGER) ELSE 0 END AS n_units FROM tag
"""

# --- 5 attributes as known at event time


def p5_known(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered PIT row with the value version known by its as_of_date (NULL if none)."""
    return _known(spark, d).select(X.unpack_key("pit_link_filing_concept_period_hk").alias("pit_link_filing_concept_period_hk"), "as_of_date", X.unpack_key("known_pk").alias("known_pk"), "known_us")


_PIT_KEYS = ("pit_link_filing_concept_period_hk", "link_filing_concept_period_hk", "sat_concept_value_pk")


def _known(spark: SparkSession, d: str) -> DataFrame:
    """``p5_known`` with packed keys."""
    pit = table(spark, d, "pit_link_filing_concept_period").select(*[X.pack_key(c).alias(c) for c in _PIT_KEYS], "as_of_date", F.unix_micros("sat_concept_value_ldts").alias("stored_us"))
    end = (F.unix_date("as_of_date").cast("long") + 1) * F.lit(DAY_US)
    values = table(spark, d, "sat_concept_value").select(X.pack_key("link_filing_concept_period_hk").alias("link_filing_concept_period_hk"), "load_datetime", "sat_concept_value_hk", "accession_number")
    valued = known_at(
        pit, values, "link_filing_concept_period_hk", end, F.unix_micros("load_datetime"),
        {"value_us": F.unix_micros("load_datetime"), "value_pk": X.pack_key("sat_concept_value_hk"), "accession_number": F.col("accession_number")},
    )
    filings = table(spark, d, "sat_filing_metadata").select("accession_number", "load_datetime", "filed_date")
    dated = known_at(
        cut(valued), filings, "accession_number", end, F.unix_micros("load_datetime"), {"filing_us": F.unix_micros("load_datetime"), "filed_date": F.col("filed_date")}
    )
    filed = F.col("filed_date") <= F.col("as_of_date")
    return dated.withColumns({"known_pk": F.when(filed, F.col("value_pk")), "known_us": F.when(filed, F.col("value_us"))})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    differs = ~F.col("sat_concept_value_pk").eqNullSafe(F.col("known_pk")) | ~F.col("stored_us").eqNullSafe(F.col("known_us"))
    found = _known(spark, d).where(differs).select("pit_link_filing_concept_period_hk", "known_pk").distinct()
    return found.select(X.unpack_key("pit_link_filing_concept_period_hk").alias("pit_link_filing_concept_period_hk"), F.coalesce(X.unpack_key("known_pk"), F.lit("none")).alias("known_sat_concept_value_pk"))


P5_SQL = """
WITH p AS (SELECT DISTINCT pit_link_filing_concept_period_hk AS hk, link_filing_concept_period_hk AS link, as_of_date,
    sat_concept_value_pk AS pk, sat_concept_value_ldts AS ldts, (as_of_date + 1)::TIMESTAMP AT TIME ZONE 'UTC' AS cut FROM pit_link_filing_concept_period),
v AS (SELECT link_filing_concept_period_hk AS link, load_datetime AS ts, max(sat_concept_value_hk) AS vpk, max(accession_number) AS accn FROM sat_concept_value GROUP BY 1, 2),
f AS (SELECT accession_number AS accn, load_datetime AS ts, max(filed_date) AS filed FROM sat_filing_metadata GROUP BY 1, 2),
a AS (SELECT p.*, v.ts AS vts, v.vpk, v.accn FROM p ASOF LEFT JOIN v ON p.link = v.link AND p.cut > v.ts),
b AS (SELECT a.*, CASE WHEN f.filed <= a.as_of_date THEN a.vpk END AS kpk, CASE WHEN f.filed <= a.as_of_date THEN a.vts END AS kts
  FROM a ASOF LEFT JOIN f ON a.accn = f.accn AND a.cut > f.ts)
SELECT DISTINCT hk AS pit_link_filing_concept_period_hk, coalesce(kpk, 'none') AS known_sat_concept_value_pk FROM b WHERE pk IS DISTINCT FROM kpk OR ldts IS DISTINCT FROM kts
"""

# --- 6 history of changing entity attributes


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    """Name versions of every company, loaded in two batches: the second holds the last tenth of the
    time span and, late, the middle third of a tenth of the companies; it rebuilds the chains it touches."""
    raw = raw_changes(table(spark, d, "sat_company_metadata"), F.col("hub_company_hk"), F.unix_micros("load_datetime"), F.col("entity_name"), X.same_name("entity_name"))
    span = raw.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    low, high = (0, 0) if span.a is None else (span.a, span.b)
    at = [F.lit(low + (high - low) * k // 30) for k in (10, 20, 27)]
    second = (F.col("us") >= at[2]) | ((F.col("us") >= at[0]) & (F.col("us") < at[1]) & (F.pmod(F.xxhash64("k"), F.lit(10)) == 0))
    store = HistoryStore(spark).apply(raw.where(~second)).apply(raw.where(second))
    store.vacuum()
    return store.chains().select(F.col("k").alias("hub_company_hk"), F.col("value").alias("entity_name"), "valid_from_us", F.coalesce("valid_to_us", F.lit(-1).cast("long")).alias("valid_to_us"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_history(spark, d).select("hub_company_hk", "valid_from_us", "valid_to_us").distinct()


P6_SQL = r"""
WITH r AS (SELECT DISTINCT hub_company_hk, epoch_us(load_datetime) AS us, lower(trim(regexp_replace(entity_name, '\s+', ' ', 'g'))) AS name
  FROM sat_company_metadata WHERE entity_name IS NOT NULL AND hub_company_hk IS NOT NULL AND load_datetime IS NOT NULL),
s AS (SELECT *, lag(name) OVER (PARTITION BY hub_company_hk ORDER BY us, name) AS before FROM r)
SELECT hub_company_hk, us AS valid_from_us, coalesce(lead(us) OVER (PARTITION BY hub_company_hk ORDER BY us, name), -1) AS valid_to_us FROM s WHERE before IS NULL OR before <> name
"""

P5_KNOWN_SQL = P5_SQL[: P5_SQL.index("SELECT DISTINCT hk AS")].replace("SELECT DISTINCT pit_link", "SELECT pit_link") + "SELECT hk AS pit_link_filing_concept_period_hk, as_of_date, kpk AS known_pk, epoch_us(kts) AS known_us FROM b"

P6_HISTORY_SQL = P6_SQL.replace("SELECT DISTINCT hub_company_hk, epoch_us(load_datetime) AS us,", "SELECT hub_company_hk, epoch_us(load_datetime) AS us, min(entity_name) AS entity_name,").replace(
    "AND load_datetime IS NOT NULL)", "AND load_datetime IS NOT NULL GROUP BY 1, 2, 4)"
).replace("SELECT hub_company_hk, us AS valid_from_us", "SELECT hub_company_hk, entity_name, us AS valid_from_us")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_profile": p3_profile,
    "p3_columns": p3_columns,
    "p4_found": p4_found,
    "p4_documents": p4_documents,
    "p4_tags": p4_tags,
    "p4_entries": p4_entries,
    "p5_found": p5_found,
    "p5_known": p5_known,
    "p6_found": p6_found,
    "p6_history": p6_history,
}

ORACLE_SQL: dict[str, str] = {
    "p1_found": P1_SQL + "SELECT * FROM found",
    "p1_counts": P1_SQL + "SELECT table_name, column_name, period, CAST(count(*) AS BIGINT) AS orphans FROM found GROUP BY 1, 2, 3",
    "p2_found": P2_SQL,
    "p3_found": P3_SQL,
    "p3_profile": P3_PROFILE_SQL,
    "p3_columns": P3_COLUMNS_SQL,
    "p4_found": P4_SQL,
    "p4_documents": P4_DOCUMENTS_SQL,
    "p4_tags": P4_TAGS_SQL,
    "p4_entries": P4_ENTRIES_SQL
    + "SELECT DISTINCT doc_key, cik, extract_date, taxonomy, concept_name, unit, entry_no, "
    + ", ".join(f"json_extract_string(e, '$.{f}') AS \"{f}\"" for f in ("start", "end", "accn", "fy", "fp", "form", "filed", "frame"))
    + ", TRY_CAST(json_extract_string(e, '$.val') AS DOUBLE) AS val"
    + " FROM entry WHERE json_type(e) = 'OBJECT'",
    "p5_found": P5_SQL,
    "p5_known": P5_KNOWN_SQL,
    "p6_found": P6_SQL,
    "p6_history": P6_HISTORY_SQL,
}
