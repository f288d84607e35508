"""Queries p7 to p10 on the filing tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import pack_key, ten_digits, unpack_key
from ledgerlake.llm.fusion import FILLED, Fusion
from ledgerlake.llm.leakage import MATCH, N, leaked_items
from ledgerlake.llm.mixing import mix, token_count
from ledgerlake.llm.spam import language, spam_share
from ledgerlake.session import cut, spread
from ledgerlake.sources.tables import table

# --- 7 best representative of each duplicate group


def _fusion(spark: SparkSession, d: str, *fields: str) -> Fusion:
    values = table(spark, d, "sat_concept_value").select(pack_key("sat_concept_value_hk").alias("sat_concept_value_hk"), "canonical_concept", "concept_name", "value", *fields)
    return Fusion(values, table(spark, d, "canonical_concept_tag_preference"), "sat_concept_value_hk")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    won = _fusion(spark, d).winners()
    return won.select(unpack_key("g").alias("sat_concept_value_hk"), "concept_name", (F.col("value") * 100).cast("long").alias("value_cents"))


def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Whole surviving records with filled fields, the posterior of their figure and what votes alone would take."""
    return _fusion(spark, d, *FILLED).filled().withColumn("sat_concept_value_hk", unpack_key("sat_concept_value_hk"))


def p7_fields(spark: SparkSession, d: str) -> DataFrame:
    """Surviving records whose empty fields had one candidate each, so that no vote decided."""
    whole = p7_survivors(spark, d).where(F.size("disputed_fields") == 0)
    return whole.select("sat_concept_value_hk", "rows", "canonical_concept", "concept_name", "value", *FILLED, F.array_join(F.array_sort("filled_fields"), ",").alias("filled"))


P7_SQL = r"""
WITH pref AS (SELECT canonical_concept, lower(trim(concept_name)) AS tag, any_value(concept_name) AS name, min(preference_rank) AS rank, any_value(collapse_rule) AS rule
  FROM canonical_concept_tag_preference GROUP BY 1, 2),
r AS (SELECT sat_concept_value_hk AS hk, value, canonical_concept, regexp_replace(lower(trim(concept_name, E' \t\r\n')), '^us-gaap[:_]', '') AS tag FROM sat_concept_value),
big AS (SELECT hk FROM r WHERE hk IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT r.hk, r.value, p.name, row_number() OVER (PARTITION BY r.hk ORDER BY
    CASE WHEN p.rule = 'preference_rank_asc' THEN p.rank END ASC NULLS LAST, r.value DESC, p.rank ASC, p.name ASC) AS n
  FROM r JOIN big ON r.hk = big.hk JOIN pref p ON p.canonical_concept = r.canonical_concept AND p.tag = r.tag WHERE r.value IS NOT NULL)
SELECT hk AS sat_concept_value_hk, name AS concept_name, CAST(value * 100 AS BIGINT) AS value_cents FROM c WHERE n = 1
"""

_FIELD = lambda f: f"CASE WHEN o.{f} IS NULL THEN a.{f} ELSE o.{f} END AS {f}"
P7_FIELDS_SQL = (
    P7_SQL[: P7_SQL.rindex("SELECT hk AS")].replace("SELECT r.hk, r.value, p.name", "SELECT r.hk, r.value, r.canonical_concept, p.name, r.tag").replace("AS tag FROM sat_concept_value)", f"AS tag, {', '.join(FILLED)} FROM sat_concept_value)")
    + f""", w AS (SELECT * FROM c WHERE n = 1),
o AS (SELECT w.hk, w.value, w.name, w.canonical_concept, {', '.join(f'max(r.{f}) AS {f}' for f in FILLED)} FROM w JOIN r ON r.hk = w.hk AND r.tag = w.tag AND r.value = w.value AND r.canonical_concept = w.canonical_concept GROUP BY 1, 2, 3, 4),
a AS (SELECT hk, count(*) AS rows, {', '.join(f'min({f}) AS {f}, count(DISTINCT {f}) AS n_{f}' for f in FILLED)} FROM r GROUP BY 1)
SELECT o.hk AS sat_concept_value_hk, a.rows, o.canonical_concept, o.name AS concept_name, o.value, {', '.join(map(_FIELD, FILLED))},
  concat_ws(',', {', '.join(f"CASE WHEN o.{f} IS NULL AND a.{f} IS NOT NULL THEN '{f}' END" for f in sorted(FILLED))}) AS filled
FROM o JOIN a ON o.hk = a.hk WHERE {' AND '.join(f'(o.{f} IS NOT NULL OR a.n_{f} <= 1)' for f in FILLED)}
"""
)

# --- 8 evaluation texts leaking into training text


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every item a document gives away, word for word or edited, with its exact coverage and its alignment."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Aligned pairs whose exact coverage is above a third."""
    return p8_leaks(spark, d).where((F.col("alignment_score") >= MATCH * N) & (F.col("covered_words") * 3 > F.col("item_words"))).select("doc_id", "item_id").distinct()


P8_SQL = r"""
WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id AS id, text FROM eval_items WHERE text IS NOT NULL),
t AS (SELECT 'd' AS kind, * FROM d UNION ALL SELECT 'i', * FROM i),
w AS (SELECT kind, id, regexp_extract_all(regexp_replace(regexp_replace(lower(regexp_replace(text, '(?i)</?[a-z!?][^<>]*>|&(?:#x?[0-9a-f]+|[a-z][a-z0-9]*);|[*_`~]+', ' ', 'g')), '(\d),(\d)', '\1\2', 'g'), '([\p{L}\p{N}])[''’]([\p{L}\p{N}])', '\1\2', 'g'), '[\p{L}\p{N}]+') AS w FROM t),
g AS (SELECT kind, id, len(w) AS size, p, list_slice(w, p, p + 7) AS gram FROM w, unnest(range(1, CAST(len(w) AS BIGINT) - 6)) AS x(p)),
m AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, i.size, i.p FROM (SELECT DISTINCT id, gram FROM g WHERE kind = 'd') d JOIN (SELECT * FROM g WHERE kind = 'i') i ON d.gram = i.gram),
c AS (SELECT doc_id, item_id, size, count(DISTINCT p + k) AS n FROM m, unnest(range(0, 8)) AS y(k) GROUP BY 1, 2, 3)
SELECT doc_id, item_id FROM c WHERE n * 3 > size
"""

# --- 9 mixing sources to target weights


def source_key(c: Column | str) -> Column:
    """``Web Crawl``, ``web-crawl`` and ``web_crawl `` are one source."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[\s_-]+", "_")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tokens and their place in the tree: sector of the company (domain), language, source."""
    docs = spread(table(spark, d, "documents").select("doc_id", "cik", "source", "lang", "text"))
    counted = docs.select("doc_id", ten_digits("cik").alias("cik"), language(F.col("lang")).alias("lang"), source_key("source").alias("source"), token_count(F.col("text")).alias("tokens"))
    s = table(spark, d, "sp100_company_sector").select(ten_digits("cik").alias("cik"), F.upper(F.btrim("gics_sector")).alias("domain")).where("cik IS NOT NULL")
    return counted.join(s.groupBy("cik").agg(F.min("domain").alias("domain")), "cik", "left").withColumn("domain", F.coalesce("domain", F.lit("NONE")))


def _mix(spark: SparkSession, d: str, once: bool = False) -> tuple[DataFrame, DataFrame]:
    records = cut(_records(spark, d))
    targets = table(spark, d, "mix_targets").select(source_key("source").alias("source"), "target_share", "max_repeats")
    total = (records.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0) if once else None  # LEAF_LIMIT targets at most
    return mix(records, "doc_id", ["domain", "lang", "source"], "tokens", targets, "source", total=total, seed=20)


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents with their number of copies, at the largest total at which no source is short."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, planned and actual share of each source."""
    return _mix(spark, d)[1]


def p9_filled_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents at a total of all tokens of the sources asked for, so that small sources are short."""
    return _mix(spark, d, once=True)[0]


def p9_filled_shares(spark: SparkSession, d: str) -> DataFrame:
    """Its shares: what short leaves lack comes from their siblings, then from further up."""
    return _mix(spark, d, once=True)[1]


# --- 10 keyword-stuffed and link-list pages


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return spam_share(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_share(spark, d).where("spam_share > 0.5").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p7_found": p7_found,
    "p7_survivors": p7_survivors,
    "p7_fields": p7_fields,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_drawn": p9_drawn,
    "p9_shares": p9_shares,
    "p9_filled_drawn": p9_filled_drawn,
    "p9_filled_shares": p9_filled_shares,
    "p10_found": p10_found,
    "p10_share": p10_share,
}

ORACLE_SQL: dict[str, str] = {"p7_found": P7_SQL, "p7_fields": P7_FIELDS_SQL, "p8_found": P8_SQL}
