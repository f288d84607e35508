import json
import os
from datetime import datetime

import pytest

from ledgerlake.plans import pipeline
from ledgerlake.plans.warehouse import Build
from ledgerlake.sources.bronze import bronze_checks, fetch_documents, write_document, write_forecasts

T1, T2, T3 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)
PREF = [("revenue", "Total", 1, "value_desc"), ("revenue", "Net", 2, "value_desc"), ("cash_and_equivalents", "Bare", 1, "preference_rank_asc"), ("cash_and_equivalents", "Wide", 2, "preference_rank_asc"), ("net_income", "Profit", 1, "value_desc"), ("assets", "Assets", 1, "value_desc")]


def entry(accn, year, val, filed, fp="FY", start=True, end=None):
    e = {"end": end or f"{year}-12-31", "val": val, "accn": accn, "fy": year, "fp": fp, "form": "10-K", "filed": filed}
    return {"start": f"{year}-01-01"} | e if start else e


def tables(spark, at, docs, names):
    raw = [(json.dumps({"cik": int(c), "facts": {"us-gaap": {t: {"units": {"USD": es}} for t, es in tags.items()}}}), "2026-01-01", c) for c, tags in docs.items()]
    spark.createDataFrame(raw, "json_text string, extract_date string, cik string").write.mode("overwrite").parquet(f"{at}/sec_edgar_companyfacts_raw.parquet")
    spark.createDataFrame([(n, day, c) for c, days in names.items() for day, n in days.items()], "entityname string, extract_date string, cik string").write.mode("overwrite").parquet(f"{at}/sec_edgar_companyfacts.parquet")
    spark.createDataFrame(PREF, "canonical_concept string, concept_name string, preference_rank smallint, collapse_rule string").write.mode("overwrite").parquet(f"{at}/canonical_concept_tag_preference.parquet")
    spark.createDataFrame([("1", "A", "N", "Energy", "Oil")], "cik string, ticker string, entity_name string, gics_sector string, gics_industry_group string").write.mode("overwrite").parquet(f"{at}/sp100_company_sector.parquet")


@pytest.fixture
def delivery(spark, tmp_path):
    docs = {
        "1": {
            "Total": [entry("a-16", y, 100.0 * (y - 2010), "2017-02-01") for y in (2014, 2015, 2016)] + [entry("a-16", 2016, 7, "2017-02-01", start=False)],
            "Net": [entry("a-16", 2016, 900, "2017-02-01"), entry("a-17", 2016, 650, "2018-02-01"), entry("a-17", 2017, 700, "2018-02-01")],
            "Bare": [entry("a-16", 2016, 5, "2017-02-01", start=False)],
            "Wide": [entry("a-16", 2016, 9, "2017-02-01", start=False), entry("a-17", 2017, 8, "2018-02-01", start=False)],
            "Unlisted": [entry("a-16", 2016, 1, "2017-02-01")],
            "Profit": [entry("a-16", 2016, "bad", "2017-02-01")],
        },
        "2": {"Total": [entry("b-16", 2016, 1, "2017-02-01")]},  # outside the universe
    }
    names = {"1": {"2025-12-31": "Old", "2026-01-31": "N Inc"}, "2": {"2026-01-31": "Other"}}
    at = str(tmp_path / "in")
    tables(spark, at, docs, names)
    return at, docs, names


def test_rules_of_the_build(spark, delivery):
    b = Build(spark, delivery[0])
    assert [r.cik for r in b.hub_company.collect()] == ["0000000001"]
    trend = {(str(r.as_of_date), r.fiscal_year): (float(r.value_numeric), r.yoy_pct) for r in b.pl_trend.collect()}
    # value_desc picks 900 of the first filing; the later filing restates the year from its own date on
    assert trend["2017-12-31", 2016] == (900.0, 0.8) and trend["2018-12-31", 2016] == (650.0, 0.3)
    assert ("2016-12-31", 2016) not in trend and trend["2018-12-31", 2017][0] == 700.0
    health = {(str(r.as_of_date), r.fiscal_year): r.cash_and_equivalents for r in b.financial_health.collect()}
    assert float(health["2017-12-31", 2016]) == 5.0 and float(health["2018-12-31", 2017]) == 8.0
    assert b.pit.where("sat_concept_value_pk IS NULL").count() > 0  # the link of the value that is no number
    assert {r.gics_sector for r in b.peer_benchmark.collect()} == {"Energy"}


def test_runs_append_only_what_is_new(spark, delivery, tmp_path):
    at, docs, names = delivery
    target = str(tmp_path / "out")
    first = pipeline.run(spark, at, target, T1)
    assert first["hub_company"] == 1 and first["sat_concept_value"] > 0 and first["growth_forecast"] > 0
    again = pipeline.run(spark, at, target, T2)
    assert all(again[n] == 0 for n in pipeline.RAW_VAULT) and all(again[n] == first[n] for n in pipeline.REBUILT)
    docs["1"]["Total"][0]["val"] = 401.0
    names["1"]["2026-02-28"] = "A New Name"
    tables(spark, at, docs, names)
    third = pipeline.run(spark, at, target, T3)
    assert (third["sat_concept_value"], third["sat_company_metadata"], third["hub_company"], third["link_filing_concept_period"]) == (1, 1, 0, 0)
    assert third["pl_trend"] == first["pl_trend"]
    trend = spark.read.parquet(f"{target}/pl_trend").where("fiscal_year = 2014 AND as_of_date = '2018-12-31'").collect()
    assert [(float(r.value_numeric), r.entity_name) for r in trend] == [(401.0, "A New Name")]


def test_fetching_and_the_bronze_layout(spark, tmp_path):
    answers = iter([(429, b""), (503, b""), (200, b'{"cik": 1}'), (200, b'{"cik": 2}')])
    waits = []
    got = dict(fetch_documents([1, "2"], lambda url: next(answers), "https://host/CIK{cik}.json", sleep=waits.append))
    assert got == {"0000000001": b'{"cik": 1}', "0000000002": b'{"cik": 2}'} and waits == [1.0, 2.0, 0.12]
    with pytest.raises(OSError):
        list(fetch_documents([1], lambda url: (404, b""), "{cik}"))
    with pytest.raises(ValueError):
        list(fetch_documents([1], lambda url: (200, b"<html>"), "{cik}"))
    for cik, body in got.items():
        write_document(spark, str(tmp_path / "b"), "2026-01-01", cik, body)
    assert [r.result for r in bronze_checks(spark, str(tmp_path / "b"), 2).collect()] == ["PASS"] * 5
    write_document(spark, str(tmp_path / "b"), "2026-01-01", "3", got["0000000001"])
    assert {r.check_name: r.result for r in bronze_checks(spark, str(tmp_path / "b"), 3).collect()}["5_no_shared_content"] == "FAIL"


def test_forecast_sink(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.0, "revenue", "2026-01-01"), ("2", 3.0, "revenue", "2026-01-01")], "cik string, v double, canonical_concept string, as_of_date string")
    write_forecasts(df, str(tmp_path / "f"))
    files = [f for _, _, fs in os.walk(tmp_path / "f") for f in fs if f.endswith(".parquet")]
    assert len(files) == 1
