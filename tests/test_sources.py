import json

import pytest

from ledgerlake.operators.nested import flatten_documents
from ledgerlake.plans.relational import s5_text_scan
from ledgerlake.sources.tables import file_metadata, read_cover, read_documents, read_forecasts, read_seed


def write(root, date, cik, text):
    at = root / f"extract_date={date}" / f"cik={cik}"
    at.mkdir(parents=True)
    (at / "companyfacts.json").write_text(text)


def test_documents_seeds_and_metadata(spark, tmp_path):
    doc = {"cik": 1, "entityName": "N", "facts": {"us-gaap": {"A": {"units": {"USD": [{"accn": "x"}]}}}}}
    write(tmp_path / "raw", "2026-01-01", "0000000001", json.dumps(doc, indent=1))
    write(tmp_path / "raw", "2026-01-02", "0000000002", json.dumps(doc))
    df = read_documents(spark, str(tmp_path / "raw"))
    assert df.count() == 2 and {r.cik for r in df.collect()} == {"0000000001", "0000000002"}
    pruned = df.where("extract_date = '2026-01-02'")
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().toString() and pruned.count() == 1
    assert flatten_documents(df, "entries").count() == 2
    cover = read_cover(spark, str(tmp_path / "raw")).select("entityname").collect()
    assert [r[0] for r in cover] == ["N", "N"]
    meta = file_metadata(spark, str(tmp_path / "raw")).collect()
    assert len({r.content_sha256 for r in meta}) == 2 and all(r.size_bytes > 0 for r in meta) and {r.extract_date for r in meta} == {"2026-01-01", "2026-01-02"}


def test_malformed_cover_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"cik": 1, "entityName": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_cover(spark, str(tmp_path)).collect()


def test_seed_and_forecast_files(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('cik,ticker,entity_name\n0000000001,A,"N, Inc"\n')
    assert tuple(read_seed(spark, str(tmp_path / "seed.csv"), "cik string, ticker string, entity_name string").first()) == ("0000000001", "A", "N, Inc")
    spark.createDataFrame([("1", 2.0, "revenue", "2026-01-01")], "cik string, forecast_value double, canonical_concept string, as_of_date string").write.partitionBy("canonical_concept", "as_of_date").parquet(str(tmp_path / "f"))
    back = read_forecasts(spark, str(tmp_path / "f"), "cik string, forecast_value double, canonical_concept string, as_of_date string")
    assert dict(back.dtypes)["as_of_date"] == "string" and back.first().as_of_date == "2026-01-01"


def inferring(spark):
    """A session that takes folder names for numbers and dates, as Spark's own defaults do."""
    other = spark.newSession()
    other.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    return other


def test_folder_names_stay_text_in_any_session(spark, tmp_path):
    write(tmp_path / "raw", "2026-01-01", "0000000001", "{}")
    df = read_documents(inferring(spark), str(tmp_path / "raw"))
    assert df.dtypes == [("json_text", "string"), ("extract_date", "string"), ("cik", "string")]
    assert [tuple(r) for r in df.collect()] == [("{}", "2026-01-01", "0000000001")]


def test_documents_that_lie_in_no_folders_are_not_passed_over(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(Exception, match="(?i)single column"):
        read_documents(spark, str(tmp_path)).collect()


def test_text_scan_in_any_session(spark, tmp_path):
    raw = [("{}\n", "2026-1-1", "CIK0000000042"), ("a", "", "7"), ("b", "20260101", " 0007 "), ("", "2026-01-01", "9"), ("c", None, "9"), ("d", "2026-01-01", None)]
    for name, rows in (("some", raw), ("none", [])):
        spark.createDataFrame(rows, "json_text string, extract_date string, cik string").write.parquet(str(tmp_path / name / "sec_edgar_companyfacts_raw.parquet"))
    other = inferring(spark)
    some = s5_text_scan(other, str(tmp_path / "some"))
    assert {tuple(r) for r in some.collect()} == {("0000000042", "2026-1-1", 3), ("0000000007", "", 1), ("0000000007", "20260101", 1)}
    none = s5_text_scan(other, str(tmp_path / "none"))
    assert none.dtypes == some.dtypes and none.count() == 0
