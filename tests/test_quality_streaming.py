from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake.operators.quality import TableChecks, completeness, divergence, drift
from ledgerlake.streaming.ingest import RAW_SCHEMA, ingest_stream, load_batch


def test_report(spark):
    df = spark.createDataFrame([("1", "x"), ("1", "y"), (None, "z")], "k string, v string")
    parent = spark.createDataFrame([("2",)], "k string")
    out = {r.check_name: (r.actual, r.result) for r in TableChecks(df).not_null("nn", "k").accepted("av", "v", ["x", "y"]).unique("uq", "k").relationship("fk", "k", parent, "k").length("len", "v", 1).report().collect()}
    assert out == {"nn": ("1", "FAIL"), "av": ("1", "FAIL"), "uq": ("1", "FAIL"), "fk": ("1", "FAIL"), "len": ("0", "PASS")}


def test_divergence_drift_completeness(spark):
    a = spark.createDataFrame([("1", 10.0), ("2", 5.0), ("3", None)], "k string, v double")
    b = spark.createDataFrame([("1", 12.0), ("2", 5.5), ("4", 1.0)], "k string, w double")
    assert sorted(r.k for r in divergence(a, b, ["k"], "v", "w").collect()) == ["1", "4"]
    d = drift(spark.createDataFrame([("1", 1), ("1", 2), ("2", 1), ("2", 1)], "k string, v int"), ["k"], "v")
    assert {r.k: r.stability for r in d.collect()} == {"1": "RESTATEMENT_OR_DRIFT", "2": "STABLE"}
    u = spark.createDataFrame([("1",), ("2",)], "c string")
    f = spark.createDataFrame([("1", 2020, 1.0), ("9", 2020, 1.0)], "c string, y int, v double")
    out = {(r.y, r.column_name): (r.companies, r.pct) for r in completeness(u, [2020, 2021], f, "c", "y", ["v"]).collect()}
    assert out == {(2020, "v"): (1, 50.0), (2021, "v"): (0, 0.0)}


def test_stream_loads_each_file_once(spark, tmp_path):
    doc = '{"facts":{"us-gaap":{"A":{"units":{"USD":[{"accn":"a1","form":"10-K","filed":"2020-01-01"}]}}}}}'
    rows = spark.createDataFrame([(doc, "2020-01-01", "1")], RAW_SCHEMA)
    rows.write.parquet(f"{tmp_path}/in", mode="append")
    target = f"{tmp_path}/out"
    for _ in range(2):
        ingest_stream(spark, f"{tmp_path}/in", target, f"{tmp_path}/check", datetime(2026, 1, 1)).awaitTermination()
    load_batch(rows, target, datetime(2026, 2, 1))  # a replayed batch
    assert [spark.read.parquet(f"{target}/{t}").count() for t in ("hub_filing", "link_company_filing", "sat_filing_metadata")] == [1, 1, 1]
    changed = spark.createDataFrame([(doc.replace("10-K", "10-K/A"), "2020-02-01", "1")], RAW_SCHEMA)
    load_batch(changed, target, datetime(2026, 3, 1))
    assert spark.read.parquet(f"{target}/sat_filing_metadata").count() == 2
    assert spark.read.parquet(f"{target}/sat_filing_metadata").where(F.col("form_type") == "10-K/A").count() == 1


def test_stored_counts(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("b", 3), ("b", 2), ("c", 5), ("d", None), ("e", 1)], "g string, n int")
    assert [(r.actual, r.result) for r in TableChecks(df).counted("c", "n", "g").report().collect()] == [("3", "FAIL")]


def test_sign_off_is_whole(spark, tmp_path):
    import os

    import pytest

    from ledgerlake.plans.quality import QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rows = QUERIES["q19_sign_off"](spark, data).collect()
    packs = {r.pack for r in rows}
    assert {n for n in QUERIES if n.startswith("q3_verify_")} | {"q13_cross_mart_divergence", "q14_snapshot_drift"} == packs
    assert {f"q3_verify_{t}" for t in ("hub_filing", "built_hub_concept", "built_link_filing_concept_period", "built_sat_concept_canonical", "built_growth_forecast", "sat_company_metadata_hashes")} <= packs
    found = {(r.pack, r.check_name): r.result for r in rows}
    assert found["q3_verify_sat_company_metadata_hashes", "10_hashdiff_reproducible"] == "FAIL"  # TESTDATA: not to be trusted
    assert found["q3_verify_built_peer_benchmark", "peer_count_consistent_per_partition"] == "PASS"
    assert all(r.result == "PASS" for r in rows if r.pack.startswith("q3_verify_built_")), [r for r in rows if r.pack.startswith("q3_verify_built_") and r.result != "PASS"]


def test_coverage_gate_counts_absent_companies(spark):
    from ledgerlake.plans.quality import coverage_gate

    universe = spark.createDataFrame([(f"c{i:02}",) for i in range(20)], "cik string")
    schema = "cik string, as_of_date string, fiscal_year int, canonical_concept string, value_numeric double"

    def years(counts, at="2024-12-31", concepts=("revenue", "net_income")):
        return [(f"c{i:02}", at, y, c, 1.0) for y, n in counts.items() for i in range(n) for c in concepts]

    def gate(rows, floor=20.0):
        return [(r.fiscal_year, r.actual, r.result) for r in coverage_gate(spark.createDataFrame(rows, schema), universe, floor).collect()]

    assert gate(years({2022: 19, 2023: 20, 2024: 20})) == [(2024, "20", "PASS"), (2024, "20", "PASS"), (2024, "", "PASS"), (2024, "20.00", "PASS")]
    # few present rows that all have revenue, a year away altogether, no net income, a floor not met, an older snapshot, a stranger
    rows = years({2024: 16}, concepts=("revenue",)) + years({2022: 5}) + years({2023: 20, 2024: 20}, at="2023-12-31") + [("x", "2024-12-31", 2024, "revenue", 99.0)]
    assert gate(rows) == [(2024, "16", "FAIL"), (2024, "0", "FAIL"), (2024, "2022, 2023, 2024", "FAIL"), (2024, "16.00", "FAIL")]
    assert {x for r in gate(years({2024: 5})) for x in r} == {None, "no complete year", "FAIL"}
    assert [r[2] for r in gate([])] == ["FAIL"] * 4
