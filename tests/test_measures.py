import os

import pytest

from ledgerlake.plans.measures import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_yoy_rank_follows_growth(spark):
    rows = QUERIES["b5_revenue_yoy_rank"](spark, DATA).collect()
    assert rows and len({r.cik for r in rows}) == len(rows)
    known = sorted((r for r in rows if r.revenue_yoy_pct is not None), key=lambda r: -r.revenue_yoy_pct)
    assert [r.revenue_yoy_rank for r in known] == sorted(r.revenue_yoy_rank for r in known)


def test_forecast_growth(spark):
    from ledgerlake.plans.measures import forecast_growth

    f = spark.createDataFrame([("a", 2024, 110.0, 100.0, 120.0, 2023), ("a", 2026, 133.1, 120.0, 140.0, 2023), ("b", 2026, -5.0, -6.0, -4.0, 2023), ("c", 2026, 0.0, -1.0, 1.0, 2023), ("d", 2026, 1.0, 0.0, 2.0, 2020)], "cik string, forecast_year int, forecast_value double, lower_ci_95 double, upper_ci_95 double, latest_historical_year int")
    past = spark.createDataFrame([("a", 2023, 100.0), ("a", 2022, 9.0), ("b", 2023, 4.0), ("c", 2023, 4.0)], "cik string, fiscal_year int, v double")
    out = {r.cik: r for r in forecast_growth(f, past).collect()}
    assert set(out) == {"a", "b", "c"} and abs(out["a"].forecast_cagr - 0.1) < 1e-9 and abs(out["a"].half_width - 10 / 133.1) < 1e-9
    assert out["b"].forecast_cagr is None and out["b"].half_width == 0.2 and out["c"].half_width is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_cohort_lines_pinch_at_the_last_actual(spark):
    rows = QUERIES["b13_cohort_lines"](spark, DATA).collect()
    by = {}
    for r in rows:
        by.setdefault(r.cik, []).append(r)
    for lines in by.values():
        first = min(lines, key=lambda r: r.fiscal_year)
        assert first.fiscal_year == first.cohort and first.lower_ci_95 == first.forecast_value == first.upper_ci_95
        assert [r.fiscal_year - first.cohort for r in sorted(lines, key=lambda r: r.fiscal_year)] == [0, 1, 2, 3]
        assert all(r.lower_ci_95 <= r.forecast_value <= r.upper_ci_95 for r in lines)
