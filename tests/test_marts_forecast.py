import numpy as np
from pyspark.sql import functions as F

from ledgerlake.operators.forecast import forecast, forecast_series
from ledgerlake.operators.marts import annual_span, derive_missing, guarded_growth, latest_complete_year, peer_statistics, with_ratios


def test_growth_guard(spark):
    rows = [("a", 2018, 100.0), ("a", 2019, 150.0), ("a", 2021, 300.0), ("b", 2018, -50.0), ("b", 2019, 50.0), ("c", 2018, 0.0), ("c", 2019, 5.0)]
    out = {(r.k, r.y): r.yoy_pct for r in guarded_growth(spark.createDataFrame(rows, "k string, y int, v double"), ["k"], "y", "v").collect()}
    assert out == {("a", 2018): None, ("a", 2019): 0.5, ("a", 2021): None, ("b", 2018): None, ("b", 2019): 2.0, ("c", 2018): None, ("c", 2019): None}


def test_span_null_start_is_dropped(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2020-01-01', DATE '2020-12-31'), (2, NULL, DATE '2020-12-31'), (3, DATE '2020-10-01', DATE '2020-12-31') AS t(i, period_start_date, period_end_date)")
    assert [r.i for r in df.where(annual_span()).collect()] == [1]


def test_peers_ties(spark):
    rows = [("s", "a", 10), ("s", "b", 10), ("s", "c", 5), ("t", "d", 1)]
    out = {r.k: r for r in peer_statistics(spark.createDataFrame(rows, "g string, k string, v int"), ["g"], "v").collect()}
    assert (out["a"].peer_rank, out["b"].peer_rank, out["c"].peer_rank) == (1, 1, 3)
    assert out["a"].peer_percentile == 1.0 and out["d"].peer_stddev is None and out["d"].peer_median == 1


def test_derivations_and_zero_denominators(spark):
    columns = "revenue,gross_profit,cost_of_revenue,liabilities,liabilities_and_se,stockholders_equity,stockholders_equity_including_nci,minority_interest,operating_income,net_income,assets,cash_and_equivalents,operating_cash_flow".split(",")
    schema = ", ".join(f"{c} double" for c in columns)
    rows = [(100.0, None, 60.0, None, 500.0, None, 210.0, 10.0, 1.0, 2.0, 0.0, 1.0, 1.0), (100.0, None, None, None, None, None, None, None, 1.0, 2.0, 4.0, 1.0, 1.0)]
    a, b = with_ratios(derive_missing(spark.createDataFrame(rows, schema))).collect()
    assert (a.gross_profit, a.stockholders_equity, a.liabilities, a.gross_margin, a.return_on_assets) == (40.0, 200.0, 300.0, 0.4, None)
    assert (b.gross_profit, b.stockholders_equity, b.liabilities, b.return_on_assets) == (None, None, None, 0.5)


def test_latest_complete_year(spark):
    df = spark.createDataFrame([("a", 2019), ("b", 2019), ("a", 2020)], "k string, y int")
    assert latest_complete_year(df, "k", "y", F.lit(2)).first()[0] == 2019
    assert latest_complete_year(df, "k", "y", F.lit(9)).first()[0] is None


def test_forecast_shapes():
    line = forecast_series(np.arange(2016, 2024), np.arange(8) * 10.0 + 100)
    assert [r[0] for r in line] == [2024, 2025, 2026] and np.allclose([r[1] for r in line], [180, 190, 200]) and line[0][4] == "holt_winters_additive"
    assert all(abs(r[3] - r[2]) < 1e-6 for r in line)
    short = forecast_series(np.array([2020, 2021, 2022]), np.array([1.0, 3.0, 4.0]))
    assert short[0][4] == "arima_1_1_0" and all(r[2] <= r[1] <= r[3] for r in short)
    assert len(forecast_series(np.array([2020, 2021]), np.array([1.0, 3.0]))) == 3
    assert forecast_series(np.array([2020]), np.array([1.0])) == []


def test_forecast_groups(spark):
    rows = [("a", 2016 + i, 100.0 + i) for i in range(6)] + [("b", 2020, 1.0), (None, 2020, 1.0), ("c", 2020, None)]
    out = forecast(spark.createDataFrame(rows, "cik string, y int, v double"), "cik", "y", "v").collect()
    assert {r.key for r in out} == {"a"} and len(out) == 3


def test_forecast_fixed_vectors():
    years = lambda y: np.arange(2016, 2016 + len(y))
    y = np.array([100, 120, 115, 140, 150, 149, 170], float)
    rows = forecast_series(years(y), y)
    # Without smoothing the trend model is the regression line, which fits this series best.
    slope, level = np.polyfit(np.arange(7), y, 1)
    assert np.allclose([r[1] for r in rows], level + slope * np.arange(7, 10), atol=1e-4)
    assert np.allclose([r[2] for r in rows], [165.689873, 171.353107, 178.216514], atol=1e-4) and abs(rows[0][5] - 32.807166) < 1e-4
    (a, b, c) = forecast_series(years([10, 12, 9]), np.array([10.0, 12.0, 9.0]))
    phi = (a[1] - 9) / -3  # AR(1) on the differences 2 and -3
    assert abs(phi + 0.925) < 1e-9 and np.allclose([b[1] - a[1], c[1] - b[1]], [-3 * phi**2, -3 * phi**3])
    d = np.array([2.0, -3.0])
    loss = lambda p: 2 * np.log((d[0] ** 2 * (1 - p**2) + (d[1] - p * d[0]) ** 2) / 2) - np.log(1 - p**2)
    assert loss(phi) <= min(loss(p) for p in np.linspace(-0.98, 0.98, 197)) + 1e-3
    flat = forecast_series(years([7, 8]), np.array([7.0, 8.0]))
    assert [r[1] for r in flat] == [8.0, 8.0, 8.0] and np.allclose([r[3] - 8 for r in flat], 1.959963984540054 * np.sqrt([1, 2, 3]))


def test_forecast_trend_model_is_the_best_of_its_kind():
    from ledgerlake.operators.forecast import holt

    rnd = np.random.default_rng(3)
    for _ in range(5):
        y = np.cumsum(rnd.normal(2, 5, 9)) + 50

        def sse(alpha, beta, y=y):
            def errors(level, trend, data):
                out = []
                for v in data:
                    e = v - level - trend
                    level, trend = level + trend + alpha * e, trend + alpha * beta * e
                    out.append(e)
                return np.array(out)

            zero = np.zeros_like(y)
            base = np.column_stack([errors(1, 0, zero), errors(0, 1, zero)])
            x, *_ = np.linalg.lstsq(base, -errors(0, 0, y), rcond=None)
            return float(((errors(0, 0, y) + base @ x) ** 2).sum())

        least = min(sse(a, b) for a in np.linspace(0.02, 0.98, 25) for b in np.linspace(0.02, 0.98, 25))
        found = y.size * np.exp((holt(y)[2] - 8) / y.size)
        assert found <= 1.01 * least
