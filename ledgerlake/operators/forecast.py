"""Three-year forecasts of yearly series, one pandas group per series.

Holt's additive trend for four or more observations, AR(1) on first differences for two or three
(or when the trend model cannot be fitted), nothing for fewer. States of the trend model are
linear in the data for fixed smoothing weights, so they are solved by least squares and only the
two weights are searched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Z95 = 1.959963984540054
HORIZON = 3
SCHEMA = "key string, forecast_year int, forecast_value double, lower_ci_95 double, upper_ci_95 double, model_name string, model_aic double, historical_obs_count int, latest_historical_year int"


def _trend_pass(y: np.ndarray, alpha: float, beta: float) -> tuple[float, float, float, np.ndarray]:
    """Best starting states for the weights, and the last states: (sse, level, trend, errors)."""
    runs = []
    for level, trend, data in ((0.0, 0.0, y), (1.0, 0.0, np.zeros_like(y)), (0.0, 1.0, np.zeros_like(y))):
        errors = np.empty(y.size)
        for i, v in enumerate(data):
            fit = level + trend
            errors[i] = v - fit
            new = fit + alpha * errors[i]
            trend, level = trend + alpha * beta * errors[i], new
        runs.append((errors, level, trend))
    base = np.column_stack([runs[1][0], runs[2][0]])
    x, *_ = np.linalg.lstsq(base, -runs[0][0], rcond=None)
    errors = runs[0][0] + base @ x
    level = runs[0][1] + x[0] * runs[1][1] + x[1] * runs[2][1]
    trend = runs[0][2] + x[0] * runs[1][2] + x[1] * runs[2][2]
    return float(errors @ errors), float(level), float(trend), errors


def holt(y: np.ndarray, horizon: int = HORIZON) -> tuple[np.ndarray, np.ndarray, float]:
    """Point forecasts, half widths of the 95 % interval, AIC."""
    best = None
    grid = np.linspace(0.02, 0.98, 13)
    for step in (0.08, 0.02, 0.005):
        for a in grid if best is None else np.clip([best[1] - step, best[1], best[1] + step], 0.001, 0.999):
            for b in grid if best is None or best[0] is None else np.clip([best[2] - step, best[2], best[2] + step], 0.001, 0.999):
                r = _trend_pass(y, a, b)
                if best is None or best[0] is None or r[0] < best[0]:
                    best = (r[0], a, b, r)
    sse, level, trend, errors = best[3]
    h = np.arange(1, horizon + 1)
    sd = float(np.std(errors, ddof=1))
    floor = max(1e-12, 1e-18 * float(y @ y))
    return level + trend * h, 1.96 * sd * np.sqrt(h), y.size * math.log(max(sse, floor) / y.size) + 2 * 4


def arima110(y: np.ndarray, horizon: int = HORIZON) -> tuple[np.ndarray, np.ndarray, float]:
    """Zero-mean AR(1) on first differences by exact likelihood."""
    d = np.diff(y)

    def loss(phi: float) -> tuple[float, float]:
        s = d[0] ** 2 * (1 - phi**2) + float(((d[1:] - phi * d[:-1]) ** 2).sum())
        var = max(s / d.size, 1e-12)
        return d.size * math.log(var) - math.log(1 - phi**2), var

    phi = 0.0 if d.size < 2 else min(np.linspace(-0.99, 0.99, 397), key=lambda p: loss(p)[0])
    nll, var = loss(phi)
    steps, level, last, psi, total = [], y[-1], d[-1], 0.0, 0.0
    widths = []
    for k in range(horizon):
        last *= phi
        level += last
        psi += phi**k
        total += psi**2
        steps.append(level)
        widths.append(Z95 * math.sqrt(var * total))
    aic = nll + d.size * (1 + math.log(2 * math.pi)) + 2 * 2
    return np.array(steps), np.array(widths), aic


def forecast_series(years: np.ndarray, values: np.ndarray, horizon: int = HORIZON) -> list[tuple]:
    """Rows (year, point, lower, upper, model, aic, observations, last year); none for a single value."""
    order = np.argsort(years, kind="stable")
    years, first = np.unique(years[order], return_index=True)
    y = values[order][first].astype(float)
    if y.size < 2:
        return []
    name = "holt_winters_additive" if y.size >= 4 else "arima_1_1_0"
    try:
        point, half, aic = (holt if y.size >= 4 else arima110)(y, horizon)
        if not np.isfinite(point).all():
            raise ValueError("no finite forecast")
    except (ValueError, np.linalg.LinAlgError):
        name, (point, half, aic) = "arima_1_1_0", arima110(y, horizon)
    return [(int(years[-1]) + 1 + k, float(point[k]), float(point[k] - half[k]), float(point[k] + half[k]), name, float(aic), int(y.size), int(years[-1])) for k in range(horizon)]


def forecast(df: DataFrame, key: str, year: str, value: str, horizon: int = HORIZON) -> DataFrame:
    """Forecasts of every series; rows with a NULL in key, year or value are left out, of repeated
    years the greatest value counts. The shuffle carries one row per key and year."""
    from pyspark.sql import functions as F

    series = df.where(F.col(key).isNotNull() & F.col(year).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), F.col(year).cast("int").alias("year")).agg(F.max(F.col(value).cast("double")).alias("value"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = forecast_series(pdf["year"].to_numpy(), pdf["value"].to_numpy(), horizon)
        return pd.DataFrame([(pdf["key"].iloc[0], *r) for r in rows], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return series.groupBy("key").applyInPandas(run, SCHEMA)
