"""The filter's likelihood against a dense Gaussian's; orders, gaps and forecasts on simulated series."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from aerolith.operators import sarima


def dense_loglik(y, phi, r, sigma2):
    n, k = len(y), len(phi)
    t = np.zeros((k, k))
    t[:, 0] = phi
    t[np.arange(k - 1), np.arange(1, k)] += 1
    p, gamma = sarima.stationary(phi, r), []
    assert np.allclose(p, t @ p @ t.T + np.outer(r, r))
    for _ in range(n):
        gamma.append(p[0, 0])
        p = t @ p
    c = sigma2 * np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])
    known = np.isfinite(y)
    c, y = c[np.ix_(known, known)], y[known]
    return -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + y @ np.linalg.solve(c, y))


@pytest.mark.parametrize("order, params", [((1, 0, 0, 0), [0.8]), ((0, 1, 0, 0), [-0.5]), ((1, 1, 0, 0), [0.6, 0.4]), ((1, 0, 1, 0), [0.5, 0.7]), ((0, 1, 0, 1), [0.4, 0.6]), ((1, 1, 1, 1), [0.5, -0.3, 0.8, -0.4])])
def test_likelihood_is_exact_with_gaps(order, params):
    rng = np.random.default_rng(1)
    y = rng.normal(size=90)
    y[[3, 4, 5, 40, 88]] = np.nan
    y[60:75] = np.nan
    phi, r = sarima.system(order, np.array(params), 6)
    loglik, sigma2 = sarima.likelihood(y, phi, r)
    assert abs(loglik - dense_loglik(y, phi, r, sigma2)) < 1e-6
    assert all(dense_loglik(y, phi, r, sigma2 * k) < loglik for k in (0.9, 1.1))


def simulate(order, params, season, n, seed):
    phi, r = sarima.system(order, np.array(params), season)
    rng, a, out = np.random.default_rng(seed), np.zeros(len(phi)), []
    for _ in range(n + 200):
        a = sarima._ahead(phi, a) + r * rng.normal()
        out.append(a[0])
    return np.array(out[200:])


def frame(spark, series):
    rows = [(e, datetime(2021, 1, 1) + timedelta(hours=k), None if np.isnan(v) else float(v), "x") for e, y in series.items() for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double, params string")


def test_orders_and_forecasts(spark):
    seasonal = 20 + simulate((1, 0, 1, 0), [0.5, 0.9], 12, 700, 2)
    seasonal[100:110] = np.nan
    series = {"seasonal": seasonal, "short": np.arange(50.0), "flat": np.full(700, 3.0), "plain": simulate((1, 0, 0, 0), [0.7], 12, 700, 3)}
    df = frame(spark, series)
    cut = datetime(2021, 1, 1) + timedelta(hours=500)
    fits = sarima.choose_orders(df.where(df.ts < cut), "entity", "ts", "value", season=12)
    got = {(r["entity"], r["p"], r["q"], r["sp"], r["sq"]): r for r in fits.collect()}
    assert {k[0] for k in got} == {"seasonal", "plain"} and len(got) == 8
    best = {k[0]: r for k, r in got.items() if r["best"]}
    assert best["seasonal"]["sp"] == 1 and best["seasonal"]["observed"] == 490 and abs(best["seasonal"]["params"][best["seasonal"]["p"] + best["seasonal"]["q"]] - 0.9) < 0.08
    assert abs(got["plain", 1, 0, 0, 0]["params"][0] - 0.7) < 0.08 and abs(got["plain", 1, 0, 0, 0]["sigma2"] - 1) < 0.15
    forecasts = sarima.rolling_forecasts(df, fits, "entity", "ts", "value", cut, [1, 12], season=12, stride=2)
    scores = {(r["entity"], r["horizon"]): r for r in sarima.forecast_scores(forecasts, ["entity", "horizon"]).collect()}
    assert scores["seasonal", 1]["skill"] > 0.2 and scores["seasonal", 12]["skill"] > 0 and scores["plain", 12]["skill"] > 0.1
    # an origin knows nothing of its own hour and later: other values there change no forecast
    other = frame(spark, {e: np.where(np.arange(len(y)) < 600, y, -y) for e, y in series.items()})
    key = lambda f: {(r["entity"], r["origin"], r["horizon"]): r["predicted"] for r in f.collect() if r["origin"] <= datetime(2021, 1, 1) + timedelta(hours=600)}
    a, b = key(forecasts), key(sarima.rolling_forecasts(other, fits, "entity", "ts", "value", cut, [1, 12], season=12, stride=2))
    assert a and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert sarima.choose_orders(df.limit(0), "entity", "ts", "value").collect() == []
