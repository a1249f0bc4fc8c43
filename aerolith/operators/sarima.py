"""Seasonal ARMA by exact likelihood: state-space form, gaps skipped by the filter, orders chosen by AIC, origins rolled without refitting.

Each (series, order) is a group of its own, so candidate orders of one series are fitted in
parallel; a group holds one series' numbers. Values are taken less the training mean. Orders are
(p, q, P, Q), each 0 or 1: (1 - f B)(1 - F B^s) y = (1 + t B)(1 + T B^s) e.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = ((1, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (1, 1, 1, 1))


def system(order: tuple[int, int, int, int], params: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, r): the transition's first column and the loading of the shock. Parameters lie in (-1, 1)."""
    p, q, sp, sq = order
    given = iter(params)
    f, t, sf, st = (next(given) if on else 0.0 for on in order)
    n = max(p + season * sp, q + season * sq + 1)
    phi, r = np.zeros(n), np.zeros(n)
    r[0] = 1.0
    for at, value in ((1, f), (season, sf), (season + 1, -f * sf)):
        if value:
            phi[at - 1] += value
    for at, value in ((1, t), (season, st), (season + 1, t * st)):
        if value:
            r[at] += value
    return phi, r


def _ahead(phi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """T a, T being the shift with phi as its first column."""
    out = phi * a[0]
    out[:-1] += a[1:]
    return out


def stationary(phi: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The state's covariance before anything is seen: P = T P T' + r r', by doubling the horizon until nothing is added."""
    n = len(phi)
    t = np.zeros((n, n))
    t[:, 0] = phi
    t[np.arange(n - 1), np.arange(1, n)] += 1.0
    p = np.outer(r, r)
    for _ in range(60):
        more = t @ p @ t.T
        p, t = p + more, t @ t
        if np.abs(more).max() <= 1e-13 * np.abs(p).max():
            break
    return p


def run_filter(y: np.ndarray, phi: np.ndarray, r: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Innovations and their variances (over the shock's) of the known values, and the predicted state at the rows in keep."""
    a, p, rr = np.zeros(len(phi)), stationary(phi, r), np.outer(r, r)
    wanted = set(() if keep is None else keep.tolist())
    v, f, states = [], [], {}
    gain, steady = None, False
    for i, value in enumerate(y):
        if i in wanted:
            states[i] = a.copy()
        if value == value:
            miss = value - a[0]
            if not steady:
                gain, variance = p[:, 0] / p[0, 0], p[0, 0]
            v.append(miss)
            f.append(variance)
            a = a + gain * miss
        elif steady:  # a gap: the settled covariance holds no longer
            steady = False
        a = _ahead(phi, a)
        if not steady:
            before = p
            if value == value:
                p = p - np.outer(gain, p[0])
            half = phi[:, None] * p[0]
            half[:-1] += p[1:]
            p = half[:, :1] * phi + rr
            p[:, :-1] += half[:, 1:]
            steady = value == value and bool(np.abs(p - before).max() < 1e-9)
    return np.array(v), np.array(f), states


def likelihood(y: np.ndarray, phi: np.ndarray, r: np.ndarray) -> tuple[float, float]:
    """(log-likelihood, shock variance), the variance at its best."""
    v, f, _ = run_filter(y, phi, r)
    n = len(v)
    if not n or not np.isfinite(v).all() or (f <= 0).any():
        return -math.inf, math.nan
    sigma2 = max(float(np.mean(v * v / f)), 1e-300)
    return -0.5 * (n * (math.log(2 * math.pi * sigma2) + 1) + float(np.log(f).sum())), sigma2


def maximise(f, x: np.ndarray, evaluations: int = 160, near: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Nelder and Mead's simplex: (where, value, whether it settled)."""
    points = np.array([x, *(x + 0.7 * e for e in np.eye(len(x)))])
    values = np.array([f(p) for p in points])
    spent = len(values)
    while True:
        order = np.argsort(-values, kind="stable")
        points, values = points[order], values[order]
        settled = bool(values[0] - values[-1] < near)
        if settled or spent >= evaluations:
            return points[0], float(values[0]), settled
        middle = points[:-1].mean(axis=0)
        at = lambda step: middle + step * (middle - points[-1])  # noqa: B023, E731
        new = at(1.0)
        value, spent = f(new), spent + 1
        if value > values[0] or value <= values[-2]:
            other = at(2.0 if value > values[0] else -0.5)
            tried, spent = f(other), spent + 1
            if tried > value:
                new, value = other, tried
        if value > values[-1]:
            points[-1], values[-1] = new, value
        else:
            points[1:] = (points[0] + points[1:]) / 2
            values[1:], spent = [f(p) for p in points[1:]], spent + len(x)


def fit(y: np.ndarray, order: tuple[int, int, int, int], season: int) -> tuple[np.ndarray, float, float, float, bool]:
    """(parameters, shock variance, log-likelihood, AIC, settled) of values less their mean."""
    k = sum(order)
    inside = lambda x: 0.999 * np.tanh(x)
    where, value, settled = maximise(lambda x: likelihood(y, *system(order, inside(x), season))[0], np.full(k, 0.3))
    params = inside(where)
    return params, likelihood(y, *system(order, params, season))[1], value, 2 * (k + 1) - 2 * value, settled


def choose_orders(train: DataFrame, entity: str, ts: str, value: str, season: int = 24, orders=ORDERS, least: int = 100) -> DataFrame:
    """entity, p, q, sp, sq, params, mean, sigma2, loglik, aic, observed, settled, best: every order of every series, and whether its AIC is the least.

    train is a complete grid, gaps as nulls. Series of fewer than `least` known values have no rows.
    """
    kind = dict(train.dtypes)[entity]
    names = ["p", "q", "sp", "sq"]
    pick = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, o))) for o in orders))).alias("o")
    rows = train.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("y"), pick).select("entity", "ts", "y", "o.*")
    columns = ["entity", *names, "params", "mean", "sigma2", "loglik", "aic", "observed", "settled"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ts")["y"].to_numpy(dtype=float)
        known = int(np.isfinite(y).sum())
        if known < least or np.nanstd(y) == 0:
            return pd.DataFrame(columns=columns)
        order, mean = tuple(int(pdf[n].iloc[0]) for n in names), float(np.nanmean(y))
        params, sigma2, loglik, aic, settled = fit(y - mean, order, season)
        return pd.DataFrame([(pdf["entity"].iloc[0], *order, params.tolist(), mean, sigma2, loglik, aic, known, settled)], columns=columns)

    fits = rows.groupBy("entity", *names).applyInPandas(run, f"entity {kind}, p int, q int, sp int, sq int, params array<double>, mean double, sigma2 double, loglik double, aic double, observed long, settled boolean")
    least_aic = fits.groupBy("entity").agg(F.min_by(F.struct(*names), F.struct("aic", *names)).alias("o"))
    return fits.join(least_aic, "entity").withColumn("best", F.struct(*names) == F.col("o")).drop("o").withColumnRenamed("entity", entity)


def rolling_forecasts(df: DataFrame, fits: DataFrame, entity: str, ts: str, value: str, test_from, horizons: list[int], season: int = 24, stride: int = 1) -> DataFrame:
    """entity, origin, horizon, ts, y_true, predicted, persistence: forecasts from every stride-th row from test_from on.

    The filter passes each series once with its best order's parameters; a forecast at an origin
    knows the rows before it, and the last known value is persistence. Only hours that were observed are
    scored. df is a complete grid.
    """
    kind = dict(df.dtypes)[entity]
    best = fits.where("best").select(entity, "p", "q", "sp", "sq", "params", "mean")
    rows = df.select(entity, F.col(ts).alias("ts"), F.col(value).cast("double").alias("y"), (F.col(ts) >= F.lit(test_from)).alias("test")).join(best, entity)
    columns = ["entity", "origin", "horizon", "ts", "y_true", "predicted", "persistence"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        one = pdf.iloc[0]
        y, when = pdf["y"].to_numpy(dtype=float), pdf["ts"]
        origins = np.flatnonzero(pdf["test"].to_numpy(dtype=bool))[::stride]
        phi, r = system(tuple(int(one[c]) for c in ("p", "q", "sp", "sq")), np.array(one["params"], dtype=float), season)
        _, _, states = run_filter(y - one["mean"], phi, r, origins)
        last = pd.Series(y).ffill().to_numpy()
        out = []
        for o in origins.tolist():
            a = states[o]
            for h in range(1, max(horizons) + 1):
                to = o + h - 1
                if h in horizons and to < len(y) and np.isfinite(y[to]) and o > 0:
                    out.append((one[entity], when[o], h, when[to], y[to], a[0] + one["mean"], last[o - 1]))
                a = _ahead(phi, a)
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy(entity).applyInPandas(run, f"entity {kind}, origin timestamp_ntz, horizon int, ts timestamp_ntz, y_true double, predicted double, persistence double").withColumnRenamed("entity", entity)


def forecast_scores(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """n, RMSE of the model and of persistence on the same rows, and the skill."""
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("y_true"), 2)))
    out = forecasts.where("persistence IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rmse("predicted").alias("rmse"), rmse("persistence").alias("persistence_rmse"))
    return out.withColumn("skill", 1 - F.try_divide(F.col("rmse"), F.col("persistence_rmse")))
