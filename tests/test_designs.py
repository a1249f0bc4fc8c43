"""Ridge regressions over fold cells against separate fits; counterfactuals and trend breaks on series with known steps."""

from datetime import date, datetime, timedelta

import numpy as np

from aerolith.operators import causal, folds, gapfill


def separate(rows, alpha, features):
    """{(design, s, q): (train, test, rmse)} by fitting every fold anew."""
    out = {}
    a = np.array([r[:2] for r in rows])
    y, w, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([[r[4 + i] for i in features] for r in rows], dtype=float)
    for design, s, q in [*(("station", s, None) for s in range(5)), *(("quarter", None, q) for q in range(1, 5)), *(("joint", s, q) for s in range(5) for q in range(1, 5))]:
        ts = np.ones(len(a), bool) if s is None else a[:, 0] == s
        tq = np.ones(len(a), bool) if q is None else a[:, 1] == q
        train = (np.ones(len(a), bool) if s is None else ~ts) & (np.ones(len(a), bool) if q is None else ~tq)
        test = ts & tq
        if not train.any() or not test.any():
            out[design, s, q] = (int(train.sum()), int(test.sum()), None)
            continue
        mean, mid = np.average(x[train], axis=0, weights=w[train]), np.average(y[train], weights=w[train])
        sd = np.sqrt(np.average((x[train] - mean) ** 2, axis=0, weights=w[train]))
        z = (x[train] - mean) / sd
        beta = np.linalg.solve(z.T @ (z * w[train][:, None]) + alpha * np.eye(len(features)), z.T @ (w[train] * (y[train] - mid)))
        p = mid + (x[test] - mean) / sd @ beta
        out[design, s, q] = (int(train.sum()), int(test.sum()), float(np.sqrt(np.mean((p - y[test]) ** 2))))
    return out


def test_all_folds_equal_separate_fits(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        s, q = int(rng.integers(0, 5)), int(rng.integers(1, 5))
        if (s, q) == (2, 3):
            continue  # a cell without rows
        x = rng.normal(1000, 3, 3)
        rows.append((s, q, float(x[0] + 2 * x[1] + s + rng.normal()), float(rng.uniform(0.1, 1)), *map(float, x)))
    rows += [(0, 1, None, 1.0, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s int, q int, y double, w double, a double, b double, level double")
    got = folds.ridge_folds(df, "s", "q", "y", {"one": ["a"], "all": ["a", "b", "level"]}, "w", 5, alpha=3.0, raw="a").collect()
    assert len(got) == 29 * 3
    for model, features in (("one", [0]), ("all", [0, 1, 2])):
        want = separate(rows[:-2], 3.0, features)
        for r in (r for r in got if r["model"] == model):
            train, test, rmse = want[r["design"], r["held_station_fold"], r["held_quarter"]]
            assert (r["train_rows"], r["test_rows"]) == (train, test)
            assert r["state"] == ("scored" if test else "unscored_empty_test") and (r["rmse"] is None) == (rmse is None)
            assert rmse is None or abs(r["rmse"] - rmse) < 2e-6
    assert all(abs(r["rmse"] - 2000) < 100 for r in got if r["model"] == "raw" and r["rmse"])


def test_states_of_folds(spark):
    rows = [(0, 1, 5.0, 1.0, 1.0), (0, 1, 6.0, 1.0, 2.0), (1, 1, 7.0, 1.0, 3.0), (1, 2, 7.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "s int, q int, y double, w double, x double")
    got = {(r["design"], r["held_station_fold"], r["held_quarter"]): r["state"] for r in folds.ridge_folds(df, "s", "q", "y", {"m": ["x"]}, "w", 2).collect()}
    assert got["station", 0, None] == "unscored_insufficient_train"  # one target value, 7
    assert got["station", 1, None] == "unscored_single_target"
    assert got["quarter", None, 1] == "unscored_insufficient_train" and got["quarter", None, 3] == "unscored_empty_test"
    assert got["joint", 0, 2] == "unscored_insufficient_train" and got["joint", 1, 2] == "unscored_single_target"
    assert folds.ridge_folds(df.limit(0), "s", "q", "y", {"m": ["x"]}, "w", 2).collect() == []


def series(step=0.0):
    rng = np.random.default_rng(8)
    days = [date(2015, 1, 1) + timedelta(k) for k in range(365 * 6)]
    out = []
    for s in ("north", "south"):
        for k, d in enumerate(days):
            wind = float(rng.normal())
            y = 30 - 4 * wind + 0.001 * k + float(rng.normal()) + (step if s == "north" and date(2018, 3, 1) <= d <= date(2018, 4, 30) else 0.0)
            out.append((s, d, y, wind, float(k), "x"))
    out.append(("north", date(2018, 3, 10), None, 1.0, 1.0, "x"))
    return out


SERIES = "station string, date date, y double, wind double, k double, n string"


def test_a_step_is_found_within_its_interval(spark):
    events = spark.createDataFrame([("ban", date(2018, 3, 1), date(2018, 4, 30)), ("day", date(2019, 7, 1), None)], "name string, start date, end date")
    df = spark.createDataFrame(series(-6.0), SERIES)
    got = {(r["event"], r["station"]): r for r in causal.counterfactual(df, "station", "date", "y", ["wind", "k"], events).collect()}
    north, south = got["ban", "north"], got["ban", "south"]
    assert north["n_days"] == 61 and north["ci_low"] <= -6 <= north["ci_high"] and north["ci_high"] < -5 and north["z"] < -10 and north["placebo_n"] == 4
    assert abs(south["effect"]) < 0.5 and south["ci_low"] < 0.2 and abs(north["observed_mean"] - north["predicted_mean"] - north["effect"]) < 1e-5
    assert got["day", "north"]["refusal"] == "few_days" and got["day", "north"]["effect"] is None
    # one fit by hand
    rows = [r for r in series(-6.0) if r[0] == "north" and r[2] is not None]
    away = [r for r in rows if not date(2018, 1, 30) <= r[1] <= date(2018, 5, 30)]
    inside = [r for r in rows if date(2018, 3, 1) <= r[1] <= date(2018, 4, 30)]
    beta, *_ = np.linalg.lstsq(np.array([[1, r[3], r[4]] for r in away]), np.array([r[2] for r in away]), rcond=None)
    assert north["train_days"] == len(away) and abs(north["effect"] - np.mean([r[2] - beta @ [1, r[3], r[4]] for r in inside])) < 1e-5
    few = causal.counterfactual(df.where("date < '2016-01-01'"), "station", "date", "y", ["wind", "k"], events.where("name = 'ban'")).collect()
    assert few == [] and causal.counterfactual(df.limit(0), "station", "date", "y", ["wind"], events).collect() == []


def test_trend_breaks_and_their_placebos(spark):
    months = [date(2005 + k // 12, k % 12 + 1, 1) for k in range(240)]
    rng = np.random.default_rng(3)
    bent = [("bent", d, 100 - 1.0 * k / 12 - (3.0 * max(0, k - 120) / 12) + float(rng.normal(0, 0.3))) for k, d in enumerate(months)]
    flat = [("flat", d, 50 + float(rng.normal(0, 0.3))) for d in months]
    short = [("short", d, 1.0) for d in months[:20]]
    df = spark.createDataFrame(bent + flat + short, "station string, month date, v double")
    events = spark.createDataFrame([("law", date(2015, 1, 1)), ("edge", date(2005, 6, 1))], "name string, when date")
    got = {(r["event"], r["station"]): r for r in causal.trend_breaks(df, "station", "month", "v", events).collect()}
    assert set(got) == {("law", "bent"), ("law", "flat")}  # too short a side, or series, gives no row
    assert abs(got["law", "bent"]["delta"] + 3) < 0.1 and got["law", "bent"]["z"] < -1 and abs(got["law", "flat"]["z"]) < 3
    t = np.array([(d - months[0]).days / 365.25 for d in months])
    v = np.array([x[2] for x in bent])
    deltas = [np.polyfit(t[t >= c], v[t >= c], 1)[0] - np.polyfit(t[t < c], v[t < c], 1)[0] for c in np.arange(1, t[-1] - 1, 0.25) if abs(c - t[120]) >= 3]
    r = got["law", "bent"]
    assert r["placebo_n"] == len(deltas) and abs(r["placebo_mean"] - np.mean(deltas)) < 1e-5 and abs(r["placebo_sd"] - np.std(deltas, ddof=1)) < 1e-5


def gappy(spark, n=1200):
    rng = np.random.default_rng(1)
    rows, start = [], datetime(2020, 1, 1)
    for e, top in (("a", 9), ("b", 3)):
        k = 0
        while k < n:
            for known, run in ((True, int(rng.integers(25, 60))), (False, int(rng.integers(1, top)))):
                rows += [(e, start + timedelta(hours=k + j), float(k + j) if known else None, 0) for j in range(run)]
                k += run
    rows += [("whole", start + timedelta(hours=j), 1.0, 0) for j in range(50)]
    return spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double, first int"), rows


def test_hidden_runs_are_as_long_as_gaps(spark):
    df, rows = gappy(spark)
    missing = {e: sum(r[2] is None for r in rows if r[0] == e) for e in "ab"}
    known = {e: sum(r[2] is not None for r in rows if r[0] == e) for e in "ab"}
    share = missing["a"] / known["a"]  # one run for each gap of a
    got = gapfill.hide_like_gaps(df, "entity", "ts", "value", share, attempts=40, rounds=12).orderBy("entity", "ts").collect()
    assert len(got) == len(rows) and not any(r["hidden"] for r in got if r["entity"] == "whole")
    runs, gaps = [], []
    for e in "ab":
        mine = [r for r in got if r["entity"] == e]
        real = [r[2] for r in sorted(x for x in rows if x[0] == e)]
        for r, v in zip(mine, real):
            assert r["hidden"] == (r["truth"] is not None) == (r["gap_length"] is not None) and (v is None or (r["truth"] if r["hidden"] else r["value"]) == v)
        for seen, want in ((runs, [r["gap_length"] if r["hidden"] else None for r in mine]), (gaps, [None if v is not None else 1 for v in real])):
            k = 0
            while k < len(want):
                n = 1
                if want[k] is not None:
                    n = want[k] if seen is runs else next((j for j in range(len(want) - k) if want[k + j] is None), len(want) - k)
                    assert all(x is not None for x in want[k : k + n])
                    seen.append((e, n))
                k += n
    a = lambda x: sorted(n for e, n in x if e == "a")
    assert a(runs) == a(gaps)  # all were placed, each as long as its gap
    b = [n for e, n in runs if e == "b"]
    assert b and max(b) <= 2 and abs(np.mean([n == 1 for n in b]) - np.mean([n == 1 for e, n in gaps if e == "b"])) < 0.2
    assert gapfill.hide_like_gaps(df.where("entity = 'whole'"), "entity", "ts", "value", 0.5).where("hidden").count() == 0


def test_draws_of_chained_regressions(spark):
    rng = np.random.default_rng(6)
    rows, truth = [], {}
    for k in range(600):
        x = float(rng.normal())
        y, z = 2 * x + float(rng.normal(0, 0.5)), float(rng.normal())
        truth[k] = y
        rows.append((k, x, None if k % 4 == 0 else y, None if k % 7 == 0 else z, "s"))
    df = spark.createDataFrame(rows, "k long, x double, y double, z double, sigma string")
    draws = gapfill.chained_draws(df, ["k"], ["x", "y", "z"], draws=8)
    got = {r["k"]: r for r in gapfill.posterior_summary(draws, ["k"], ["x", "y", "z"]).collect()}
    assert len(got) == 600 and draws.count() == 4800
    lost = [k for k in got if k % 4 == 0]
    assert all(got[k]["y_sd"] == 0 and abs(got[k]["y"] - truth[k]) < 1e-9 for k in got if k % 4)
    assert abs(np.mean([got[k]["y_sd"] for k in lost]) - 0.5) < 0.1  # as uncertain as the residuals
    assert np.sqrt(np.mean([(got[k]["y"] - truth[k]) ** 2 for k in lost])) < 0.65
