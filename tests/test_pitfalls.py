"""Pitfalls of regressions: few passes over the rows, and the same figures as plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest

from aerolith.operators import pitfalls


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, rng.random() * 9, rng.choice([None, math.nan, rng.random()]), i % 6) for i in range(400)]
    return [(k, 2 * a + rng.gauss(0, 5), a, b, f) for k, a, b, f in out]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k long, y double, a double, b double, fold long").cache()


def r2(y, xs):
    x = np.column_stack([np.ones(len(y)), *xs])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_passes_do_not_grow_with_folds_or_models(spark, df):
    assert jobs(spark, "optimism", lambda: pitfalls.optimism(df, "y", ["a"], "fold")) < 8
    assert jobs(spark, "leak", lambda: pitfalls.leakage_price(df, "y", ["a"], "b")) < 4


def test_leakage_and_optimism(df, rows):
    got = pitfalls.leakage_price(df, "y", ["a"], "b").first()
    known = np.array([r for r in rows if r[3] is not None and not math.isnan(r[3])])
    every = np.array([(r[1], r[2]) for r in rows])
    assert got["r2_without"] == pytest.approx(r2(every[:, 0], [every[:, 1]])) and got["r2_with"] == pytest.approx(r2(known[:, 1], [known[:, 2], known[:, 3]]))
    y, a, fold = every[:, 0], every[:, 1], np.array([r[4] for r in rows])
    for r in pitfalls.optimism(df, "y", ["a"], "fold").collect():
        train, test = fold != r["fold"], fold == r["fold"]
        slope, level = np.polyfit(a[train], y[train], 1)
        e = y[test] - level - slope * a[test]
        assert r["r2_in"] == pytest.approx(r2(y[train], [a[train]])) and r["r2_out"] == pytest.approx(1 - e @ e / (y[test].var() * test.sum()))
    assert pitfalls.optimism(df.where("fold = 1"), "y", ["a"], "fold").collect() == [] == pitfalls.optimism(df.limit(0), "y", ["a"], "fold").collect()


@pytest.mark.parametrize("key", [["k"], ["k", "fold"], []])
def test_draws_are_the_digests(df, rows, key):
    steps = np.cumsum([np.exp(-1) / math.factorial(j) for j in range(6)])
    y, x = np.array([r[1] for r in rows]), np.column_stack([np.ones(len(rows)), [r[2] for r in rows]])
    fits = []
    for d in range(5):
        u = [int(hashlib.md5("|".join([*(str(r["k fold".split().index(c) * 4]) for c in key), str(3000 + d)]).encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
        w = np.array([(v > steps).sum() for v in u])
        fits.append(np.linalg.pinv(x.T @ (x * w[:, None])) @ (x.T @ (w * y)))
    got = {r["term"]: r for r in pitfalls.sign_stability(df, "y", ["a"], key, 5, 3).collect()}
    for i, term in enumerate(("intercept", "a")):
        c = np.array(fits)[:, i]
        assert (got[term]["mean"], got[term]["sd"]) == pytest.approx((c.mean(), c.std()), abs=1e-9) and got[term]["same_sign"] == max((c > 0).mean(), (c < 0).mean())
