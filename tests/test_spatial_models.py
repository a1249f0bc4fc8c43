"""Kriging, residual Moran, clustered covariances and regions against dense linear algebra and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import kriging, regions, residuals


def towns(n, seed, field=lambda x, y: 0.0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(20, 24, n), rng.uniform(110, 114, n)
    return [(i, float(a), float(b), float(field(a, b))) for i, (a, b) in enumerate(zip(x, y))]


def test_kriging_equals_the_covariance_form():
    rng = np.random.default_rng(3)
    lat, lon, z = rng.uniform(20, 23, 25), rng.uniform(110, 113, 25), rng.normal(10, 3, 25)
    for shape in kriging.SHAPES.values():
        apart = kriging.kilometres(lat[:, None], lon[:, None], lat, lon)
        i, j = np.triu_indices(25, 1)
        nugget, sill, reach = kriging.fit_variogram(apart[i, j], (z[i] - z[j]) ** 2 / 2, shape)
        assert nugget >= 0 and sill >= 0
        got, sd, failed = kriging.krige(lat, lon, z, 21.5, 111.5, shape)
        # by covariances C(h) = nugget + sill - gamma(h) and generalised least squares
        cov = lambda h: np.where(h > 0, sill - sill * shape(h / reach), nugget + sill)
        c, c0, one = cov(apart), cov(kriging.kilometres(lat, lon, 21.5, 111.5)), np.ones(25)
        inv = np.linalg.inv(c)
        mean = one @ inv @ z / (one @ inv @ one)
        assert failed is None and abs(got - (mean + c0 @ inv @ (z - mean))) < 1e-6
        slack = 1 - one @ inv @ c0
        assert abs(sd**2 - (nugget + sill - c0 @ inv @ c0 + slack**2 / (one @ inv @ one))) < 1e-6


def test_variogram_is_recovered():
    h = np.linspace(5, 400, 4000)
    nugget, sill, reach = kriging.fit_variogram(h, 2 + 7 * kriging.SHAPES["exponential"](h / 150), kriging.SHAPES["exponential"], lags=40, ranges=400)
    assert abs(nugget - 2) < 0.1 and abs(sill - 7) < 0.1 and abs(reach - 150) < 5
    assert kriging.krige(np.array([1.0, 2, 3]), np.array([1.0, 2, 3]), np.array([4.0, 4, 4]), 2, 2, kriging.SHAPES["spherical"]) == (4.0, 0.0, None)


def test_folds_keep_their_failures_and_never_see_the_held_point(spark):
    rows = [(m, *t, "x") for m in (1, 2) for t in towns(40, m, lambda a, b: 3 * a + 2 * b)] + [(1, 90, -60.0, 10.0, 5.0, "x"), (1, 91, 22.0, 112.0, None, "x")]
    df = spark.createDataFrame(rows, "month int, key long, lat double, lon double, value double, km string")
    buffers = [0.0, 100.0, 390.0]
    got = kriging.interpolate_held_out(df, ["month"], "key", "value", buffers, 400.0).collect()
    known = [r for r in rows if r[4] is not None]
    assert len(got) == len(known) * 3 * 3
    for r in got:
        own = next(x for x in known if x[0] == r["month"] and x[1] == r["key"])
        train = [(kriging.kilometres(own[2], own[3], x[2], x[3]), x) for x in known if x[0] == own[0] and x[1] != own[1]]
        train = [(float(d), x) for d, x in train if r["buffer_km"] < d <= 400]
        assert r["n_train"] == len(train) and r["observed"] == own[4]
        if len(train) < 8:
            assert r["failed"] == "too_few" and r["predicted"] is None
            continue
        want = {"nearest": min(train)[1][4], "mean": np.mean([x[4] for _, x in train]), "idw2": np.average([x[4] for _, x in train], weights=[1 / d**2 for d, _ in train])}
        assert abs(r["predicted"] - want[r["method"]]) < 1e-6
    kriged = kriging.krige_held_out(df, ["month"], "key", "value", buffers, 400.0, ["gaussian"])
    out = {(r["month"], r["key"], r["buffer_km"]): r for r in kriged.collect()}
    assert len(out) == len(known) * 3 and all((r["failed"] == "too_few") == (r["n_train"] < 8) for r in out.values())
    for own in known[:6]:  # one fold by hand: the 32 nearest beyond the buffer
        near = sorted((float(kriging.kilometres(own[2], own[3], x[2], x[3])), x[1], x) for x in known if x[0] == own[0] and x[1] != own[1])
        near = [x for d, _, x in near if 100 < d <= 400][:32]
        want = kriging.krige(*(np.array([x[c] for x in near]) for c in (2, 3, 4)), own[2], own[3], kriging.SHAPES["gaussian"])
        assert abs(out[own[0], own[1], 100.0]["predicted"] - want[0]) < 1e-6
    errors = {(r["buffer_km"], r["method"]): r for r in kriging.fold_errors(kriged).collect()}
    assert errors[0.0, "kriging_gaussian"]["mae"] < errors[100.0, "kriging_gaussian"]["mae"]


def test_nobody_to_learn_from(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0)], "key long, lat double, lon double, value double")
    assert [(r["n_train"], r["failed"]) for r in kriging.interpolate_held_out(df, [], "key", "value", [0.0], 10.0).collect()] == [(0, "too_few")] * 3
    assert [(r["n_train"], r["failed"]) for r in kriging.krige_held_out(df, [], "key", "value", [0.0], 10.0, ["spherical"]).collect()] == [(0, "too_few")]
    assert kriging.interpolate_held_out(df.limit(0), [], "key", "value", [0.0], 10.0).collect() == []


def dense(points, edges, y, xs):
    n = len(points)
    at = {p: i for i, p in enumerate(points)}
    w = np.zeros((n, n))
    for a, b in edges:
        if a in at and b in at:
            w[at[a], at[b]] = 1
    w = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
    x = np.column_stack([np.ones(n), *xs])
    m = np.eye(n) - x @ np.linalg.solve(x.T @ x, x.T)
    e = m @ y
    k, s0, mw = x.shape[1], w.sum(), m @ w
    expected = n / s0 * np.trace(mw) / (n - k)
    variance = (n / s0) ** 2 * (np.trace(mw @ m @ w.T) + np.trace(mw @ mw) + np.trace(mw) ** 2) / ((n - k) * (n - k + 2)) - expected**2
    return n / s0 * (e @ w @ e) / (e @ e), expected, variance, m, w


def test_residual_moments_against_dense_matrices_and_simulation(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    links = {}
    for g in (1, 2):
        n = 45
        for i in range(n):
            links.update({(i, int(j)): 1 for j in rng.choice(n, 4, replace=False) if j != i})
    edges = sorted(links)
    for g in (1, 2):
        points = [i for i in range(45) if (i + g) % 9]
        x1, x2, y = (rng.normal(size=len(points)) for _ in range(3))
        rows += [(g, i, float(a), float(b), float(c), "z") for i, a, b, c in zip(points, y, x1, x2)]
        want[g] = dense(points, edges, y, [x1, x2])
    rows += [(1, 99, None, 1.0, 1.0, "z"), (3, 1, 1.0, 1.0, 1.0, "z"), (3, 2, 2.0, 1.0, 3.0, "z")]
    df = spark.createDataFrame(rows, "g int, key long, y double, x1 double, x2 double, w string")
    frame = spark.createDataFrame(edges, "key long, neighbour long")
    got = {r["g"]: r for r in residuals.residual_moran(df, ["g"], "key", "y", ["x1", "x2"], frame, draws=199).collect()}
    assert set(got) == {1, 2}  # two points are too few for three columns
    for g, (i, e, v, m, w) in want.items():
        assert abs(got[g]["moran_i"] - i) < 2e-6 and abs(got[g]["expected"] - e) < 2e-6 and abs(got[g]["variance"] - v) < 2e-6
        draws = m @ rng.normal(size=(len(m), 20_000))
        sim = len(m) / w.sum() * np.einsum("ij,ik,kj->j", draws, w, draws) / (draws**2).sum(axis=0)
        assert abs(sim.mean() - e) < 0.005 and abs(sim.var() / v - 1) < 0.2
        assert abs(got[g]["p"] - np.mean(np.abs(sim - e) >= abs(i - e))) < 0.12


def test_noise_is_normal(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(residuals.normal(F.col("id"), 7)).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.02 and abs(np.mean(np.abs(x) > 1.96) - 0.05) < 0.01


@pytest.mark.parametrize("t, df, p", [(12.7062, 1, 0.05), (2.2281, 10, 0.05), (3.1693, 10, 0.01), (1.6449, 10**7, 0.1), (0.0, 5, 1.0), (0.6998, 10, 0.5), (-2.0423, 30, 0.05)])
def test_tail_of_t(t, df, p):
    assert abs(residuals.t_tail(t, df) - p) < 2e-5


def test_covariances_against_dense_sums(spark):
    rng = np.random.default_rng(9)
    n = 600
    a, b = rng.integers(0, 12, n), rng.integers(0, 25, n)
    x = np.column_stack([np.ones(n), rng.normal(size=n) + a / 5, rng.normal(size=n)])
    y = x @ [1, 2, 0] + rng.normal(size=12)[a] + rng.normal(size=25)[b] + rng.normal(size=n)
    df = spark.createDataFrame([(int(p), int(q), float(v), *map(float, u[1:]), "e") for p, q, u, v in zip(a, b, x, y)] + [(1, 1, None, 1.0, 1.0, "e")], "month int, station int, y double, u double, v double, __e string")
    got = {(r["cov_type"], r["term"]): r for r in residuals.covariances(df, "y", ["u", "v"], "month", "station").collect()}
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    k = 3

    def meat(*keys):
        cells = {}
        for row, key in zip(x * e[:, None], zip(*keys)):
            cells[key] = cells.get(key, 0) + row
        return bread @ sum(np.outer(s, s) for s in cells.values()) @ bread, len(cells)

    (va, ga), (vb, gb), (vc, _) = meat(a), meat(b), meat(a, b)
    va, vb = (v * g / (g - 1) * (n - 1) / (n - k) for v, g in ((va, ga), (vb, gb)))
    for kind, v in {"iid": e @ e / (n - k) * bread, "month": va, "station": vb, "two_way": va + vb - vc}.items():
        for j, term in enumerate(("intercept", "u", "v")):
            r = got[kind, term]
            assert abs(r["coef"] - beta[j]) < 1e-9 and abs(r["se"] / math.sqrt(v[j, j]) - 1) < 1e-8 and abs(r["t"] * r["se"] - r["coef"]) < 1e-9 and not r["clipped"]
    assert got["two_way", "intercept"]["inflation"] > 1.5 and got["iid", "u"]["p"] < 1e-6 < got["two_way", "v"]["p"]
    assert residuals.covariances(df.limit(2), "y", ["u", "v"], "month", "station").collect() == []


def test_negative_eigenvalues_are_cut_and_said():
    v, cut = residuals.clipped(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert cut and np.allclose(v, [[1.5, 1.5], [1.5, 1.5]])
    assert residuals.clipped(np.eye(2))[1] is False


def slow_ward(d):
    """Merges of the nearest pair, again and again: {(frozenset of members): height}."""
    sizes = {i: [i] for i in range(len(d))}
    dist = {(i, j): d[i][j] ** 2 for i in sizes for j in sizes if i != j}
    out = {}
    while len(sizes) > 1:
        i, j = min(((a, b) for a, b in dist if a < b), key=lambda p: (dist[p], *p))
        out[frozenset(sizes[i] + sizes[j])] = math.sqrt(dist[i, j])
        ni, nj = len(sizes[i]), len(sizes[j])
        for k in sizes:
            if k not in (i, j):
                nk = len(sizes[k])
                dist[i, k] = dist[k, i] = ((ni + nk) * dist[i, k] + (nj + nk) * dist[j, k] - nk * dist[i, j]) / (ni + nj + nk)
        sizes[i] = sizes[i] + sizes.pop(j)
        dist = {p: v for p, v in dist.items() if j not in p}
    return out


def test_ward_against_merging_one_pair_at_a_time(spark):
    rng = random.Random(4)
    points = [(rng.gauss(5 * (i % 3), 1), rng.gauss(0, 1)) for i in range(17)]
    d = [[math.dist(p, q) for q in points] for p in points]
    pairs = spark.createDataFrame([(i, j, d[i][j]) for i in range(17) for j in range(17) if i != j], "k long, nb long, d double")
    tree = regions.ward(pairs, "k", "nb", "d")
    members, want = {i: [i] for i in range(17)}, slow_ward(d)
    rows = sorted(tree.collect(), key=lambda r: r["height"])
    assert len(rows) == 16
    for r in rows:
        members[r["into"]] = members[r["into"]] + members.pop(r["gone"])
        assert abs(want[frozenset(members[r["into"]])] - r["height"]) < 1e-9 and len(members[r["into"]]) == r["size"]
    labels = regions.cut_tree(tree, pairs, "k", 3)
    got = {r["k"]: r["label"] for r in labels.collect()}
    assert len(set(got.values())) == 3 and all(got[got[k]] == got[k] for k in got)
    s = {r["k"]: r["silhouette"] for r in regions.silhouettes(pairs, labels, "k", "nb", "d").collect()}
    for k in got:
        mean = lambda c: np.mean([d[k][j] for j in got if got[j] == c and j != k])  # noqa: B023, E731
        a, b = mean(got[k]), min(mean(c) for c in set(got.values()) - {got[k]})
        assert abs(s[k] - (b - a) / max(a, b)) < 2e-6
    assert regions.ward(pairs.limit(0), "k", "nb", "d").collect() == []


def test_agreement_of_partitions(spark):
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "p int, q string")
    assert tuple(regions.agreement(same, "p", "q").first()) == (30, 1.0, 1.0)
    # 2 x 2 cells of 1, 1, 1, 1: independent
    r = regions.agreement(spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (None, 1)], "p int, q int"), "p", "q").first()
    assert tuple(r) == (4, -0.5, 0.0)
    assert tuple(regions.agreement(spark.createDataFrame([(0, 0), (0, 0)], "p int, q int"), "p", "q").first()) == (2, 1.0, 1.0)
