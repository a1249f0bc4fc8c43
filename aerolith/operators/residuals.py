"""Regression residuals in space and in clusters: Moran's I under the fitted null, covariances that admit dependence.

Residuals are not free: a fit of k columns takes k dimensions away, so a plain permutation is no
null for them. Moments come from traces of products of the residual maker M = I - X A X' (A the
inverse of X'X) with the weights W; as trace(X A X' V) = trace(A X'V X), sums over edges and
k x k matrices are enough and no n x n matrix is ever made. Simulated residuals are M e, e normal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.maths import digest
from aerolith.operators import joins, networks
from aerolith.session import cut


def normal(*parts) -> Column:
    """A standard normal from the digest of its parts (Box and Muller): the same on any engine."""
    d = digest(*parts)
    u, v = (F.conv(F.substring(d, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.sqrt(-2 * F.log((u + 0.5) / float(1 << 32))) * F.cos(2 * math.pi * v / float(1 << 32))


def moments(a: np.ndarray, xwx: np.ndarray, lags: np.ndarray, backs: np.ndarray, cross: np.ndarray, s0: float, ww: float, wwt: float, n: int) -> tuple[float | None, float | None]:
    """E[I] and Var[I] of residuals. xwx = X'WX, lags = X'W'WX, backs = X'WW'X, cross = X'WWX; ww, wwt the traces of WW and WW'."""
    k = len(a)
    if n - k <= 2:
        return None, None
    b = a @ xwx
    mw = -float(np.trace(b))
    mwmw = ww - 2 * float(np.trace(a @ cross)) + float(np.trace(b @ b))
    mwmwt = wwt - float(np.trace(a @ backs)) - float(np.trace(a @ lags)) + float(np.trace(b @ a @ xwx.T))
    e = n / s0 * mw / (n - k)
    return e, (n / s0) ** 2 * (mwmwt + mwmw + mw**2) / ((n - k) * (n - k + 2)) - e**2


def _on(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by) if by else a.crossJoin(b)  # one row on either side


def residual_moran(df: DataFrame, by: list[str], key: str, y: str, xs: list[str], edges: DataFrame, neighbour: str = "neighbour", draws: int = 99, seed: int = 1) -> DataFrame:
    """Per group: n, k, moran_i of the least-squares residuals of y on xs, expected, variance, z, and p of `draws` simulated residuals.

    Edges are directed; weights are 1 / degree among the group's present points. p is two-sided
    about the expectation. Null and without p where the residuals or the network are nothing.
    """
    k = len(xs) + 1
    cells = [(i, j) for i in range(k) for j in range(k)]
    x = ["__x0", *(f"__x{i + 1}" for i in range(len(xs)))]
    # own names for the caller's columns, which may be called anything
    named, by = by, [f"__by{i}" for i in range(len(by))]
    rows = df.dropna(subset=[key, y, *xs]).select(*(F.col(c).alias(b) for c, b in zip(named, by)), F.col(key).alias("__key"), F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("__x0"), *(F.col(c).cast("double").alias(x[i + 1]) for i, c in enumerate(xs)))
    edges, key = edges.select(F.col(key).alias("__key"), F.col(neighbour).alias("__nb")), "__key"
    types = dict(rows.dtypes)
    head = "".join(f"{c} {types[c]}, " for c in by)
    dot = lambda array, names, at=0: sum((F.col(array)[at + i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))

    grams = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col(x[i]) * F.col(x[j])) for i, j in cells)).alias("g"), F.array(*(F.sum(F.col(c) * F.col("__y")) for c in x)).alias("b"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[p["n"] > k]
            inverse = [np.linalg.pinv(np.array(g, dtype=float).reshape(k, k)) for g in p["g"]]
            yield p[[*by, "n"]].assign(a=[m.ravel() for m in inverse], beta=[m @ np.array(b, dtype=float) for m, b in zip(inverse, p["b"])])

    fits = grams.mapInPandas(invert, f"{head}n long, a array<double>, beta array<double>")
    # written once each: all that follows starts from the residuals and the weighted edges, else the plan holds them dozens of times
    fits = cut(fits)
    rows = cut(_on(rows, fits, by).select(*by, "__key", *x, (F.col("__y") - dot("beta", x)).alias("__e")))
    # edges of present points, weighing 1 / degree
    other = lambda names: rows.select(*by, F.col(key).alias("__nb"), *(F.col(c).alias(f"{c}n") for c in names))
    links = rows.select(*by, key).join(edges, key).join(other([]), [*by, "__nb"])
    links = cut(links.join(links.groupBy(*by, key).agg((1.0 / F.count(F.lit(1))).alias("w")), [*by, key]))
    met = links.join(rows.select(*by, key, "__e", *x), [*by, key]).join(other(["__e", *x]), [*by, "__nb"])
    back = links.select(*by, F.col(key).alias("__nb"), F.col("__nb").alias(key), F.col("w").alias("wb"))
    met = cut(met.join(back, [*by, key, "__nb"], "left"))
    w = F.col("w")
    over_edges = met.groupBy(*by).agg(
        F.sum("w").alias("s0"), F.sum(w * w).alias("wwt"), F.sum(w * F.coalesce("wb", F.lit(0.0))).alias("ww"), F.sum(w * F.col("__e") * F.col("__en")).alias("num"), F.array(*(F.sum(w * F.col(x[i]) * F.col(f"{x[j]}n")) for i, j in cells)).alias("xwx")
    )
    lag = met.groupBy(*by, F.col(key).alias("__p")).agg(*(F.sum(w * F.col(f"{c}n")).alias(f"l{i}") for i, c in enumerate(x)))
    pull = met.groupBy(*by, F.col("__nb").alias("__p")).agg(*(F.sum(w * F.col(c)).alias(f"b{i}") for i, c in enumerate(x)))
    points = lag.join(pull, [*by, "__p"], "full").na.fill(0.0)
    of = lambda p, q: F.array(*(F.sum(F.col(f"{p}{i}") * F.col(f"{q}{j}")) for i, j in cells))
    over_points = points.groupBy(*by).agg(of("l", "l").alias("lags"), of("b", "b").alias("backs"), of("b", "l").alias("cross"))
    sums = _on(_on(_on(fits.drop("beta"), over_edges, by), over_points, by), rows.groupBy(*by).agg(F.sum(F.col("__e") * F.col("__e")).alias("den")), by)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = lambda v: np.array(v, dtype=float).reshape(k, k)
        for p in batches:
            told = [moments(*(square(r[c]) for c in ("a", "xwx", "lags", "backs", "cross")), r["s0"], r["ww"], r["wwt"], int(r["n"])) for r in p.to_dict("records")]
            yield p[[*by, "n", "s0", "num", "den"]].assign(expected=[t[0] for t in told], variance=[t[1] for t in told])

    real = sums.mapInPandas(judge, f"{head}n long, s0 double, num double, den double, expected double, variance double")
    real = cut(real).withColumn("i", F.when(F.col("den") > 1e-12, F.col("n") / F.col("s0") * F.col("num") / F.col("den")))
    # simulated residuals: e - X A X'e, all draws as groups of one plan
    noise = rows.select(*by, key, *x, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    noise = noise.withColumn("__e", normal(*(F.col(c) for c in by), F.col(key), F.col("draw"), seed))
    xe = noise.groupBy(*by, "draw").agg(*(F.sum(F.col(c) * F.col("__e")).alias(f"e{i}") for i, c in enumerate(x)))
    part = _on(xe, fits.select(*by, "a"), by).select(*by, "draw", *(dot("a", [f"e{j}" for j in range(k)], i * k).alias(f"c{i}") for i in range(k)))
    drawn = cut(noise.join(part, [*by, "draw"]).select(*by, key, "draw", (F.col("__e") - sum((F.col(f"c{i}") * F.col(c) for i, c in enumerate(x)), F.lit(0.0))).alias("r")))
    squares = drawn.groupBy(*by, "draw").agg(F.sum(F.col("r") * F.col("r")).alias("den"))
    pairs = links.join(drawn, [*by, key]).join(drawn.select(*by, F.col(key).alias("__nb"), "draw", F.col("r").alias("rn")), [*by, "__nb", "draw"])
    null = pairs.groupBy(*by, "draw").agg(F.sum(w * F.col("r") * F.col("rn")).alias("num")).join(squares, [*by, "draw"]).where("den > 1e-12")
    null = _on(null.select(*by, F.col("num").alias("dnum"), F.col("den").alias("dden")), real, by)
    far = F.abs(F.col("n") / F.col("s0") * F.col("dnum") / F.col("dden") - F.col("expected")) >= F.abs(F.col("i") - F.col("expected"))
    p = null.groupBy(*by).agg(((F.count_if(far) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    out = _on(real, p, by) if not by else real.join(p, by, "left")
    z = F.when(F.col("variance") > 0, (F.col("i") - F.col("expected")) / F.sqrt("variance"))
    return out.select(*(F.col(b).alias(c) for c, b in zip(named, by)), "n", F.lit(k).alias("k"), F.round("i", 6).alias("moran_i"), F.round("expected", 6).alias("expected"), F.round("variance", 6).alias("variance"), F.round(z, 4).alias("z"), F.when(F.col("i").isNotNull(), F.round("p", 6)).alias("p"))


def residual_moran_within(df: DataFrame, by: list[str], key: str, y: str, xs: list[str], km: float, lat: str = "lat", lon: str = "lon", draws: int = 99, seed: int = 1) -> DataFrame:
    """As `residual_moran` over all points at most km apart, by sums over places: no edge between two points is made, no draw is written for each point.

    Weights are 1 / degree, so all traces follow from the symmetric adjacency times columns (`joins.neighbour_sums`). Keys are unique in a group.
    """
    k = len(xs) + 1
    cells = [(i, j) for i in range(k) for j in range(k)]
    x = ["__x0", *(f"__x{i + 1}" for i in range(len(xs)))]
    named, by = by, [f"__by{i}" for i in range(len(by))]
    places = [F.col(c).cast("double").alias(n) for c, n in ((lat, "__lat"), (lon, "__lon"))]
    rows = df.dropna(subset=[key, y, *xs]).select(*(F.col(c).alias(b) for c, b in zip(named, by)), F.col(key).alias("__key"), F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("__x0"), *(F.col(c).cast("double").alias(x[i + 1]) for i, c in enumerate(xs)), *places)
    types = dict(rows.dtypes)
    head = "".join(f"{c} {types[c]}, " for c in by)
    dot = lambda array, names, at=0: sum((F.col(array)[at + i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    grams = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col(x[i]) * F.col(x[j])) for i, j in cells)).alias("g"), F.array(*(F.sum(F.col(c) * F.col("__y")) for c in x)).alias("b"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[p["n"] > k]
            inverse = [np.linalg.pinv(np.array(g, dtype=float).reshape(k, k)) for g in p["g"]]
            yield p[[*by, "n"]].assign(a=[m.ravel() for m in inverse], beta=[m @ np.array(b, dtype=float) for m, b in zip(inverse, p["b"])])

    fits = cut(grams.mapInPandas(invert, f"{head}n long, a array<double>, beta array<double>"))
    pairs = joins.place_pairs(rows, "__lat", "__lon", km)
    rows = cut(_on(rows, fits, by).select(*by, "__key", "__lat", "__lon", *x, (F.col("__y") - dot("beta", x)).alias("__e")))
    near = joins.neighbour_sums(pairs, rows, by, ["__e", *x]).where("near___x0 > 0").withColumn("__w", 1.0 / F.col("near___x0"))
    near = joins.neighbour_sums(pairs, near.withColumns({f"__v{i}": F.col("__w") * F.col(c) for i, c in enumerate(x)}), by, [f"__v{i}" for i in range(k)])
    near = cut(near.withColumns({f"__l{i}": F.col("__w") * F.col(f"near_{c}") for i, c in enumerate(x)}).withColumnsRenamed({f"near___v{i}": f"__b{i}" for i in range(k)}))
    w, of = F.col("__w"), lambda p, q: F.array(*(F.sum(F.col(p(i)) * F.col(q(j))) for i, j in cells))
    own, lag, pull = (lambda i: x[i]), (lambda i: f"__l{i}"), (lambda i: f"__b{i}")
    over = near.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum("__w").alias("wwt"), F.sum(w * F.col("__b0")).alias("ww"), F.sum(w * F.col("__e") * F.col("near___e")).alias("num"),
        of(own, lag).alias("xwx"), of(lag, lag).alias("lags"), of(pull, pull).alias("backs"), of(pull, lag).alias("cross"),
    )
    den = rows.groupBy(*by).agg(F.sum(F.col("__e") * F.col("__e")).alias("den"))
    sums = _on(fits.drop("beta"), den, by)
    sums = (sums.join(over, by, "left") if by else sums.crossJoin(over)).withColumn("s0", F.when(F.col("s0") > 0, F.col("s0")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = lambda v: np.array(v, dtype=float).reshape(k, k)
        for p in batches:
            told = [moments(*(square(r[c]) for c in ("a", "xwx", "lags", "backs", "cross")), r["s0"], r["ww"], r["wwt"], int(r["n"])) if r["s0"] > 0 else (None, None) for r in p.to_dict("records")]
            yield p[[*by, "n", "s0", "num", "den"]].assign(expected=[t[0] for t in told], variance=[t[1] for t in told])

    real = sums.mapInPandas(judge, f"{head}n long, s0 double, num double, den double, expected double, variance double")
    real = cut(real).withColumn("i", F.when(F.col("den") > 1e-12, F.col("n") / F.col("s0") * F.col("num") / F.col("den")))
    # points are few beside their draws, so the tasks follow from the draws
    tasks = 1 + int((fits.agg(F.sum("n")).first()[0] or 0) * draws // 250_000)
    noise = rows.repartition(min(tasks, 4096), "__key").select(*by, "__key", "__lat", "__lon", *x, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    noise = noise.withColumn("__e", normal(*(F.col(c) for c in by), F.col("__key"), F.col("draw"), seed))
    xe = noise.groupBy(*by, "draw").agg(*(F.sum(F.col(c) * F.col("__e")).alias(f"e{i}") for i, c in enumerate(x)))
    part = cut(_on(xe, fits.select(*by, "a"), by).select(*by, "draw", *(dot("a", [f"e{j}" for j in range(k)], i * k).alias(f"c{i}") for i in range(k))))
    drawn = noise.join(part, [*by, "draw"]).withColumn("r", F.col("__e") - sum((F.col(f"c{i}") * F.col(c) for i, c in enumerate(x)), F.lit(0.0)))
    weights = near.groupBy(*by, "__lat", "__lon").agg(F.max("__w").alias("__w"))
    null = networks.products(pairs, drawn.select(*by, "__lat", "__lon", "draw", "r"), weights, by, "r").where("den > 1e-12")
    null = _on(null.select(*by, F.col("num").alias("dnum"), F.col("den").alias("dden")), real, by)
    far = F.abs(F.col("n") / F.col("s0") * F.col("dnum") / F.col("dden") - F.col("expected")) >= F.abs(F.col("i") - F.col("expected"))
    p = null.groupBy(*by).agg(((F.count_if(far) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    out = _on(real, p, by) if not by else real.join(p, by, "left")
    z = F.when(F.col("variance") > 0, (F.col("i") - F.col("expected")) / F.sqrt("variance"))
    return out.select(*(F.col(b).alias(c) for c, b in zip(named, by)), "n", F.lit(k).alias("k"), F.round("i", 6).alias("moran_i"), F.round("expected", 6).alias("expected"), F.round("variance", 6).alias("variance"), F.round(z, 4).alias("z"), F.when(F.col("i").isNotNull(), F.round("p", 6)).alias("p"))


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta at df / (df + t^2), by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        # 1 / (1 + d1 / (1 + d2 / ...)), each denominator from the two before it
        tiny, c, d, h = 1e-300, 1.0, 0.0, 1.0
        for m in range(400):
            tops = [-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))]
            if m:
                tops.insert(0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            for top in tops:
                d = 1 / ((1 + top * d) or tiny)
                c = (1 + top / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return 1 / h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    # the fraction converges fast on this side of the mean, else by symmetry
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def clipped(covariance: np.ndarray) -> tuple[np.ndarray, bool]:
    """The covariance with negative eigenvalues at 0, and whether it had any."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    if values.min() >= 0:
        return covariance, False
    return vectors @ np.diag(np.maximum(values, 0)) @ vectors.T, True


def covariances(df: DataFrame, y: str, xs: list[str], first: str, second: str) -> DataFrame:
    """term, cov_type, coef, se, t, p, inflation, clipped: one fit under independent errors, errors clustered either way, and both.

    Scores are summed once for each cell of the two clusterings; grouping sets of the cells give the
    three meats, so the rows are read twice in all (the fit, the scores). Two-way is first plus second less their
    cells; where that is no covariance its negative eigenvalues are cut, which `clipped` says. Single clusterings carry
    the usual factor G / (G - 1) * (n - 1) / (n - k), cells none.
    """
    names = ["intercept", *xs]
    k = len(names)
    rows = df.select(F.col(y).cast("double").alias("__y"), F.col(first).alias("__a"), F.col(second).alias("__b"), F.lit(1.0).alias("x0"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs, 1))).dropna()
    x = [F.col(f"x{i}") for i in range(k)]
    got = rows.agg(F.count(F.lit(1)), *(F.sum(p * q) for p in x for q in x), *(F.sum(p * F.col("__y")) for p in x)).first()
    spark, n = df.sparkSession, got[0]
    schema = "term string, cov_type string, coef double, se double, t double, p double, inflation double, clipped boolean"
    if n <= k:
        return spark.createDataFrame([], schema)
    bread = np.linalg.pinv(np.array(got[1 : k * k + 1], dtype=float).reshape(k, k))
    beta = bread @ np.array(got[k * k + 1 :], dtype=float)
    e = F.col("__y") - sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
    cells = rows.withColumn("__e", e).groupBy("__a", "__b").agg(*(F.sum(c * F.col("__e")).alias(f"s{i}") for i, c in enumerate(x)), F.sum(F.col("__e") * F.col("__e")).alias("ee"))
    sets = cells.groupingSets([["__a", "__b"], ["__a"], ["__b"]], "__a", "__b").agg(F.grouping_id().alias("which"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)), F.sum("ee").alias("ee"))
    meats = sets.groupBy("which").agg(F.count(F.lit(1)).alias("g"), F.sum("ee").alias("ee"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)))
    found = {r["which"]: r for r in meats.collect()}  # three rows: 0 cells, 1 without b, 2 without a
    spread = lambda r: bread @ np.array([r[f"m{i}_{j}"] for i in range(k) for j in range(k)]).reshape(k, k) @ bread
    factor = lambda g: g / (g - 1) * (n - 1) / (n - k) if g > 1 else math.nan
    one, two = (spread(found[w]) * factor(found[w]["g"]) for w in (1, 2))
    both, cut = clipped(one + two - spread(found[0])) if np.isfinite(one + two).all() else (one + two, False)
    kinds = {"iid": found[0]["ee"] / (n - k) * bread, first: one, second: two, "two_way": both}
    out = []
    for kind, v in kinds.items():
        for j, name in enumerate(names):
            se, iid = (math.sqrt(max(float(m[j, j]), 0.0)) if np.isfinite(m[j, j]) else None for m in (v, kinds["iid"]))
            t = float(beta[j]) / se if se else None
            out.append((name, kind, float(beta[j]), se, t, t_tail(t, n - k) if t is not None else None, se / iid if se is not None and iid else None, kind == "two_way" and cut))
    return spark.createDataFrame(out, schema)
