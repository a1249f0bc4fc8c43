"""Statistics from sums that Spark gathers: regression, association, trends, spatial autocorrelation.

Matrices are k x k for k columns; only they reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import average_rank, correlation, digest


def two_sided_p(t: float, freedom: float) -> float:
    """The odds of a Student's t at least as far from 0, by the incomplete beta function's continued fraction."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if not 0 < x < 1:
        return float(x >= 1)
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0  # the fraction from its end: terms alternate between two forms
    for m in range(300 + int(5 * math.sqrt(max(a, b))), 0, -1):
        k = m // 2
        term = k * (b - k) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m))
        value = 1 + term / value
    share = front / value
    return float(min(1.0, max(0.0, 1 - share if turned else share)))


def least_squares_sums(y: str, xs: list[str]) -> list:
    """Aggregates for `least_squares` with intercept, over rows that know y and all of xs (as dropna: neither null nor NaN)."""
    known = F.lit(True)
    for c in (y, *xs):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    terms = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    yc = F.col(y).cast("double")
    k = len(terms)
    products = [terms[i] * terms[j] for i in range(k) for j in range(i, k)] + [t * yc for t in terms] + [yc * yc]
    return [F.sum(F.when(known, p)) for p in products]


def least_squares(names: list[str], sums) -> list[dict]:
    """term, coef, se, t, p, vif, r2, n of each name (the intercept first) from their sums; none where rows are no more than names."""
    got = [float(v or 0) for v in sums]
    k = len(names)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    a = a + np.triu(a, 1).T
    b, yy = np.array(got[k * (k + 1) // 2 : -1]), got[-1]
    n = a[0, 0]
    if n <= k:
        return []
    inv = np.linalg.pinv(a)
    coef = inv @ b
    rss, tss = yy - coef @ b, yy - b[0] ** 2 / n
    se = np.sqrt(np.maximum(rss / (n - k) * np.diag(inv), 0))
    mean = a[0, 1:] / n
    cov = a[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    vif = [None, *np.diag(np.linalg.pinv(cov / np.outer(sd, sd)))] if k > 1 else [None]
    rows = [(m, float(c), float(s), float(c / s) if s else None, two_sided_p(float(c / s), float(n - k)) if s else None, None if v is None else float(v), float(1 - rss / tss) if tss else None, int(n)) for m, c, s, v in zip(names, coef, se, vif)]
    return [dict(zip(("term", "coef", "se", "t", "p", "vif", "r2", "n"), r)) for r in rows]


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, se, t, p (two-sided, Student's t), vif, r2, n of least squares with intercept over rows without nulls; all sums in one pass."""
    rows = df.select(y, *xs).dropna()
    fit = least_squares(["intercept", *xs], rows.agg(*least_squares_sums(y, xs)).first())
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in fit], "term string, coef double, se double, t double, p double, vif double, r2 double, n long")


def segmented_slopes(df: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """Slopes before and from a break, and their difference."""
    left, right = F.col(x) < at, F.col(x) >= at
    return df.groupBy(*by).agg(
        F.round(F.regr_slope(F.when(left, F.col(y)), F.when(left, F.col(x))), 6).alias("slope_before"),
        F.round(F.regr_slope(F.when(right, F.col(y)), F.when(right, F.col(x))), 6).alias("slope_after"),
        F.count_if(left).alias("n_before"),
        F.count_if(right).alias("n_after"),
    )


def theil_sen(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of a series of monthly or yearly points (a short series by construction)."""
    a = df.select(*by, F.col(x).alias("__x1"), F.col(y).alias("__y1"))
    b = df.select(*by, F.col(x).alias("__x2"), F.col(y).alias("__y2"))
    pairs = (a.join(b, by) if by else a.crossJoin(b)).where("__x2 > __x1")
    slope = (F.col("__y2") - F.col("__y1")) / (F.col("__x2") - F.col("__x1"))
    return pairs.groupBy(*by).agg(F.round(F.median(slope), 6).alias("slope"), F.count(F.lit(1)).alias("pairs"))


def association(df: DataFrame, by: list[str], a: str, b: str, within: str) -> DataFrame:
    """Pearson, Spearman, and Pearson after taking each `within` group's mean away; with a refusal where n < 3 or a side is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = Window.partitionBy(*by, within)
    rows = rows.select(*by, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"), (F.col(a) - F.avg(a).over(w)).alias("__da"), (F.col(b) - F.avg(b).over(w)).alias("__db"))
    rows = rows.withColumn("__ra", average_rank(F.col("__a"), by)).withColumn("__rb", average_rank(F.col("__b"), by))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("__a").alias("__sa"), F.stddev_pop("__b").alias("__sb"), correlation("__a", "__b").alias("p"), correlation("__ra", "__rb").alias("s"), correlation("__da", "__db").alias("w"))
    refusal = F.when(F.col("n") < 3, "too_few").when((F.col("__sa") == 0) | (F.col("__sb") == 0), "constant")
    keep = lambda c, name: F.when(refusal.isNull(), F.round(c, 6)).alias(name)
    return out.select(*by, "n", keep(F.col("p"), "pearson"), keep(F.col("s"), "spearman"), keep(F.col("w"), "within"), refusal.alias("refusal"))


def row_standardised(edges: DataFrame, key: str) -> DataFrame:
    """Edges with weight 1 / degree."""
    return edges.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(key)).cast("double"))


def morans_i(values: DataFrame, edges: DataFrame, by: list[str], key: str, neighbour: str, value: str) -> DataFrame:
    """Moran's I per group over directed weighted edges between present points, with its expectation and variance under normality."""
    w = Window.partitionBy(*by)
    centred = values.where(F.col(value).isNotNull()).withColumn("__z", F.col(value) - F.avg(value).over(w))
    a = centred.select(*by, key, "__z")
    b = centred.select(*by, F.col(key).alias(neighbour), F.col("__z").alias("__zn"))
    met = a.join(edges.select(key, neighbour, "weight"), key).join(b, [*by, neighbour])
    back = edges.select(F.col(key).alias(neighbour), F.col(neighbour).alias(key), F.col("weight").alias("__back"))
    met = met.join(back, [key, neighbour], "left")
    # s1 counts a pair of opposite edges once for each, so their squared sum is halved
    both = F.when(F.col("__back").isNotNull(), F.pow(F.col("weight") + F.col("__back"), 2)).otherwise(2 * F.pow(F.col("weight"), 2))
    cross = met.groupBy(*by).agg(F.sum(F.col("weight") * F.col("__z") * F.col("__zn")).alias("__c"), F.sum("weight").alias("__w"), (F.sum(both) / 2).alias("__s1"))
    outs = met.groupBy(*by, F.col(key).alias("__k")).agg(F.sum("weight").alias("__o"))
    ins = met.groupBy(*by, F.col(neighbour).alias("__k")).agg(F.sum("weight").alias("__i"))
    s2 = outs.join(ins, [*by, "__k"], "full").groupBy(*by).agg(F.sum(F.pow(F.coalesce("__o", F.lit(0.0)) + F.coalesce("__i", F.lit(0.0)), 2)).alias("__s2"))
    own = a.groupBy(*by).agg(F.sum(F.col("__z") * F.col("__z")).alias("__v"), F.count(F.lit(1)).alias("n"))
    on = lambda x, y: x.join(y, by) if by else x.crossJoin(y)
    t = on(on(own, cross), s2)
    n = F.col("n")
    i = n / F.col("__w") * F.try_divide(F.col("__c"), F.col("__v"))
    expected = -1.0 / (n - 1)
    variance = (n * n * F.col("__s1") - n * F.col("__s2") + 3 * F.col("__w") * F.col("__w")) / ((n * n - 1) * F.col("__w") * F.col("__w")) - expected * expected
    return t.where("n > 2").select(*by, "n", F.round(i, 6).alias("moran_i"), F.round(expected, 6).alias("expected"), F.round((i - expected) / F.sqrt(variance), 4).alias("z"))


def local_moran(values: DataFrame, edges: DataFrame, key: str, neighbour: str, value: str) -> DataFrame:
    """LISA of each point and its quadrant (high-high, low-low, high-low, low-high)."""
    m = F.broadcast(values.agg(F.avg(value).alias("__m"), F.var_pop(value).alias("__v")))
    z = values.crossJoin(m).withColumn("__z", F.col(value) - F.col("__m"))
    lag = edges.join(z.select(F.col(key).alias(neighbour), F.col("__z").alias("__zn")), neighbour).groupBy(key).agg(F.sum(F.col("weight") * F.col("__zn")).alias("lag"))
    quadrant = F.concat(F.when(F.col("__z") >= 0, "high").otherwise("low"), F.lit("-"), F.when(F.col("lag") >= 0, "high").otherwise("low"))
    return z.join(lag, key).select(key, F.round(F.col("__z") * F.col("lag") / F.col("__v"), 6).alias("local_i"), quadrant.alias("quadrant"))


def correlogram(values: DataFrame, distances: DataFrame, key: str, neighbour: str, value: str, edges_km: list[float]) -> DataFrame:
    """Moran's I by distance band (right-closed), each pair of a band weighing alike."""
    from aerolith.functions.maths import right_closed

    m = F.broadcast(values.agg(F.avg(value).alias("__m"), F.var_pop(value).alias("__v")))
    z = values.crossJoin(m).select(key, (F.col(value) - F.col("__m")).alias("__z"), "__v")
    pairs = distances.join(z, key).join(z.select(F.col(key).alias(neighbour), F.col("__z").alias("__zn")), neighbour)
    return pairs.withColumn("band", right_closed(F.col("km"), edges_km)).groupBy("band").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("__z") * F.col("__zn") / F.col("__v")), 6).alias("moran_i"))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """Adjusted p and significance of a family of tests (one row each: months, stations), by ranks and a running minimum from the end."""
    w = Window.partitionBy(F.lit(1))
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(p))).withColumn("__n", F.count(F.lit(1)).over(w))
    step = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("adjusted", F.round(step, 9)).withColumn("significant", F.col("adjusted") <= q).drop("__r", "__n")


def idw_leave_one_out(values: DataFrame, edges: DataFrame, key: str, neighbour: str, value: str, power: float = 2.0) -> DataFrame:
    """Each point's value from its neighbours by inverse distance weights (distance under 0.1 km counts as that)."""
    w = 1 / F.pow(F.greatest(F.col("km"), F.lit(0.1)), power)
    met = edges.join(values.select(F.col(key).alias(neighbour), F.col(value).alias("__v")), neighbour).where("__v is not null")
    guess = met.groupBy(key).agg((F.sum(w * F.col("__v")) / F.sum(w)).alias("predicted"), F.count(F.lit(1)).alias("neighbours"))
    return values.join(guess, key).select(key, F.col(value).alias("y_true"), F.round("predicted", 6).alias("predicted"), "neighbours")


def block_bootstrap(df: DataFrame, by: list[str], order: str, value: str, block: int = 12, draws: int = 500, seed: int = 11) -> DataFrame:
    """Mean of each series and its 95% interval over resampled blocks of consecutive points; a seeded draw for each series, sorted first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(dtype=float)
        head = tuple(pdf[c].iloc[0] for c in by)
        if len(x) < 2:
            return pd.DataFrame([(*head, len(x), float(x.mean()) if len(x) else math.nan, None, None)], columns=[*by, "n", "mean", "low", "high"])
        b = min(block, len(x))
        rng = np.random.default_rng(seed)
        starts = rng.integers(0, len(x) - b + 1, (draws, -(-len(x) // b)))
        means = x[(starts[:, :, None] + np.arange(b)).reshape(draws, -1)[:, : len(x)]].mean(axis=1)
        return pd.DataFrame([(*head, len(x), float(x.mean()), *np.percentile(means, [2.5, 97.5]))], columns=[*by, "n", "mean", "low", "high"])

    types = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", n long, mean double, low double, high double")


def block_bootstrap_slope(df: DataFrame, by: list[str], order: str, value: str, block: int = 12, draws: int = 500, seed: int = 11) -> DataFrame:
    """Theil-Sen slope a step of each series (daily to yearly points, a short series by construction) and its 95% interval over resampled blocks of consecutive residuals put back on the line."""

    def slope(y: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(y.shape[-1], 1)
        return np.median((y[..., j] - y[..., i]) / (j - i), axis=-1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].dropna().to_numpy(dtype=float)
        head = tuple(pdf[c].iloc[0] for c in by)
        columns = [*by, "n", "slope", "low", "high"]
        if len(y) < 3:
            return pd.DataFrame([(*head, len(y), None, None, None)], columns=columns)
        b, rng, k = min(block, len(y)), np.random.default_rng(seed), float(slope(y))
        line = k * np.arange(len(y))
        rest = y - line
        drawn = []
        for _ in range(draws):
            starts = rng.integers(0, len(y) - b + 1, -(-len(y) // b))
            drawn.append(float(slope(line + rest[(starts[:, None] + np.arange(b)).ravel()[: len(y)]])))
        return pd.DataFrame([(*head, len(y), k, *np.percentile(drawn, [2.5, 97.5]))], columns=columns)

    types = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", n long, slope double, low double, high double")


def permutation_p(df: DataFrame, by: list[str], group: str, value: str, draws: int = 499, seed: int = 5) -> DataFrame:
    """p of the difference of two groups' means under permuted labels, one seeded draw for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.dropna(subset=[value]).sort_values([value, group])
        x, g = rows[value].to_numpy(dtype=float), rows[group].to_numpy(dtype=bool)
        head = tuple(pdf[c].iloc[0] for c in by)
        if not g.any() or g.all():
            return pd.DataFrame([(*head, len(x), None, None)], columns=[*by, "n", "difference", "p"])
        rng = np.random.default_rng(seed)
        real = x[g].mean() - x[~g].mean()
        null = [x[m].mean() - x[~m].mean() for m in (rng.permutation(g) for _ in range(draws))]
        return pd.DataFrame([(*head, len(x), float(real), (1 + sum(abs(d) >= abs(real) for d in null)) / (1 + draws))], columns=[*by, "n", "difference", "p"])

    types = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", n long, difference double, p double")


def moran_null(values: DataFrame, edges: DataFrame, key: str, neighbour: str, value: str, draws: int = 99, seed: int = 1) -> DataFrame:
    """Moran's I, its mean under permuted values and a pseudo p: all draws are groups of one plan; a draw permutes by the order of digests.

    values is one month's (or one statistic's) table of stations.
    """
    known = values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias(value))
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws)))
    w = Window.partitionBy("draw")
    spots = known.select(key, draw.alias("draw")).withColumn("__n", F.row_number().over(w.orderBy(key)))
    shuffled = known.select(F.col(key).alias("__k"), value, draw.alias("draw"))
    order = F.when(F.col("draw") == 0, F.lit("")).otherwise(digest(F.col("__k"), F.col("draw"), seed))
    shuffled = shuffled.withColumn("__n", F.row_number().over(w.orderBy(order, "__k"))).drop("__k")
    per = morans_i(spots.join(shuffled, ["draw", "__n"]), edges, ["draw"], key, neighbour, value)
    real = F.broadcast(per.where("draw = 0").select(F.col("moran_i").alias("real")))
    null = per.where("draw > 0").crossJoin(real)
    return null.groupBy(F.col("real").alias("moran_i")).agg(F.round(F.avg("moran_i"), 6).alias("null_mean"), ((F.count_if(F.abs("moran_i") >= F.abs("real")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def dissimilarity(series: DataFrame, edges: DataFrame, key: str, neighbour: str, ts: str, value: str, least: int = 3) -> DataFrame:
    """1 - r of the series of neighbouring points, over times that both have; null under `least` of them."""
    own = series.where(F.col(value).isNotNull()).select(key, ts, F.col(value).alias("__a"))
    other = own.select(F.col(key).alias(neighbour), ts, F.col("__a").alias("__b"))
    met = own.join(edges.select(key, neighbour), key).join(other, [neighbour, ts])
    return met.groupBy(key, neighbour).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.count(F.lit(1)) >= least, 1 - correlation("__a", "__b")), 6).alias("dissimilarity"))


def weights_sensitivity(values: DataFrame, distances: DataFrame, key: str, neighbour: str, value: str, radii: list[float]) -> DataFrame:
    """Moran's I under each of a few radii."""
    out = None
    for r in radii:
        one = morans_i(values, row_standardised(distances.where(F.col("km") <= r), key), [], key, neighbour, value).select(F.lit(float(r)).alias("radius"), "n", "moran_i")
        out = one if out is None else out.unionByName(one)
    return out
