"""What goes wrong in plain regressions, measured: encoding, leakage, optimism, sign stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.maths import digest
from aerolith.operators.stats import least_squares, least_squares_sums


def _r2s(df: DataFrame, y: str, models: list[list[str]]) -> list[float | None]:
    """R2 of several sets of columns, each over the rows that know all of its own; one pass for all."""
    sums = [least_squares_sums(y, xs) for xs in models]
    got, out = list(df.agg(*(c for s in sums for c in s)).first()), []
    for xs, s in zip(models, sums):
        fit = least_squares(["intercept", *xs], got[: len(s)])
        got = got[len(s) :]
        out.append(fit[0]["r2"] if fit else None)
    return out


def encoding_gain(df: DataFrame, y: str, bearing: str) -> DataFrame:
    """R2 of a bearing as a number, and as sine and cosine."""
    r = F.radians(bearing)
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(bearing).cast("double").alias("raw"), F.sin(r).alias("s"), F.cos(r).alias("c"))
    return df.sparkSession.createDataFrame([tuple(_r2s(rows, "y", [["raw"], ["s", "c"]]))], "r2_raw double, r2_encoded double")


def leakage_price(df: DataFrame, y: str, xs: list[str], leak: str) -> DataFrame:
    """R2 without and with a column that holds part of the answer, and the share of the full R2 that it brings."""
    without, with_ = _r2s(df, y, [xs, [*xs, leak]])
    share = (with_ - without) / with_ if without is not None and with_ else None
    return df.sparkSession.createDataFrame([(without, with_, share)], "r2_without double, r2_with double, leak_share double")


def optimism(df: DataFrame, y: str, xs: list[str], fold: str) -> DataFrame:
    """R2 on the rows a fit has seen, and on each fold that it has not (folds are few); both from sums on Spark."""
    spark = df.sparkSession
    rows = df.select(y, fold, *xs).dropna()
    sums = {r[0]: np.array([float(v or 0) for v in r[1:]]) for r in rows.groupBy(fold).agg(*least_squares_sums(y, xs)).collect()}
    fits = {k: least_squares(["intercept", *xs], sum(s for f, s in sums.items() if f != k)) for k in sorted(sums) if len(sums) > 1}
    fits = {k: {r["term"]: r for r in fit} for k, fit in fits.items() if fit}
    if not fits:
        return spark.createDataFrame([], "fold long, r2_in double, r2_out double")
    # all folds are measured in one more pass, each by the line that it has not seen
    lines = F.lit(None).cast("double")
    for k, fit in fits.items():
        line = F.lit(fit["intercept"]["coef"])
        for x in xs:
            line = line + fit[x]["coef"] * F.col(x)
        lines = F.when(F.col(fold) == k, line).otherwise(lines)
    e = F.col(y) - F.col("__line")
    measured = rows.withColumn("__line", lines).groupBy(fold).agg((1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("out"))
    outs = {r[0]: r["out"] for r in measured.collect()}
    out = [(int(k), float(fit["intercept"]["r2"]), None if outs[k] is None else float(outs[k])) for k, fit in fits.items()]
    return spark.createDataFrame(out, "fold long, r2_in double, r2_out double")


def sign_stability(df: DataFrame, y: str, xs: list[str], key: list[str], draws: int = 20, seed: int = 1) -> DataFrame:
    """How often each coefficient keeps its sign over Poisson bootstraps: all draws' weighted sums come from one pass, weights from digests of the key."""
    rows = df.select(*dict.fromkeys([*key, y, *xs])).dropna()
    x = [F.lit(1.0), *(F.col(f"__x{i}") for i in range(len(xs)))]
    k = len(x)
    rows = rows.select(F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("__key"), F.col(y).cast("double").alias("__y"), *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(xs)))
    # each draw is a row of its own: one digest, then sums that few lines of code hold
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("__d"))
    named = [F.col("__key")] if key else []
    drawn = drawn.select("*", digest(*named, F.col("__d") + seed * 1000).alias("__h"))
    # Poisson(1) by inverse distribution function of a draw, told from the digest's first 32 bits as they stand in hex
    steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)])
    w = F.lit(float(len(steps)))
    for i, s in reversed(list(enumerate(steps))):
        w = F.when(F.col("__h") < f"{int(s * (1 << 32)) + 1:08x}", float(i)).otherwise(w)
    drawn = drawn.select("__d", "__y", *(f"__x{i}" for i in range(len(xs))), w.alias("__w"))
    aggs = [F.sum(F.col("__w") * x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(F.col("__w") * c * F.col("__y")) for c in x]
    got = np.zeros((draws, len(aggs)))
    for r in drawn.groupBy("__d").agg(*aggs).collect():
        got[r[0]] = [float(v or 0) for v in r[1:]]
    upper = np.triu_indices(k)
    coefs = []
    for g in got:
        a = np.zeros((k, k))
        a[upper] = g[: len(upper[0])]
        a = a + np.triu(a, 1).T
        coefs.append(np.linalg.pinv(a) @ g[len(upper[0]) :])
    c = np.array(coefs)
    same = np.maximum((c > 0).mean(axis=0), (c < 0).mean(axis=0))
    return df.sparkSession.createDataFrame([(t, float(m), float(s), float(f)) for t, m, s, f in zip(["intercept", *xs], c.mean(axis=0), c.std(axis=0), same)], "term string, mean double, sd double, same_sign double")
