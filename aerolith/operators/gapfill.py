"""Filling gaps with provenance: from the best donor, by iterated regression; hiding known values to score methods."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import correlation, draw
from aerolith.operators.residuals import normal
from aerolith.operators.windows import null_runs
from aerolith.session import cut


def donors(df: DataFrame, edges: DataFrame, entity: str, ts: str, value: str, overlaps: int = 24, least_r: float = 0.7) -> DataFrame:
    """Per entity the neighbour with the highest correlation (ties to the nearer, then the smaller name), with the line that maps it.

    Edges are few for each entity, so the join grows with rows times neighbours, not with pairs of entities.
    """
    own = df.where(F.col(value).isNotNull()).select(entity, ts, F.col(value).alias("__y"))
    other = own.select(F.col(entity).alias("neighbour"), ts, F.col("__y").alias("__x"))
    met = own.join(edges.select(entity, "neighbour", "km"), entity).join(other, ["neighbour", ts])
    fit = met.groupBy(entity, "neighbour").agg(F.count(F.lit(1)).alias("n"), correlation("__y", "__x").alias("r"), F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"), F.min("km").alias("km"))
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("r"), "km", "neighbour"))
    return fit.where((F.col("n") >= overlaps) & (F.col("r") >= least_r)).withColumn("__n", place).where("__n = 1").drop("__n")


def fill_from_donors(df: DataFrame, best: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """Nulls from the donor's value at the same time through its line; `<value>_imputed` marks them."""
    source = df.select(F.col(entity).alias("neighbour"), ts, F.col(value).alias("__x"))
    out = df.join(best.select(entity, "neighbour", "slope", "intercept"), entity, "left").join(source, ["neighbour", ts], "left")
    guess = F.col("intercept") + F.col("slope") * F.col("__x")
    fill = F.col(value).isNull() & guess.isNotNull()
    return out.select(*(c for c in df.columns if c != value), F.when(fill, guess).otherwise(F.col(value)).alias(value), fill.alias(f"{value}_imputed"))


def fill_iteratively(df: DataFrame, columns: list[str], rounds: int = 3) -> DataFrame:
    """Each column's nulls by least squares on the others, in turn, for a few rounds; starts from the means. Lineage grows by 2 aggregates a column."""
    from aerolith.operators.stats import ols

    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    out = df.select(*df.columns, *(F.col(c).isNull().alias(f"{c}_imputed") for c in columns))
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(means[c])))
    for _ in range(rounds):
        for c in columns:
            xs = [x for x in columns if x != c]
            fit = {r["term"]: r["coef"] for r in ols(out.where(~F.col(f"{c}_imputed")), c, xs).collect()}
            if fit:
                line = F.lit(fit["intercept"])
                for x in xs:
                    line = line + fit[x] * F.col(x)
                out = out.withColumn(c, F.when(F.col(f"{c}_imputed"), line).otherwise(F.col(c)))
    return out


def hide(df: DataFrame, entity: str, ts: str, value: str, share: float, run: int, seed: int = 1) -> DataFrame:
    """Known values hidden in runs of `run` rows, chosen by a hash of entity and run: columns truth and hidden; the value is null there."""
    place = F.row_number().over(Window.partitionBy(entity).orderBy(ts)) - 1
    block = F.floor(place / run)
    chosen = (draw(F.col(entity), block, seed) < share) & F.col(value).isNotNull()
    marked = df.withColumn("hidden", chosen).withColumn("truth", F.when(F.col("hidden"), F.col(value)))
    return marked.withColumn(value, F.when(~F.col("hidden"), F.col(value)))


def fill_errors(filled: DataFrame, truth: str, value: str, by: list[str]) -> DataFrame:
    """MAE, RMSE and share recovered of what was hidden."""
    e = F.col(value) - F.col(truth)
    return filled.where(F.col(truth).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("hidden"), F.round(F.avg(F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)), 6).alias("recovered"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse")
    )


def hide_like_gaps(df: DataFrame, entity: str, ts: str, value: str, share: float, attempts: int = 8, rounds: int = 3, seed: int = 1) -> DataFrame:
    """Known values hidden in runs as long as the series' own gaps: columns hidden, truth, gap_length; the value is null there.

    Every gap of an entity asks for as many hidden runs of its length as bring the hidden rows to
    `share` of the known ones (the odd part by a draw), so lengths are distributed as the gaps'
    are. A run draws up to `attempts` places and takes the first whose rows are all known and that
    touches no run placed before; in each of the `rounds` a run tries its next place. What finds
    none isn't placed. df is a complete grid; an entity without gaps has nothing to imitate.
    Places are looked up by position and running count, so no series is held in Python.
    """
    w = Window.partitionBy(entity).orderBy(ts)
    at = df.withColumn("__i", F.row_number().over(w)).withColumn("__c", F.sum(F.col(value).isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = null_runs(df, [entity], ts, value)
    size = at.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("known"))
    want = gaps.join(size, entity).join(gaps.groupBy(entity).agg(F.sum("length").alias("missing")), entity).withColumn("f", share * F.col("known") / F.col("missing"))
    copies = (F.floor("f") + (draw(F.col(entity), F.col("start"), "copies", seed) < F.col("f") - F.floor("f")).cast("long")).alias("copies")
    asked = want.select(entity, "start", "length", "rows", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    tried = asked.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    first = 1 + F.floor(draw(F.col(entity), F.col("start"), F.col("copy"), F.col("attempt"), seed) * (F.col("rows") - F.col("length") + 1))
    tried = tried.select(entity, "start", "copy", "attempt", "length", first.alias("first")).withColumn("last", F.col("first") + F.col("length") - 1)
    count = at.select(entity, "__i", "__c")
    ends = tried.join(count.select(entity, F.col("__i").alias("last"), F.col("__c").alias("upto")), [entity, "last"])
    ends = ends.join(count.select(entity, (F.col("__i") + 1).alias("first"), F.col("__c").alias("before")), [entity, "first"], "left")
    fits = ends.where(F.col("upto") - F.coalesce("before", F.lit(0)) == F.col("length"))
    turn = F.row_number().over(Window.partitionBy(entity, "start", "copy").orderBy("attempt"))
    fits = cut(fits.select(entity, "start", "copy", "length", "first", "last", turn.alias("turn")))
    placed = fits.limit(0).drop("turn")
    order = Window.partitionBy(entity).orderBy("first", "new", "start", "copy")
    for k in range(1, rounds + 1):
        new = fits.where(F.col("turn") == k).drop("turn").join(placed.select(entity, "start", "copy"), [entity, "start", "copy"], "left_anti")
        both = placed.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        behind = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.min(F.when(F.col("new") == 0, F.col("first"))).over(order.rowsBetween(1, Window.unboundedFollowing))
        clear = (F.coalesce(behind, F.lit(0)) < F.col("first")) & (F.coalesce(ahead, F.lit((1 << 62))) > F.col("last"))
        placed = cut(both.withColumn("clear", clear).where("new = 0 OR clear").drop("new", "clear"))
    hidden = placed.select(entity, F.explode(F.sequence("first", "last")).alias("__i"), F.col("length").alias("gap_length"))
    out = at.join(hidden, [entity, "__i"], "left").withColumn("hidden", F.col("gap_length").isNotNull())
    kept = [c for c in df.columns if c != value]
    return out.select(*kept, F.when(~F.col("hidden"), F.col(value)).alias(value), "hidden", F.when(F.col("hidden"), F.col(value)).alias("truth"), "gap_length")


def chained_draws(df: DataFrame, keys: list[str], columns: list[str], draws: int = 5, rounds: int = 3, seed: int = 1) -> DataFrame:
    """keys, draw and the columns completed: each null drawn from its regression on the other columns, in turn, `draws` times over.

    In a round every column is regressed on the others over the rows where it is known; the
    coefficients are drawn from their posterior (normal about least squares, by the fit's own
    covariance) and every null gets the line's value plus a residual of its own (by the digest of its keys). So the
    draws differ by what isn't known, and spread over them measures it. All draws advance
    together as groups of one table; a round gathers k x k sums for each draw and column.
    """
    names = [f"__v{i}" for i in range(len(columns))]
    rows = df.select(*keys, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names)))
    means = rows.agg(*(F.avg(n).alias(n) for n in names)).first()
    now = rows.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), *(F.coalesce(F.col(n), F.lit(means[n])).alias(n) for n in names), *(F.col(n).isNull().alias(f"{n}_") for n in names))
    k = len(columns)
    for turn in range(rounds):
        for i, n in enumerate(names):
            x = [F.lit(1.0), *(F.col(m) for j, m in enumerate(names) if j != i)]
            sums = [F.sum(x[a] * x[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)] + [F.sum(v * F.col(n)).alias(f"b{a}") for a, v in enumerate(x)]
            got = now.where(~F.col(f"{n}_")).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(n) * F.col(n)).alias("yy"), *sums).collect()  # a row for each draw
            lines = []
            for r in got:
                g = np.array([[r[f"g{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)], dtype=float)
                b = np.array([r[f"b{a}"] for a in range(k)], dtype=float)
                inverse = np.linalg.pinv(g, hermitian=True)
                beta = inverse @ b
                sigma = math.sqrt(max(r["yy"] - beta @ b, 0.0) / max(r["n"] - k, 1))
                values, vectors = np.linalg.eigh((inverse + inverse.T) / 2)
                noise = np.random.default_rng([seed, turn, i, r["draw"]]).standard_normal(k)
                beta = beta + sigma * (vectors * np.sqrt(np.maximum(values, 0))) @ noise
                lines.append((r["draw"], beta.tolist(), float(sigma)))
            if not lines:
                continue
            fits = F.broadcast(df.sparkSession.createDataFrame(lines, "draw int, beta array<double>, sigma double"))
            line = sum((F.col("beta")[a] * v for a, v in enumerate(x)), F.lit(0.0)) + F.col("sigma") * normal(*(F.col(c) for c in keys), F.col("draw"), turn, i, seed)
            now = now.join(fits, "draw", "left").withColumn(n, F.when(F.col(f"{n}_"), F.coalesce(line, F.col(n))).otherwise(F.col(n))).drop("beta", "sigma")
        now = cut(now)
    return now.select(*keys, "draw", *(F.col(n).alias(c) for c, n in zip(columns, names)))


def posterior_summary(draws: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, and of each column its mean over the draws and their deviation (0 where it was known)."""
    return draws.groupBy(*keys).agg(*(f(F.col(c)).alias(n) for c in columns for f, n in ((F.avg, c), (F.stddev_pop, f"{c}_sd"))))
