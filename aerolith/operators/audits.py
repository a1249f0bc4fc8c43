"""Audits of quality rules and cohorts: rates with denominators, agreement with an agency's flags, coverage ledgers, designs of folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import MAD_FACTOR, correlation, digest, right_closed


def exceedance_rates(scored: DataFrame, by: list[str], cell: list[str]) -> DataFrame:
    """Per group: scored hours, excursions, their rate, and the median size of the cells behind them (each cell once)."""
    rates = scored.groupBy(*by).agg(F.count("z").alias("scored"), F.count_if("excursion").alias("excursions"), F.round(F.try_divide(F.count_if("excursion"), F.count("z")), 6).alias("rate"))
    cells = scored.where("z is not null").groupBy(*dict.fromkeys([*by, *cell])).agg(F.max("cell_n").alias("n"))
    return rates.join(cells.groupBy(*by).agg(F.median("n").alias("median_cell")), by, "left")


def unscored_deviation(scored: DataFrame, by: list[str]) -> DataFrame:
    """Hours that could not be scored, by reason, with the largest and the median deviation among them."""
    size = F.abs("deviation")
    return scored.where("unscored is not null").groupBy(*by, "unscored").agg(F.count(F.lit(1)).alias("hours"), F.round(F.max(size), 6).alias("max_deviation"), F.round(F.median(size), 6).alias("median_deviation"))


def agency_agreement(rejected: DataFrame, accepted: DataFrame, cell: list[str], value: str, by: list[str], threshold: float = 3.0, least: int = 20) -> DataFrame:
    """Rejected readings scored against the baseline of accepted ones of their cell: how many are extreme, and how much more often than accepted ones."""
    w = Window.partitionBy(*cell)
    base = accepted.select(*cell, F.col(value).alias("__v")).withColumn("__m", F.median("__v").over(w)).withColumn("__d", F.abs(F.col("__v") - F.col("__m")))
    cells = base.groupBy(*cell).agg(F.first("__m").alias("__m"), F.median("__d").alias("__mad"), F.count(F.lit(1)).alias("__n")).where((F.col("__n") >= least) & (F.col("__mad") > 0))
    extreme = lambda v: F.abs(MAD_FACTOR * (v - F.col("__m")) / F.col("__mad")) >= threshold
    usual = accepted.join(cells, cell).agg((F.count_if(extreme(F.col(value))) / F.count(F.lit(1))).alias("__base"))
    out = rejected.join(cells, cell, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("rejected"), F.count("__m").alias("scored"), F.count_if(extreme(F.col(value))).alias("extreme"))
    rate = F.try_divide(F.col("extreme"), F.col("scored"))
    return out.crossJoin(F.broadcast(usual)).select(*by, "rejected", "scored", "extreme", F.round(rate, 6).alias("rate"), F.round(F.try_divide(rate, F.col("__base")), 4).alias("lift"))


def calibration_curve(runs: DataFrame, length: str, rejected_share: str, edges: list[float], at_zero: Column) -> DataFrame:
    """Runs, hours and mean rejected share by right-closed length bucket and whether the value is zero."""
    return runs.groupBy(right_closed(F.col(length), edges).cast("int").alias("bucket"), at_zero.alias("at_zero")).agg(F.count(F.lit(1)).alias("runs"), F.sum(length).alias("hours"), F.round(F.avg(rejected_share), 6).alias("rejected_share"))


def complete_panel(df: DataFrame, keys: list[str], what: str, values: list[str], value: str) -> DataFrame:
    """Ungated means side by side, rows with every value only."""
    return df.groupBy(*keys).pivot(what, values).agg(F.avg(value)).dropna(subset=values)


def association_context(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Mean, sample deviation and correlation by context."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(a), 6).alias("mean"), F.round(F.stddev_samp(a), 6).alias("sd"), F.round(correlation(a, b), 6).alias("corr"))


def locations(df: DataFrame, device: str, lon: str, lat: str, valid: Column) -> DataFrame:
    """Per device: rows, rows with valid coordinates, distinct places (a null coordinate makes a place of its own), and state."""
    out = df.groupBy(device).agg(F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("valid_rows"), F.count_distinct(F.when(valid, F.struct(lon, lat))).alias("places"))
    return out.withColumn("state", F.when(F.col("valid_rows") == 0, "unplaced").when(F.col("places") == 1, "fixed").otherwise("moved"))


def collapse_predictions(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """One row a key: its truth, which must be single-valued (the query fails otherwise), and the mean prediction."""
    out = df.groupBy(*keys).agg(F.min(truth).alias(truth), F.max(truth).alias("__hi"), F.avg(predicted).alias(predicted), F.count(F.lit(1)).alias("n"))
    same = F.when(F.col(truth).eqNullSafe(F.col("__hi")), F.lit(True)).otherwise(F.raise_error(F.lit("a key has more than one truth")).cast("boolean"))
    return out.where(same).drop("__hi")


def coverage_ledger(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key: rows, rows with every column, and rows that lack each."""
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNotNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(every).alias("complete"), *(F.count_if(F.col(c).isNull()).alias(f"lacks_{c}") for c in columns))


def scope(candidates: DataFrame, targets: DataFrame, analysed: DataFrame, key: str) -> DataFrame:
    """Why each candidate is in or out: analysed, no_target or incomplete."""
    t, a = targets.select(key, F.lit(True).alias("__t")).distinct(), analysed.select(key, F.lit(True).alias("__a")).distinct()
    reason = F.when(F.col("__a"), "analysed").when(F.col("__t").isNull(), "no_target").otherwise("incomplete")
    return candidates.select(key).distinct().join(t, key, "left").join(a, key, "left").select(key, reason.alias("reason"))


def missing_expected(df: DataFrame, entities: DataFrame, entity: str, ts: str, start: str, end: str) -> DataFrame:
    """Hours of [start, end) that an entity lacks: the expected grid against what is there."""
    hours = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 hour"), F.expr("interval 1 hour"))
    return entities.select(entity).distinct().withColumn(ts, F.explode(hours)).join(df.select(entity, ts), [entity, ts], "left_anti")


def reconcile_ledgers(values: DataFrame, ledger: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose rows and nulls don't equal what a ledger (rows, nulls) says; absent keys count as zero."""
    real = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.count_if(F.col(value).isNull()).alias("__nulls"))
    both = real.join(ledger, keys, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.where((zero("__rows") != zero("rows")) | (zero("__nulls") != zero("nulls"))).select(*keys, zero("__rows").alias("rows_found"), zero("rows").alias("rows_told"))


def inverse_cluster_weight(df: DataFrame, keys: list[str], name: str = "weight") -> DataFrame:
    """Each row's weight: one over the rows of its cluster."""
    return df.withColumn(name, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("double"))


def held_out_design(rows: DataFrame, station_fold: str, quarter: str, station_folds: int) -> DataFrame:
    """Rows times folds of three designs: stations held out, quarters held out, both. Role is train, test or excluded.

    In a joint fold rows of the held station in other quarters, and of other stations in the
    held quarter, would leak and are excluded.
    """
    s = [F.struct(F.lit("station").alias("design"), F.lit(k).cast("int").alias("s"), F.lit(None).cast("int").alias("q")) for k in range(station_folds)]
    q = [F.struct(F.lit("quarter").alias("design"), F.lit(None).cast("int").alias("s"), F.lit(k).cast("int").alias("q")) for k in range(1, 5)]
    j = [F.struct(F.lit("joint").alias("design"), F.lit(k).cast("int").alias("s"), F.lit(m).cast("int").alias("q")) for k in range(station_folds) for m in range(1, 5)]
    out = rows.withColumn("__f", F.explode(F.array(*s, *q, *j)))
    mine_s = F.col("__f.s").isNull() | (F.col(station_fold) == F.col("__f.s"))
    mine_q = F.col("__f.q").isNull() | (F.col(quarter) == F.col("__f.q"))
    other_s, other_q = F.col("__f.s").isNotNull() & ~mine_s, F.col("__f.q").isNotNull() & ~mine_q
    role = F.when(mine_s & mine_q, "test").when((F.col("__f.design") != "joint") | (other_s & other_q), "train").otherwise("excluded")
    return out.select(*rows.columns, F.col("__f.design").alias("design"), F.col("__f.s").alias("held_station_fold"), F.col("__f.q").alias("held_quarter"), role.alias("role"))


def sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by the digest of their keys: the same on every run and cluster."""
    return df.withColumn("__h", digest(*map(F.col, keys), seed)).orderBy("__h", *keys).limit(n).drop("__h")


def spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """n keys evenly spaced in their order (a dimension's keys)."""
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    ranked = df.select(key).distinct().withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key)) - 1).withColumn("__t", total)
    step = F.floor(F.col("__t") / n)
    return ranked.where((F.col("__t") <= n) | ((F.col("__i") % F.greatest(step, F.lit(1)) == 0) & (F.floor(F.col("__i") / F.greatest(step, F.lit(1))) < n))).select(key)


def event_windows(df: DataFrame, events: DataFrame, ts: str, value: str, days: int) -> DataFrame:
    """Per event (name, start, end): means of the days before and after it; the event's own days count for neither.

    Events are spread over the days that they look at, and rows meet them by day.
    """
    width = F.make_dt_interval(F.lit(days))
    before = (F.col(ts) >= F.col("start") - width) & (F.col(ts) < F.col("start"))
    after = (F.col(ts) >= F.col("end")) & (F.col(ts) < F.col("end") + width)
    days_of = F.explode(F.sequence(F.to_date(F.col("start") - width), F.to_date(F.col("end") + width))).alias("__day")
    met = df.select(ts, value, F.to_date(ts).alias("__day")).join(events.where("start <= end").select("*", days_of), "__day").where(before | after)
    return met.groupBy("name").agg(F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), F.round(F.avg(F.when(before, F.col(value))), 6).alias("mean_before"), F.round(F.avg(F.when(after, F.col(value))), 6).alias("mean_after"))


def placebos(days: DataFrame, date: str, value: str, start_day: int, length: int) -> DataFrame:
    """Per year the mean of the same calendar days minus the mean of as many days just before: the distribution that an event's year is held against."""
    d = F.dayofyear(date)
    inside, before = d.between(start_day, start_day + length - 1), d.between(start_day - length, start_day - 1)
    out = days.groupBy(F.year(date).alias("year")).agg(F.count_if(inside).alias("n"), F.round(F.avg(F.when(inside, F.col(value))) - F.avg(F.when(before, F.col(value))), 6).alias("change"))
    return out.where("change is not null")


#: Values that an axis of a grid may have: finer than a hundredth of a degree around the globe.
AXIS = 50_000


def nearest_cell(points: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Each point's grid cell by the nearest latitude and the nearest longitude, each axis on its own; ties to the smaller.

    An axis is one sorted array of at most AXIS values (more are an error), held beside the points, which
    are not shuffled; the cell is the nearer of the values below and above. No latitude, no cell.
    """
    axes = None
    for c in ("lat", "lon"):
        values = grid.select(F.col(c).alias("v")).where("v is not null").distinct().limit(AXIS + 1).agg(F.collect_list("v").alias("v"))
        axis = values.select(F.when(F.size("v") > AXIS, F.raise_error(F.lit(f"more than {AXIS} values of {c}"))).otherwise(F.col("v")).alias(f"__{c}"))
        axes = axis if axes is None else axes.crossJoin(axis)

    def nearest(c: str) -> Column:
        x, below, above = F.col(c), F.array_max(F.filter(f"__{c}", lambda v: v <= F.col(c))), F.array_min(F.filter(f"__{c}", lambda v: v > F.col(c)))
        return F.when(above.isNull() | (x - below <= above - x), below).otherwise(above).alias(f"cell_{c}")

    return points.select(key, "lat", "lon").crossJoin(F.broadcast(axes)).select(key, nearest("lat"), nearest("lon"))


def clustered_errors(df: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """term, coef, t under independent errors and t under errors clustered by `cluster`: scores are summed per cluster on Spark, k x k sums reach the driver."""
    import numpy as np

    from aerolith.operators.stats import ols

    fit = {r["term"]: r for r in ols(df, y, xs).collect()}
    terms = ["intercept", *xs]
    spark = df.sparkSession
    schema = "term string, coef double, t_iid double, t_cluster double"
    if not fit:
        return spark.createDataFrame([], schema)
    rows = df.select(y, cluster, *xs).dropna()
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    line = sum((fit[t]["coef"] * c for t, c in zip(terms, x)), F.lit(0.0))
    resid = F.col(y) - line
    k = len(x)
    scores = rows.groupBy(cluster).agg(*(F.sum(c * resid).alias(f"s{i}") for i, c in enumerate(x)))
    got = scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k))).first()
    meat = np.array([float(v or 0) for v in got]).reshape(k, k)
    bread = np.linalg.pinv(np.array([float(v or 0) for v in rows.agg(*(F.sum(a * b) for a in x for b in x)).first()]).reshape(k, k))
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0))
    return spark.createDataFrame([(t, fit[t]["coef"], fit[t]["t"], float(fit[t]["coef"] / s) if s else None) for t, s in zip(terms, se)], schema)
