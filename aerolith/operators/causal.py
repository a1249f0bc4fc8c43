"""Marked events against a counterfactual fitted outside their windows, and breaks of trend, each beside placebos.

Both are contrasts, not proofs: a placebo tells what the same estimate gives where nothing is
marked. All events, placebo years, stations and candidate breaks are groups of one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import draw
from aerolith.session import cut


def _windows(events: DataFrame, years: tuple[int, int]) -> DataFrame:
    """event, shift, start, end: each event's window, and the same calendar days of years in which no event lies (shift in years, 0 for the event)."""
    asked = events.select(F.col("name").alias("event"), F.to_date("start").alias("start"), F.to_date(F.coalesce("end", "start")).alias("end"))
    marked = asked.select(F.explode(F.sequence(F.year("start"), F.year("end"))).alias("year")).distinct()
    other = asked.withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))).join(marked, "year", "left_anti")
    shift = (F.col("year") - F.year("start")).cast("int")
    other = other.select("event", shift.alias("shift"), F.add_months("start", shift * 12).alias("first"), F.datediff("end", "start").alias("days"))
    placebo = other.select("event", "shift", F.col("first").alias("start"), F.date_add("first", F.col("days")).alias("end"))
    return asked.select("event", F.lit(0).alias("shift"), "start", "end").unionByName(placebo)


def counterfactual(daily: DataFrame, station: str, date: str, y: str, xs: list[str], events: DataFrame, buffer_days: int = 30, least_days: int = 14, least_train: int = 500, block: int = 7, draws: int = 200, seed: int = 1) -> DataFrame:
    """event, station, n_days, train_days, observed_mean, predicted_mean, effect, effect_pct, ci_low, ci_high, placebo_mean, placebo_sd, placebo_n, z, refusal.

    Per event and station a least-squares line of y on xs is fitted to the days that lie more than
    buffer_days off the window; the effect is the mean of what the window's days show beyond it. A
    station's sums over all its days less those over the days around a window are the window's
    training sums, so a day is read once for each window near it. The interval comes from means
    over resampled blocks of consecutive residuals; z compares with the effects of the same days
    in unmarked years. Windows of fewer days, or with fewer to learn from, are refused. daily: a row a station and day;
    days with nulls don't count. events: name, start, end (null: one day), few.
    """
    k = len(xs) + 1
    rows = daily.select(F.col(station).alias("station"), F.to_date(date).alias("date"), F.col(y).cast("double").alias("__y"), *(F.col(x).cast("double").alias(f"__v{i}") for i, x in enumerate(xs))).dropna()
    overall = rows.agg(F.min(F.year("date")), F.max(F.year("date")), *(F.avg(f"__v{i}") for i in range(len(xs))), F.avg("__y")).first()
    schema = "event string, station string, n_days long, train_days long, observed_mean double, predicted_mean double, effect double, effect_pct double, ci_low double, ci_high double, placebo_mean double, placebo_sd double, placebo_n long, z double, refusal string"
    if overall[0] is None:
        return daily.sparkSession.createDataFrame([], schema)
    centre, level = [float(v) for v in overall[2:-1]], float(overall[-1])
    x = [F.lit(1.0), *(F.col(f"__v{i}") - m for i, m in enumerate(centre))]
    rows = rows.select("station", "date", (F.col("__y") - level).alias("y"), F.array(*x).alias("x"))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i, j in cells), *(F.sum(F.col("x")[i] * F.col("y")).alias(f"b{i}") for i in range(k))]
    names = ["n", *(f"g{i}_{j}" for i, j in cells), *(f"b{i}" for i in range(k))]
    windows = _windows(events, (overall[0], overall[1]))
    around = windows.withColumn("date", F.explode(F.sequence(F.date_sub("start", buffer_days), F.date_add("end", buffer_days))))
    # written once: sums, predictions and residuals all start from here
    near = cut(rows.join(around, "date").withColumn("inside", F.col("date").between(F.col("start"), F.col("end"))))
    left_out = near.groupBy("event", "shift", "station").agg(*sums)
    total = rows.groupBy("station").agg(*sums)
    train = left_out.alias("a").join(total.alias("b"), "station").select("event", "shift", "station", *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in names))
    kind = dict(rows.dtypes)["station"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            beta = []
            for r in p.to_dict("records"):
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
                beta.append((np.linalg.pinv(g, hermitian=True) @ np.array([r[f"b{i}"] for i in range(k)], dtype=float)).tolist())
            yield p[["event", "shift", "station", "n"]].assign(beta=beta)

    fits = train.mapInPandas(solve, f"event string, shift int, station {kind}, n long, beta array<double>")
    line = sum((F.col("beta")[i] * F.col("x")[i] for i in range(k)), F.lit(level))
    days = cut(near.where("inside").join(fits.withColumnRenamed("n", "train_days"), ["event", "shift", "station"]).select("event", "shift", "station", "date", "train_days", (F.col("y") + level).alias("seen"), line.alias("said")))
    found = days.groupBy("event", "shift", "station").agg(F.count(F.lit(1)).alias("n_days"), F.max("train_days").alias("train_days"), F.avg("seen").alias("observed_mean"), F.avg("said").alias("predicted_mean"), F.avg(F.col("seen") - F.col("said")).alias("effect"))
    found = found.withColumn("refusal", F.when(F.col("n_days") < least_days, "few_days").when(F.col("train_days") < least_train, "few_training_days"))
    good = found.where("refusal IS NULL")
    placebos = good.where("shift <> 0").groupBy("event", "station").agg(F.avg("effect").alias("placebo_mean"), F.stddev_samp("effect").alias("placebo_sd"), F.count(F.lit(1)).alias("placebo_n"))
    # block bootstrap: position p of a draw takes day start(p div block) + p mod block
    order = Window.partitionBy("event", "station").orderBy("date")
    rest = days.where("shift = 0").join(good.where("shift = 0").select("event", "station", "n_days"), ["event", "station"])
    rest = rest.select("event", "station", "n_days", (F.row_number().over(order) - 1).alias("p"), (F.col("seen") - F.col("said")).alias("r"))
    width = F.least(F.lit(block), F.col("n_days"))
    drawn = rest.select("event", "station", "n_days", "p", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    start = F.floor(draw(F.col("event"), F.col("station"), F.col("draw"), F.floor(F.col("p") / width), seed) * (F.col("n_days") - width + 1))
    drawn = drawn.select("event", "station", "draw", (start + F.col("p") % width).cast("int").alias("p"))
    means = drawn.join(rest.select("event", "station", "p", "r"), ["event", "station", "p"]).groupBy("event", "station", "draw").agg(F.avg("r").alias("m"))
    interval = means.groupBy("event", "station").agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    out = found.where("shift = 0").join(interval, ["event", "station"], "left").join(placebos, ["event", "station"], "left")
    kept = lambda c: F.when(F.col("refusal").isNull(), F.round(c, 6))
    z = F.try_divide(F.col("effect") - F.col("placebo_mean"), F.col("placebo_sd"))
    return out.select(
        "event", "station", "n_days", "train_days", F.round("observed_mean", 6).alias("observed_mean"),
        *(kept(F.col(c)).alias(c) for c in ("predicted_mean", "effect")), kept(100 * F.try_divide(F.col("effect"), F.col("predicted_mean"))).alias("effect_pct"),
        *(kept(F.col(c)).alias(c) for c in ("ci_low", "ci_high", "placebo_mean", "placebo_sd")), F.coalesce("placebo_n", F.lit(0)).alias("placebo_n"), kept(z).alias("z"), "refusal",
    )


def trend_breaks(monthly: DataFrame, station: str, month: str, value: str, events: DataFrame, gap_years: float = 3.0, least_months: int = 36, least_side: int = 12) -> DataFrame:
    """event, station, slope_before, slope_after, delta (a year), n_before, n_after, placebo_mean, placebo_sd, placebo_n, z.

    Placebos are breaks at every quarter of a year, one year in from either end, at least
    gap_years off the event: nearer ones would straddle the break themselves. z is centred on
    their mean, as a curved series bends everywhere, and needs three of them. Sides of fewer than least_side months give
    no slopes, series of fewer than least_months no row. monthly: a row a station and month (a
    short series by construction); events: name, when.
    """
    rows = monthly.select(F.col(station).alias("station"), F.to_date(month).alias("m"), F.col(value).cast("double").alias("v")).dropna()
    span = rows.groupBy("station").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count(F.lit(1)).alias("months")).where(F.col("months") >= least_months)
    year = lambda d: F.datediff(d, "first") / 365.25
    asked = events.select(F.col("name").alias("event"), F.to_date("when").alias("when"))
    spots = span.crossJoin(F.broadcast(asked)).withColumn("at", year("when"))  # events are few
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((year("last") - 2) * 4).cast("int") - 1)), lambda i: 1 + i / 4.0)
    others = F.filter(F.when(year("last") > 2, steps).otherwise(F.array().cast("array<double>")), lambda c: F.abs(c - F.col("at")) >= gap_years)
    breaks = spots.select("station", "event", "first", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("real"), F.col("at").alias("c"))), F.transform(others, lambda c: F.struct(F.lit(False).alias("real"), c.alias("c"))))).alias("b")).select("station", "event", "first", "b.*")
    met = rows.join(breaks, "station").withColumn("t", year("m"))
    before, after = F.col("t") < F.col("c"), F.col("t") >= F.col("c")
    slope = lambda side: F.regr_slope(F.when(side, F.col("v")), F.when(side, F.col("t")))
    sides = met.groupBy("station", "event", "real", "c").agg(slope(before).alias("slope_before"), slope(after).alias("slope_after"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"))
    sides = sides.where((F.col("n_before") >= least_side) & (F.col("n_after") >= least_side)).withColumn("delta", F.col("slope_after") - F.col("slope_before"))
    null = sides.where("NOT real").groupBy("station", "event").agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.count(F.lit(1)).alias("placebo_n"))
    out = sides.where("real").join(null, ["station", "event"], "left")
    enough = F.col("placebo_n") >= 3
    told = {"slope_before": F.col("slope_before"), "slope_after": F.col("slope_after"), "delta": F.col("delta"), "placebo_mean": F.when(enough, F.col("mean")), "placebo_sd": F.when(enough, F.col("sd")), "z": F.when(enough, F.try_divide(F.col("delta") - F.col("mean"), F.col("sd")))}
    return out.select("event", "station", "n_before", "n_after", F.coalesce("placebo_n", F.lit(0)).alias("placebo_n"), *(F.round(c, 6).alias(n) for n, c in told.items()))
