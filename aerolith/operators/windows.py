"""Ordered operators on hourly series: grids, lags, runs, gaps, robust scores, bounded interpolation.

Every window is partitioned by entity, so nothing leaks from one series into another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import MAD_FACTOR
from aerolith.operators.qc import cascade


def hourly_grid(df: DataFrame, entity: list[str], ts: str) -> DataFrame:
    """Every hour from each entity's first to its last, absent ones with nulls; ts must be unique per entity."""
    spans = df.groupBy(*entity).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    grid = spans.select(*entity, F.explode(F.sequence("__a", "__b", F.expr("interval 1 hour"))).alias(ts))
    return grid.join(df, [*entity, ts], "left")


def lag_features(df: DataFrame, entity: list[str], ts: str, value: str, lags: list[int], windows: list[int]) -> DataFrame:
    """On a complete grid: lag_k (lag_1 is the row's own value), means and maxima of the last w rows if all are known, and deltas."""
    w = Window.partitionBy(*entity).orderBy(ts)
    out = df
    for k in lags:
        out = out.withColumn(f"lag_{k}", F.lag(value, k - 1).over(w))
    for n in windows:
        last = w.rowsBetween(-(n - 1), 0)
        full = F.count(value).over(last) == n
        out = out.withColumn(f"mean_{n}", F.when(full, F.avg(value).over(last))).withColumn(f"max_{n}", F.when(full, F.max(value).over(last)))
    for k in lags:
        if k > 1 and 1 in lags:
            out = out.withColumn(f"delta_{k - 1}", F.col("lag_1") - F.col(f"lag_{k}"))
    return out


def target(df: DataFrame, entity: list[str], ts: str, value: str, horizon: int) -> DataFrame:
    """The value `horizon` rows ahead on a complete grid."""
    if horizon < 1:
        raise ValueError("a target lies ahead")
    return df.withColumn("target", F.lead(value, horizon).over(Window.partitionBy(*entity).orderBy(ts)))


def islands(df: DataFrame, entity: list[str], ts: str, breaks: Column, name: str = "run") -> DataFrame:
    """Number of the run that each row is in; breaks is true (or null) where a run begins."""
    w = Window.partitionBy(*entity).orderBy(ts)
    marked = df.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def previous(column: str, entity: list[str], ts: str, k: int = 1) -> Column:
    return F.lag(column, k).over(Window.partitionBy(*entity).orderBy(ts))


def follows_by_an_hour(entity: list[str], ts: str) -> Column:
    return F.col(ts) - previous(ts, entity, ts) == F.expr("interval 1 hour")


def plateaus(df: DataFrame, entity: list[str], ts: str, value: str, **shares: Column) -> DataFrame:
    """Maximal runs of one known value at exact hourly steps: entity, value, start, end, length, and the share of their rows that meet each condition in shares."""
    known = df.where(F.col(value).isNotNull()).withColumns({f"__{n}": c.cast("int") for n, c in shares.items()})
    goes_on = (F.col(value) == previous(value, entity, ts)) & follows_by_an_hour(entity, ts)
    runs = islands(known, entity, ts, ~goes_on).groupBy(*entity, value, "run")
    return runs.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("length"), *(F.avg(f"__{n}").alias(n) for n in shares)).drop("run")


def approached_from(df: DataFrame, entity: list[str], ts: str, value: str) -> DataFrame:
    """entity, start, entered_from: the known value before each row, as a table to look runs' starts up in."""
    known = df.where(F.col(value).isNotNull())
    return known.select(*entity, F.col(ts).alias("start"), previous(value, entity, ts).alias("entered_from"))


def commonness(df: DataFrame, entity: list[str], value: str) -> DataFrame:
    """entity, value, value_share: how much of what an entity ever measured is this value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*entity, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.select(*entity, value, (F.col("__n") / F.sum("__n").over(Window.partitionBy(*entity))).alias("value_share"))


def stuck_runs(df: DataFrame, entity: list[str], ts: str, value: str, least: int = 2, rejected: Column | None = None, blind: Column | None = None) -> DataFrame:
    """Plateaus of `least` rows or more, and what tells a frozen sensor from one at its bound.

    That is: the value before (entered_from, entered_from_below), how common the value is
    (value_share), and its sign (at_zero, negative). rejected_share is the share of rows that meet
    `rejected`; it is unknown, not 0, for a run whose rows are all `blind` (a format that leaves
    rejected readings out can't show any).
    """
    never = F.lit(None).cast("boolean")
    runs = plateaus(df, entity, ts, value, __rejected=rejected if rejected is not None else never, __blind=F.coalesce(blind, F.lit(False)) if blind is not None else F.lit(False))
    runs = runs.where(F.col("length") >= least).join(approached_from(df, entity, ts, value), [*entity, "start"], "left")
    runs = runs.join(commonness(df, entity, value), [*entity, value], "left")
    v = F.col(value)
    return runs.select(
        *entity,
        value,
        "start",
        "end",
        "length",
        "entered_from",
        "value_share",
        F.when(F.col("__blind") < 1, F.col("__rejected")).alias("rejected_share"),
        (F.col("entered_from") < v).alias("entered_from_below"),
        (v < 0).alias("negative"),
        (v == 0).alias("at_zero"),
    )


def null_runs(df: DataFrame, entity: list[str], ts: str, value: str) -> DataFrame:
    """Maximal runs of nulls on a complete grid: start and length."""
    flipped = F.col(value).isNull() != previous("__null", entity, ts)
    runs = islands(df.withColumn("__null", F.col(value).isNull()), entity, ts, flipped)
    return runs.where("__null").groupBy(*entity, "run").agg(F.min(ts).alias("start"), F.count(F.lit(1)).alias("length")).drop("run")


def robust_scores(df: DataFrame, cell: list[str], value: str, least: int = 20, threshold: float = 3.0) -> DataFrame:
    """Median, MAD and robust z of each row's cell, and the share of the cell's scored rows that are excursions; excursion is null where the cell can't score."""
    w = Window.partitionBy(*cell)
    rows = df.withColumn("cell_n", F.count(value).over(w)).withColumn("cell_median", F.median(value).over(w)).withColumn("deviation", F.col(value) - F.col("cell_median"))
    rows = rows.withColumn("cell_mad", F.median(F.abs("deviation")).over(w))
    can = (F.col("cell_n") >= least) & (F.col("cell_mad") > 0) & F.col(value).isNotNull()
    z = F.when(can, MAD_FACTOR * F.col("deviation") / F.col("cell_mad"))
    reason = F.when(F.col(value).isNull(), "no_value").when(F.col("cell_n") < least, "small_cell").when(F.col("cell_mad") == 0, "no_spread")
    return rows.withColumn("z", z).withColumn("excursion", F.abs("z") >= threshold).withColumn("direction", F.when(F.col("excursion"), F.signum("z").cast("int"))).withColumn("unscored", reason).withColumn("elevated_share", F.avg(F.col("excursion").cast("int")).over(w))


def excursion_runs(scored: DataFrame, entity: list[str], ts: str) -> DataFrame:
    """Maximal runs of excursions of one direction at exact hourly steps; peak columns come from one row, the first of the largest."""
    hits = scored.where("excursion")
    same = (F.col("direction") == previous("direction", entity, ts)) & follows_by_an_hour(entity, ts)
    peak = F.max_by(F.struct("z", ts), F.struct(F.abs("z"), -F.unix_micros(F.col(ts).cast("timestamp"))))
    out = islands(hits, entity, ts, ~same).groupBy(*entity, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("length"), F.first("direction").alias("direction"), peak.alias("p"))
    return out.select(*entity, "start", "end", "length", "direction", F.col("p.z").alias("peak_z"), F.col(f"p.{ts}").alias("peak_at"))


# Why a run may begin or end where it does; the first that holds is told, and only the last says that the excursion was over.
BOUNDARIES = ("outside_requested_span", "series_edge", "absent", "agency_rejected", "value_null", "unscored", "direction_reversal", "below_threshold")


def boundaries(runs: DataFrame, scored: DataFrame, entity: list[str], ts: str, present: DataFrame | None = None, requested: tuple | None = None) -> DataFrame:
    """runs with left_reason, right_reason (of BOUNDARIES) and censored: whether either is another than the last, so that the length is a lower bound.

    A run has two sides, the hours just outside it; all sides are rows of one table, which meets
    the record of hours once. present: every row of the series with boolean usable and rejected,
    scored or not (by default the scored rows, all usable). requested: first and last hour asked
    for; beyond them the question ends, not the record. An hour in the run's own direction would
    have joined it, so an excursion just outside goes the other way.
    """
    if present is None:
        present = scored.select(*entity, ts, F.lit(True).alias("usable"), F.lit(False).alias("rejected"))
    told = scored.where("z IS NOT NULL").select(*entity, ts, F.struct("excursion", "direction").alias("__score"))
    record = present.select(*entity, ts, "usable", "rejected").join(told, [*entity, ts], "left")
    record = record.select(*entity, F.col(ts).alias("__hour"), F.struct("usable", "rejected", "__score").alias("__there"))
    reach = present.groupBy(*entity).agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last")).alias("__reach"))
    hour = F.expr("interval 1 hour")
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), (F.col("start") - hour).alias("at")), F.struct(F.lit("right").alias("side"), (F.col("end") + hour).alias("at"))))
    rows = runs.select(*entity, F.struct(*runs.columns).alias("__run"), sides.alias("__s")).withColumn("__hour", F.col("__s.at"))
    rows = rows.join(reach, entity, "left").join(record, [*entity, "__hour"], "left")
    at, there = F.col("__hour"), F.col("__there")
    holds = (
        F.lit(False) if requested is None else (at < F.lit(requested[0])) | (at > F.lit(requested[1])),
        (at < F.col("__reach.first")) | (at > F.col("__reach.last")),
        there.isNull(),
        ~there["usable"] & there["rejected"],
        ~there["usable"],
        there["__score"].isNull(),
        there["__score"]["excursion"] & (there["__score"]["direction"] != F.col("__run.direction")),
    )
    why = rows.select("__run", F.col("__s.side").alias("side"), cascade(list(zip(holds, BOUNDARIES)), BOUNDARIES[-1]).alias("why"))
    both = why.groupBy("__run").agg(*(F.max(F.when(F.col("side") == s, F.col("why"))).alias(f"{s}_reason") for s in ("left", "right")), F.bool_or(F.col("why") != BOUNDARIES[-1]).alias("censored"))
    return both.select("__run.*", "left_reason", "right_reason", "censored")


def interpolate(df: DataFrame, entity: list[str], ts: str, value: str, longest: int) -> DataFrame:
    """Linear between known neighbours where the whole gap is at most `longest` rows; `<value>_imputed` marks what was filled."""
    w = Window.partitionBy(*entity).orderBy(ts)
    at = df.withColumn("__i", F.row_number().over(w)).withColumn("__k", F.when(F.col(value).isNotNull(), F.col("__i")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = at.select(
        *at.columns,
        F.last(value, True).over(back).alias("__v0"),
        F.last("__k", True).over(back).alias("__i0"),
        F.first(value, True).over(ahead).alias("__v1"),
        F.first("__k", True).over(ahead).alias("__i1"),
    )
    fits = F.col(value).isNull() & (F.col("__i1") - F.col("__i0") - 1 <= longest)
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__i") - F.col("__i0")) / (F.col("__i1") - F.col("__i0"))
    fill = F.coalesce(fits, F.lit(False))
    return rows.select(*(c for c in df.columns if c != value), F.when(fill, line).otherwise(F.col(value)).alias(value), fill.alias(f"{value}_imputed"))


def numbered(df: DataFrame, order: list[str], coarse: Column, name: str) -> DataFrame:
    """Rows with their place (from 0) in a total order, without one task for all rows.

    coarse rises with the order (a day, say): rows are numbered within it and shifted by the
    counts of the coarse values before, which are few.
    """
    marked = df.withColumn("__c", coarse)
    counts = marked.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("__c")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__c").alias("__d"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__c").orderBy(*order)) - 1
    met = marked.withColumn("__inside", inside).join(offsets, F.col("__c").eqNullSafe(F.col("__d")))
    return met.withColumn(name, F.col("__inside") + F.col("__ahead")).drop("__c", "__d", "__inside", "__ahead")


def cumulated(counts: DataFrame, keys: list[str], value: str, n: str = "__n", bins: int = 128) -> DataFrame:
    """Counts of a key's distinct numbers with `__upto` (all up to and with each, in order) and `__all`, without one task for a key.

    Approximate quantiles of each key cut its values into bins; a window holds one bin, and is shifted
    by the sums of the bins before it, which are few. The cuts steer the work only: sums are exact.
    Values must not be null; NaN comes last; null keys are keys.
    """
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 1000).alias("__cuts"))

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if not on:
            return left.crossJoin(F.broadcast(right))  # one row
        right = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
        same = F.lit(True)
        for k in on:
            same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        return left.join(right, same).drop(*(f"__r_{k}" for k in on))

    binned = met(counts, cuts, keys).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    ahead = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    sizes = binned.groupBy(*keys, "__bin").agg(F.sum(n).alias("__size"))
    sizes = sizes.select(*keys, "__bin", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__size").over(whole).alias("__all"))
    inside = Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return met(binned.withColumn("__inside", F.sum(n).over(inside)), sizes, [*keys, "__bin"]).withColumn("__upto", F.col("__ahead") + F.col("__inside")).drop("__bin", "__ahead", "__inside")


def average_ranks(df: DataFrame, keys: list[str], value: str, average: str = "average_rank", least: str = "min_rank") -> DataFrame:
    """Rows with the mean and the least rank (from 1) of their number within a key, few and long ones too; nulls have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    first = F.col("__upto") - F.col("__n") + 1
    found = cumulated(counts, keys, value).select(*(F.col(k).alias(f"__r_{k}") for k in [*keys, value]), first.cast("long").alias(least), (first + (F.col("__n") - 1) / F.lit(2.0)).alias(average))
    same = F.col(value) == F.col(f"__r_{value}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(found, same, "left").select(*df.columns, average, least)


def rolling_origin(df: DataFrame, order: list[str], splits: int, least_train: float = 0.4) -> DataFrame:
    """Rows with fold (from 1) and role: fold f trains on all rows before its test slice; slices of one size march on from the first least_train of the rows.

    No folds where there are not more rows than splits. order begins with a timestamp and is total.
    """
    n = df.count()
    first = int(n * least_train)
    step = max(1, (n - first) // splits)
    cuts = [(f + 1, first + f * step, min(first + (f + 1) * step, n)) for f in range(splits)] if n > splits else []
    cuts = [c for c in cuts if 0 < c[1] < c[2]]
    if not cuts:
        return df.limit(0).select("*", F.lit(0).alias("fold"), F.lit("").alias("role"))
    ranked = numbered(df, order, F.to_date(order[0]), "__n")
    folds = F.explode(F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, a, b in cuts)))
    role = F.when(F.col("__n") < F.col("__f.a"), "train").when(F.col("__n") < F.col("__f.b"), "test")
    return ranked.withColumn("__f", folds).select(*df.columns, F.col("__f.fold").alias("fold"), role.alias("role")).where("role is not null")


def annual_folds(year: int) -> list[tuple]:
    """(name, train start, train end, test start, test end) of a year's expanding quarters, for `time_folds`; ends are exclusive."""
    from datetime import datetime

    if isinstance(year, bool) or not isinstance(year, int) or year <= 0:
        raise ValueError("a positive year")
    ends = [datetime(year, 4, 1), datetime(year, 7, 1), datetime(year, 10, 1), datetime(year + 1, 1, 1)]
    return [(f"q{k + 2}", datetime(year, 1, 1), a, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
