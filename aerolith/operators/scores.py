"""Evaluation: metrics, folds, baselines, skill, paired differences and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import is_finite


def metrics(df: DataFrame, by: list[str], truth: str, predicted: str, exceeds: float) -> DataFrame:
    """n, rmse, mae, r2 (null where truth is constant) and F1 of exceeding a limit; pairs that aren't finite don't count."""
    y, p = F.col(truth), F.col(predicted)
    ok = is_finite(y) & is_finite(p)
    e = p - y
    hit, said, was = F.count_if((y > exceeds) & (p > exceeds)), F.count_if(p > exceeds), F.count_if(y > exceeds)
    total = F.var_pop(y) * F.count(F.lit(1))
    return df.where(ok).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.when(F.var_pop(y) > 0, 1 - F.try_divide(F.sum(e * e), total)), 6).alias("r2"),
        F.round(F.try_divide(2.0 * hit, said + was), 6).alias("f1"),
    )


def persistence(df: DataFrame, entity: list[str], ts: str, value: str, horizon: int = 1) -> DataFrame:
    """The value `horizon` rows ago as the prediction."""
    return df.withColumn("predicted", F.lag(value, horizon).over(Window.partitionBy(*entity).orderBy(ts)))


def climatology(train: DataFrame, test: DataFrame, entity: list[str], ts: str, value: str) -> DataFrame:
    """Training mean of the entity's month and hour as the prediction; the training mean where there is none."""
    cell = [*entity, "__month", "__hour"]
    with_cell = lambda d: d.withColumn("__month", F.month(ts)).withColumn("__hour", F.hour(ts))
    means = with_cell(train).groupBy(*cell).agg(F.avg(value).alias("__cell"))
    overall = train.agg(F.avg(value).alias("__all"))
    return with_cell(test).join(means, cell, "left").crossJoin(F.broadcast(overall)).withColumn("predicted", F.coalesce("__cell", "__all")).drop("__month", "__hour", "__cell", "__all")


def skill(df: DataFrame, by: list[str], model: str, baseline: str, error: str = "rmse") -> DataFrame:
    """1 - error of the model / error of the baseline, from a table with a `model` column."""
    pair = df.groupBy(*by).agg(F.max(F.when(F.col("model") == model, F.col(error))).alias("own"), F.max(F.when(F.col("model") == baseline, F.col(error))).alias("base"))
    return pair.select(*by, F.round(1 - F.try_divide(F.col("own"), F.col("base")), 6).alias("skill"))


def summary(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean and worst over splits, and how many don't beat the baseline."""
    return df.groupBy(*by).agg(F.count(score).alias("splits"), F.round(F.avg(score), 6).alias("mean"), F.min(score).alias("worst"), F.count_if(F.col(score) <= 0).alias("not_beating"))


def held_out_sums(df: DataFrame, what: str, sums: dict) -> DataFrame:
    """For each value of `what` (fold) sums (name: column) over its own rows (test) and over all others (train), rows read once.

    Training sums are the total less the fold's own, so no row meets any fold; rows without a value only train.
    A role without rows is absent.
    """
    own = df.groupBy(F.col(what).alias("fold")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    whole = Window.partitionBy(F.lit(1))  # one row for each fold
    names = ["n", *sums]
    both = F.array(F.struct(F.lit("test").alias("role"), *names), F.struct(F.lit("train").alias("role"), *((F.sum(c).over(whole) - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names)))
    return own.select("fold", both.alias("__b")).where("fold is not null").select("fold", F.explode("__b").alias("__b")).select("fold", "__b.*").where("n > 0")


def leave_one_out(df: DataFrame, what: str) -> DataFrame:
    """Rows with fold and role: each value of `what` (few) is tested once, by a model of all others.

    The result holds each row once for each fold; where sums will do, take `held_out_sums`.
    """
    folds = df.select(F.col(what).alias("fold")).distinct()
    return df.crossJoin(folds).withColumn("role", F.when(F.col(what) == F.col("fold"), "test").otherwise("train"))


def time_folds(df: DataFrame, ts: str, cuts: DataFrame) -> DataFrame:
    """Expanding folds from a small table (fold, test_from, test_to): earlier rows train, [from, to) tests, the rest is absent."""
    role = F.when(F.col(ts) < F.col("test_from"), "train").when(F.col(ts) < F.col("test_to"), "test")
    return df.crossJoin(cuts).withColumn("role", role).where("role is not null").drop("test_from", "test_to")


def station_folds(stations: DataFrame, key: str, stratum: str, k: int) -> DataFrame:
    """Fold of each station: its place by (stratum, nulls last; key), modulo k. stations is a small dimension."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last(stratum), key)) - 1
    return stations.select(key, stratum, place.alias("place")).select(key, stratum, (F.col("place") % k).cast("long").alias("fold"))


def tested_once(test: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys never tested, and keys tested more than once."""
    n = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = every.select(*keys).distinct().join(n, keys, "left")
    return joined.agg(F.count_if(F.col("n").isNull()).alias("never"), F.count_if(F.col("n") > 1).alias("repeated"))


def paired_deltas(scores: DataFrame, by: list[str], variant: str, base: str, other: str, columns: list[str]) -> DataFrame:
    """other minus base of each metric, side by side."""
    wide = scores.groupBy(*by).agg(*(F.max(F.when(F.col(variant) == v, F.col(c))).alias(f"__{v}_{c}") for v in (base, other) for c in columns))
    return wide.select(*by, *(F.round(F.col(f"__{other}_{c}") - F.col(f"__{base}_{c}"), 6).alias(f"d_{c}") for c in columns))


def delta_summary(deltas: DataFrame, by: list[str], rmse: str, r2: str) -> DataFrame:
    """Folds where both metrics improve, both worsen, tie or disagree, and the median differences."""
    better, worse = (F.col(rmse) < 0) & (F.col(r2) > 0), (F.col(rmse) > 0) & (F.col(r2) < 0)
    tie = (F.col(rmse) == 0) & (F.col(r2) == 0)
    return deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(better).alias("both_improved"),
        F.count_if(worse).alias("both_worse"),
        F.count_if(tie).alias("ties"),
        F.count_if(~better & ~worse & ~tie).alias("mixed"),
        F.round(F.median(rmse), 6).alias("median_d_rmse"),
        F.round(F.median(r2), 6).alias("median_d_r2"),
    )


def transfer_folds(df: DataFrame, entity: str, year: str) -> DataFrame:
    """Forward transfer: rows with train_year, test_year and role for each pair of an entity's years, the earlier training (years are few)."""
    years = df.select(entity, F.col(year).alias("__y")).distinct()
    pairs = years.select(entity, F.col("__y").alias("train_year")).join(years.select(entity, F.col("__y").alias("test_year")), entity).where("train_year < test_year")
    role = F.when(F.col(year) == F.col("train_year"), "train").otherwise("test")
    return df.join(pairs, entity).where((F.col(year) == F.col("train_year")) | (F.col(year) == F.col("test_year"))).withColumn("role", role)


def held_station_scores(predictions: DataFrame, fold: str, entity: str, truth: str, predicted: str, exceeds: float) -> DataFrame:
    """Metrics of each held station on its own, then how they spread over a fold's stations."""
    own = metrics(predictions, [fold, entity], truth, predicted, exceeds)
    return own.groupBy(fold).agg(F.count(F.lit(1)).alias("stations"), F.round(F.median("rmse"), 6).alias("median_rmse"), F.round(F.max("rmse"), 6).alias("worst_rmse"))
