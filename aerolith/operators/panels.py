"""Panels over years: comparable years, balanced panels, trends, sensitivity grids, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.domain import attributable_fraction


def annual(days: DataFrame, entity: str, date: str, value: str, limit: float, least: float = 0.75) -> DataFrame:
    """Per entity and year: mean, max, days, exceedances, leap-aware coverage, comparable, and rank among the year's comparable means."""
    year = F.year(date)
    out = days.groupBy(entity, year.cast("int").alias("year")).agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"), F.count(value).alias("days"), F.count_if(F.col(value) > limit).alias("exceedances"))
    in_year = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    out = out.withColumn("coverage", F.round(F.col("days") / in_year, 6)).withColumn("comparable", F.col("days") / in_year >= least)
    rank = F.rank().over(Window.partitionBy("year", "comparable").orderBy(F.desc("mean")))
    return out.withColumn("rank", F.when(F.col("comparable"), rank).cast("long"))


def balanced_options(years: DataFrame, entity: str, year: str, last: int, starts: list[int]) -> DataFrame:
    """For each start year: entities present in every year from it to `last`, and the station-years that gives."""
    spans = years.select(entity, year).distinct().withColumn("start", F.explode(F.array(*map(F.lit, starts)))).where((F.col(year) >= F.col("start")) & (F.col(year) <= last))
    full = spans.groupBy("start", entity).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == last - F.col("start") + 1)
    return full.groupBy("start").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("entity_years"))


def choose_start(options: DataFrame) -> DataFrame:
    """The start with the most entity-years; ties to the longer panel."""
    return options.orderBy(F.desc("entity_years"), F.asc("start")).limit(1)


def national_trend(years: DataFrame, entity: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """Per year the mean over all entities, and over those present in every year of the span."""
    span = years.where(F.col(year).between(first, last))
    full = span.groupBy(entity).agg(F.count_distinct(year).alias("n")).where(F.col("n") == last - first + 1).select(entity, F.lit(True).alias("__in"))
    return span.join(full, entity, "left").groupBy(year).agg(
        F.count(F.lit(1)).alias("n_all"), F.round(F.avg(value), 6).alias("mean_all"), F.count_if("__in").alias("n_balanced"), F.round(F.avg(F.when(F.col("__in"), F.col(value))), 6).alias("mean_balanced")
    )


def trend_by_group(years: DataFrame, group: str, year: str, value: str) -> DataFrame:
    return years.groupBy(group, year).agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg(value), 6).alias("mean"))


def present_in_all(df: DataFrame, entity: str, what: str) -> DataFrame:
    """Entities that occur with every value of `what` (relational division)."""
    every = df.agg(F.count_distinct(what).alias("__all"))
    return df.groupBy(entity).agg(F.count_distinct(what).alias("n")).join(F.broadcast(every), F.col("n") == F.col("__all")).select(entity, "n")


def missing_members(df: DataFrame, entity: str, what: str) -> DataFrame:
    """Per entity that lacks some value of `what` (few values): those it lacks, sorted."""
    every = df.select(what).distinct()
    lacking = df.select(entity).distinct().crossJoin(every).join(df.select(entity, what).distinct(), [entity, what], "left_anti")
    return lacking.groupBy(entity).agg(F.array_sort(F.collect_set(what)).alias("missing"))


def sensitivity_grid(years: DataFrame, entity: str, year: str, value: str, functions: DataFrame) -> DataFrame:
    """Attributable fraction of each entity-year under each row of a small table (function, bound, beta, counterfactual)."""
    paf = attributable_fraction(F.col(value), F.col("beta"), F.col("counterfactual"))
    return years.crossJoin(F.broadcast(functions)).select(entity, year, "function", "bound", "counterfactual", F.round(paf, 6).alias("paf"))


def assumption_spread(grid: DataFrame, year: str) -> DataFrame:
    """Per year the median over entities for each assumption, and the spread of these medians."""
    medians = grid.groupBy(year, "function", "bound", "counterfactual").agg(F.median("paf").alias("m"))
    return medians.groupBy(year).agg(F.round(F.min("m"), 6).alias("low"), F.round(F.median("m"), 6).alias("mid"), F.round(F.max("m"), 6).alias("high"), F.count(F.lit(1)).alias("assumptions"))


def cbpf(df: DataFrame, speed: str, bearing: str, value: str, quantile: float, sector: float, speeds: list[float], least: int, calm: float = 0.0) -> DataFrame:
    """Conditional probability of a high value by wind sector and speed bin (right-closed); null where under `least` rows.

    Rows without value, speed or bearing don't count. Calm rows (speed at most `calm`) have no
    direction: they count for the threshold, a linear quantile of all values, and for no sector.
    """
    from aerolith.functions.domain import wind_sector
    from aerolith.functions.maths import right_closed
    from aerolith.operators.aggregate import linear_quantile

    known = df.dropna(subset=[speed, bearing, value])
    high = linear_quantile(known, [], value, quantile, "threshold")
    moving = known.where(F.col(speed) > calm)
    rows = moving.crossJoin(F.broadcast(high)).withColumn("sector", wind_sector(F.col(bearing), sector).cast("long")).withColumn("speed_bin", right_closed(F.col(speed), speeds))
    out = rows.groupBy("sector", "speed_bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > F.col("threshold")).alias("n_high"))
    return out.withColumn("probability", F.when(F.col("n") >= least, F.round(F.col("n_high") / F.col("n"), 6)))


def cbpf_summary(df: DataFrame, grid: DataFrame, speed: str, bearing: str, value: str, calm: float = 0.0) -> DataFrame:
    """One row beside a grid: rows, calm rows, suppressed cells, and sector and speed bin of the highest probability (ties to the smaller)."""
    known = df.dropna(subset=[speed, bearing, value]).agg(F.count(F.lit(1)).alias("n_hours"), F.count_if(F.col(speed) <= calm).alias("n_calm"))
    best = F.min(F.when(F.col("probability").isNotNull(), F.struct(-F.col("probability"), "sector", "speed_bin")))
    cells = grid.agg(F.count_if(F.col("probability").isNull()).alias("n_suppressed"), best.alias("b"))
    return known.crossJoin(F.broadcast(cells)).select("n_hours", "n_calm", "n_suppressed", F.col("b.sector").alias("peak_sector"), F.col("b.speed_bin").alias("peak_speed"))


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Every date from the first to the last."""
    return df.agg(F.min(date).alias("a"), F.max(date).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))


def calendar_coverage(df: DataFrame, date: str) -> DataFrame:
    """Rows on each date of the span, with a state: an absent date is said to be absent, not zero."""
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("rows"))
    return calendar(counts, date).join(counts, date, "left").withColumn("state", F.when(F.col("rows").isNull(), "absent").otherwise("observed"))
