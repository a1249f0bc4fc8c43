"""Reports: flags against their denominators, verdicts by month, years from whole months, names and zones of stations, event backlogs, cards, the normality fallacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import digest
from aerolith.operators.qc import majority_label


def flag_rates(df: DataFrame, by: list[str], what: list[str], flag: str, flags: list[str], counted: Column | None = None) -> DataFrame:
    """Rows with each of some flags (sentinels, out of range) by `by` and `what`, beside the rows of `by` that could have had them, and the rate.

    counted: which rows make the denominator (say, the wind directions); all by default.
    """
    found = df.where(F.col(flag).isin(*flags)).groupBy(*by, *what, flag).agg(F.count(F.lit(1)).alias("n"))
    cells = df.where(counted if counted is not None else F.lit(True)).groupBy(*by).agg(F.count(F.lit(1)).alias("cells"))
    return found.join(cells, by, "left").withColumn("rate", F.round(F.col("n") / F.col("cells"), 6))


def verdict_seasonality(judged: DataFrame, by: list[str], start: str = "start") -> DataFrame:
    """Runs by verdict, direction and month of their first hour."""
    return judged.groupBy(*by, "verdict", "direction", F.month(start).alias("month")).agg(F.count(F.lit(1)).alias("runs"))


def years_from_months(months: DataFrame, by: list[str], month: str, value: str, least: int = 11) -> DataFrame:
    """Mean of a year's monthly values, null where fewer than `least` months are known; the months counted beside it."""
    out = months.groupBy(*by, F.year(month).alias("year")).agg(F.count(value).alias("months"), F.avg(value).alias("__m"))
    return out.withColumn("mean", F.when(F.col("months") >= least, F.col("__m"))).drop("__m")


def normalised_name(name: str, aliases: dict[str, str]) -> Column:
    """A name without blanks around it, under its official spelling where it has another."""
    trimmed = F.trim(F.col(name))
    if not aliases:
        return trimmed
    known = F.create_map(*(F.lit(v) for pair in sorted(aliases.items()) for v in pair))
    return F.coalesce(F.try_element_at(known, trimmed), trimmed)


def zones(members: DataFrame, station: str, member: str, pattern: str, overrides: dict[str, str]) -> DataFrame:
    """Zone of each station from its members' paths: the commonest, ties to the smaller name, and whether there were several; overrides speak only where no path does."""
    pairs = members.select(station, member).distinct()
    found = pairs.withColumn("zone", F.nullif(F.regexp_extract(member, pattern, 1), F.lit("")))
    best = majority_label(found, [station], "zone").select(station, "zone", "ambiguous")
    fallback = F.try_element_at(F.create_map(*(F.lit(v) for pair in sorted(overrides.items()) for v in pair)), F.col(station)) if overrides else F.lit(None).cast("string")
    out = pairs.select(station).distinct().join(best, station, "left")
    return out.select(station, F.coalesce("zone", fallback).alias("zone"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def event_backlog(events: DataFrame) -> DataFrame:
    """What of the events (name, verified, start, source_url, note) is usable, and why the rest is not yet."""
    said = F.coalesce("verified", F.lit(False))
    return events.select("name", said.alias("verified"), F.col("start").isNotNull().alias("has_start"), "source_url", F.when(~said, F.col("note")).alias("why_not"))


def cards(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """A JSON card of each key: first and last day, hours, known hours, and the month of the highest mean (ties to the later)."""
    months = df.groupBy(key, F.date_format(ts, "yyyy-MM").alias("month")).agg(F.round(F.avg(value), 2).alias("m"))
    peak = months.groupBy(key).agg(F.max_by("month", F.struct("m", "month")).alias("peak_month"))
    own = df.groupBy(key).agg(F.date_format(F.min(ts), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("last_day"), F.count(F.lit(1)).alias("hours"), F.count(value).alias("known"))
    return own.join(peak, key, "left").select(key, F.to_json(F.struct("first_day", "last_day", "hours", "known", "peak_month")).alias("card"))


def normality_fallacy(df: DataFrame, key: str, value: str, sizes: list[int]) -> DataFrame:
    """Jarque-Bera statistic and p of repeatable samples of growing size: a departure that hardly matters is rejected once there are enough rows.

    sizes are those of test samples (some thousand rows at most); 0 stands for all rows, whose
    moments are plain aggregates.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), digest(F.col(key)).alias("h"))

    def moments(rows: DataFrame, size: int) -> DataFrame:
        n = F.count(F.lit(1))
        jb = n / 6.0 * (F.pow(F.skewness("x"), 2) + F.pow(F.kurtosis("x"), 2) / 4)
        return rows.agg(F.lit(size).alias("size"), n.alias("n"), jb.alias("jb"))

    largest = known.orderBy("h", "x").limit(max([s for s in sizes if s] or [1]))
    ranked = largest.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", "x")))
    out = None
    for s in sizes:
        one = moments(ranked.where(F.col("place") <= s) if s else known, s)
        out = one if out is None else out.unionByName(one)
    return out.select("size", "n", F.round("jb", 4).alias("jb"), F.round(F.exp(-F.col("jb") / 2), 6).alias("p"))
