"""Devices beside reference stations: hours of several measured quantities, eligible pairs, device-days, cohorts.

Readings are long rows (device, ts, variable, value, lat, lon). Every table keeps its
denominators; reasons are the first of an ordered list of rules that holds, so each row is
excluded once. One shuffle by device and time serves all variables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.qc import cascade


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def buckets(readings: DataFrame, device: str, ts: str, unit: str, variables: list[str], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per device and time unit (hour, day), for each variable v: v_rows, v_times (distinct timestamps), v_mean, v_extreme (rows beyond its limits); null counts where a variable has no row."""
    aggs = []
    for v in variables:
        mine = F.col("variable") == v
        low, high = limits[v]
        rows = F.count_if(mine)
        aggs += [
            F.when(rows > 0, rows).alias(f"{v}_rows"),
            F.when(rows > 0, F.count_distinct(F.when(mine, F.col(ts)))).alias(f"{v}_times"),
            F.avg(F.when(mine, F.col("value"))).alias(f"{v}_mean"),
            F.when(rows > 0, F.count_if(mine & ((F.col("value") < low) | (F.col("value") > high)))).alias(f"{v}_extreme"),
        ]
    return readings.groupBy(device, F.date_trunc(unit, ts).cast("timestamp_ntz").alias("slot")).agg(*aggs)


def pair_reason(main: str, others: list[str], least: int) -> Column:
    """Why a device's time unit can't be paired with its reference, in order: other quantities absent, no value, few rows, repeated timestamps, extremes, the reference absent or not eligible."""
    every = [main, *others]
    rules = [(F.col(f"{v}_rows").isNull(), f"missing_{v}") for v in others]
    rules += [(F.col(f"{v}_mean").isNull(), f"missing_{v}_value") for v in every]
    rules += [(F.col(f"{v}_rows") < least, f"insufficient_{v}_rows") for v in every]
    rules += [(F.col(f"{v}_rows") != F.col(f"{v}_times"), f"duplicate_{v}_timestamp") for v in every]
    rules += [(F.col(f"{v}_extreme") > 0, f"extreme_{v}") for v in every]
    rules += [(~F.col("ground_present"), "ground_absent"), (~F.col("ground_eligible"), "ground_present_but_ineligible")]
    return cascade(rules, "eligible")


def pairs(units: DataFrame, nearest: DataFrame, ground: DataFrame, device: str, station: str, main: str) -> DataFrame:
    """Units that have the main variable, beside their nearest reference's row of the same time.

    nearest: (device, station, km); ground: (station, slot, ground_value, valid), unique by station and time.
    """
    seen = ground.select(station, "slot", "ground_value", "valid", F.lit(True).alias("ground_present"))
    out = units.where(F.col(f"{main}_rows").isNotNull()).join(nearest, device).join(seen, [station, "slot"], "left")
    good = F.coalesce(F.col("valid") & F.col("ground_value").isNotNull(), F.lit(False))
    return out.withColumn("ground_present", F.coalesce("ground_present", F.lit(False))).withColumn("ground_eligible", good).drop("valid")


def coverage_grid(paired: DataFrame, device: str, station: str, main: str, others: list[str], radii: list[float], least: list[int]) -> DataFrame:
    """For each radius and least number of rows: units, devices, eligible pairs, their stations and days; one pass, the grid exploded (few cells)."""
    cells = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.lit(int(m)).alias("least")) for r in radii for m in least)))
    rows = paired.withColumn("cell", cells).select("*", "cell.radius", "cell.least").where(F.col("km") <= F.col("radius"))
    every = [main, *others]
    broken = _any([F.col(f"{v}_rows").isNull() | F.col(f"{v}_mean").isNull() | (F.col(f"{v}_rows") < F.col("least")) | (F.col(f"{v}_rows") != F.col(f"{v}_times")) | (F.col(f"{v}_extreme") > 0) for v in every])
    good = ~F.coalesce(broken, F.lit(True)) & F.col("ground_eligible")
    return rows.groupBy("radius", "least").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_distinct(device).alias("devices"),
        F.count_if(good).alias("eligible_pairs"),
        F.count_distinct(F.when(good, F.col(station))).alias("eligible_stations"),
        F.count_distinct(F.when(good, F.to_date("slot"))).alias("eligible_dates"),
    )


def fold_coverage(paired: DataFrame, device: str, station: str) -> DataFrame:
    """Rows, devices and stations of the eligible pairs by held-out day and by held-out station."""
    good = paired.where("reason = 'eligible'")
    kinds = F.explode(F.array(F.struct(F.lit("date").alias("kind"), F.to_date("slot").cast("string").alias("fold")), F.struct(F.lit("station").alias("kind"), F.col(station).cast("string").alias("fold"))))
    return good.withColumn("f", kinds).groupBy("f.kind", "f.fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(device).alias("devices"), F.count_distinct(station).alias("stations"))


def device_days(readings: DataFrame, device: str, ts: str, variables: list[str], limits: dict[str, tuple[float, float]], bounds: tuple[float, float, float, float], filed: str | None = None) -> DataFrame:
    """Ledger of device-days: for each variable v source rows, null timestamps, null values, groups of repeated timestamps, extremes, observed hours; hours with all variables; the day's position and its state.

    bounds: least and greatest lat, least and greatest lon of the area. filed: column with the day
    that a reading was filed under, which a reading without a timestamp needs to belong to a day;
    else the day is the timestamp's. The readings are grouped once, by device, hour, variable and
    timestamp; all counts come from those groups, so a device's day is never held whole.
    """
    day = F.to_date(ts) if filed is None else F.coalesce(F.col(filed), F.to_date(ts))
    first = readings.groupBy(device, day.alias("date"), F.hour(ts).alias("hour"), "variable", F.col(ts).alias("__ts")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count_if(_any([(F.col("variable") == v) & ((F.col("value") < limits[v][0]) | (F.col("value") > limits[v][1])) for v in variables])).alias("extreme"),
        F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_place"),
        *(f(F.col(c)).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))),
    )
    timed = F.col("__ts").isNotNull()
    aggs = []
    for v in variables:
        mine = F.col("variable") == v
        total = lambda c, where=mine: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
        aggs += [
            total("rows").alias(f"{v}_source_rows"),
            total("rows", mine & ~timed).alias(f"{v}_null_timestamp_rows"),
            total("nulls").alias(f"{v}_null_value_rows"),
            F.count_if(mine & timed & (F.col("rows") > 1)).alias(f"{v}_duplicate_timestamp_groups"),
            total("extreme").alias(f"{v}_extreme_rows"),
            F.count_distinct(F.when(mine, F.col("hour"))).alias(f"{v}_observed_hours"),
        ]
    places = [getattr(F, n)(f"{c}_{n}").alias(f"{c}_{n}") for c in ("lat", "lon") for n in ("min", "max")]
    # a bit for each variable that an hour has, gathered over the day's 24 hours
    bit = F.lit(0)
    for k, v in enumerate(variables):
        bit = F.when(F.col("variable") == v, 1 << k).otherwise(bit)
    have = [F.bit_or(F.when(F.col("hour") == h, bit)) for h in range(24)]
    trio = sum((F.when(x == (1 << len(variables)) - 1, 1).otherwise(0) for x in have), F.lit(0)).cast("long")
    days = first.groupBy(device, "date").agg(*aggs, F.sum("no_place").alias("null_places"), *places, trio.alias("trio_observed_hours"))
    outside = ~F.col("lat_min").between(*bounds[:2]) | ~F.col("lon_min").between(*bounds[2:])
    state = cascade([(F.col("null_places") > 0, "invalid_or_null_coordinate"), ((F.col("lat_min") != F.col("lat_max")) | (F.col("lon_min") != F.col("lon_max")), "moving_coordinate"), (outside, "outside_area")], "eligible")
    return days.withColumn("spatial_state", state)


def agreement_reason(variables: list[str], least_rows: int, least_hours: int, least_ground: int) -> Column:
    """Why a device-day can't be compared with its reference's day: absent; for each variable null timestamps, null values, repeated timestamps, extremes, few rows, few hours; the reference absent or with few eligible hours."""
    rows = F.lit(0)
    for v in variables:
        rows = rows + F.col(f"{v}_source_rows")
    rules = [(rows == 0, "device_day_absent")]
    for v in variables:
        rules += [(F.col(f"{v}_{m}") > 0, f"{v}_{s}") for m, s in (("null_timestamp_rows", "null_timestamp"), ("null_value_rows", "null_value"), ("duplicate_timestamp_groups", "duplicate_timestamp"), ("extreme_rows", "extreme_value"))]
        rules += [(F.col(f"{v}_source_rows") < least_rows, f"{v}_insufficient_source_rows"), (F.col(f"{v}_observed_hours") < least_hours, f"{v}_insufficient_observed_hours")]
    rules += [(F.col("ground_present_hours") == 0, "ground_absent"), (F.col("ground_eligible_hours") < least_ground, "ground_present_but_ineligible")]
    return cascade(rules, "eligible")


def cohort(days: DataFrame, nearest: DataFrame, device: str, least_months: int = 3, least_dates: int = 30, least_hours: int = 360, most_km: float = 10.0) -> DataFrame:
    """One row a device: its active dates and months, dates and hours with all variables, its place over the whole year, nearest reference, and why it is excluded."""
    out = days.groupBy(device).agg(
        F.count_distinct("date").alias("active_dates"),
        F.count_distinct(F.trunc("date", "MM")).alias("active_months"),
        F.count_distinct(F.when(F.col("trio_observed_hours") > 0, F.col("date"))).alias("trio_dates"),
        F.sum("trio_observed_hours").alias("trio_observed_hours"),
        F.sum("null_places").alias("null_places"),
        F.min("lat_min").alias("__a"),
        F.max("lat_max").alias("__b"),
        F.min("lon_min").alias("__c"),
        F.max("lon_max").alias("__d"),
        F.count_if(F.col("spatial_state") == "outside_area").alias("outside_dates"),
    )
    place = cascade([(F.col("__a").isNull(), "missing_coordinate"), (F.col("null_places") > 0, "invalid_or_null_coordinate"), ((F.col("__a") != F.col("__b")) | (F.col("__c") != F.col("__d")), "moving_coordinate"), (F.col("outside_dates") > 0, "outside_area")], "eligible")
    out = out.withColumn("spatial_state", place).join(nearest.select(device, "km"), device, "left")
    rules = [
        (F.col("spatial_state") != "eligible", F.col("spatial_state")),
        (F.col("active_months") < least_months, f"fewer_than_{least_months}_active_months"),
        (F.col("trio_dates") < least_dates, f"fewer_than_{least_dates}_trio_dates"),
        (F.col("trio_observed_hours") < least_hours, f"fewer_than_{least_hours}_trio_hours"),
        (F.col("km").isNull(), "missing_reference_station"),
        (F.col("km") > most_km, "beyond_reach"),
    ]
    reason = F.lit("eligible_at_relaxed_threshold")
    for condition, name in reversed(rules):
        reason = F.when(condition, name if isinstance(name, Column) else F.lit(name)).otherwise(reason)
    return out.withColumn("exclusion_reason", reason).drop("__a", "__b", "__c", "__d", "null_places", "outside_dates")


def cohort_grid(devices: DataFrame, months: list[int], dates: list[int], hours: list[int], km: list[float]) -> DataFrame:
    """Devices that pass each combination of four thresholds; the grid's cells are rows of one aggregate (few)."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("months"), F.lit(b).alias("dates"), F.lit(c).alias("hours"), F.lit(float(d)).alias("km")) for a in months for b in dates for c in hours for d in km)))
    rows = devices.select("spatial_state", "active_months", "trio_dates", "trio_observed_hours", F.col("km").alias("away"), cells.alias("c"))
    passes = (F.col("spatial_state") == "eligible") & (F.col("active_months") >= F.col("c.months")) & (F.col("trio_dates") >= F.col("c.dates")) & (F.col("trio_observed_hours") >= F.col("c.hours")) & (F.col("away") <= F.col("c.km"))
    return rows.groupBy("c.months", "c.dates", "c.hours", "c.km").agg(F.count_if(passes).alias("devices"))
