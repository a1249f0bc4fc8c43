"""Features of time, chemistry, weather and health as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.functions.maths import safe_ratio


# Magnus' coefficients for saturation over water, and the first day of the trend.
MAGNUS_A, MAGNUS_B = 17.625, 243.04
TREND_FROM = "1982-01-01"


def cyclic(x: Column, period: float, name: str) -> list[Column]:
    """sin and cos of a quantity that repeats after `period`."""
    angle = x * (2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def temporal_features(ts: Column) -> list[Column]:
    """Cycles of hour, year and week (Monday 0), weekend, and days since 1982-01-01."""
    day = F.weekday(ts)
    return [
        *cyclic(F.hour(ts), 24, "hour"),
        *cyclic(F.dayofyear(ts), 365.25, "year"),
        *cyclic(day, 7, "week"),
        (day >= 5).alias("is_weekend"),
        F.datediff(ts.cast("date"), F.lit(TREND_FROM).cast("date")).cast("long").alias("trend_days"),
    ]


def chemistry_features(o3: Column, no: Column, no2: Column, nox: Column, pm25: Column, pm10: Column) -> list[Column]:
    """Total oxidant and guarded ratios."""
    return [(o3 + no2).alias("ox"), safe_ratio(no2, nox).alias("no2_share"), safe_ratio(no, no2).alias("no_to_no2"), safe_ratio(pm25, pm10).alias("fine_share")]


def wind_components(speed: Column, bearing: Column) -> list[Column]:
    """Eastward u and northward v of wind that comes from `bearing`, and the bearing's sin and cos."""
    r = F.radians(bearing)
    return [(-speed * F.sin(r)).alias("u"), (-speed * F.cos(r)).alias("v"), F.sin(r).alias("bearing_sin"), F.cos(r).alias("bearing_cos")]


def weather_features(u: Column, v: Column, t_kelvin: Column, dew_kelvin: Column, pressure_pa: Column) -> list[Column]:
    """Wind speed, degrees Celsius, relative humidity by Magnus, and hectopascals."""
    t, d = t_kelvin - 273.15, dew_kelvin - 273.15
    magnus = lambda c: F.exp(MAGNUS_A * c / (MAGNUS_B + c))
    return [F.sqrt(u * u + v * v).alias("wind_speed"), t.alias("t_c"), F.least(F.lit(100.0), 100 * magnus(d) / magnus(t)).alias("rh"), (pressure_pa / 100).alias("pressure_hpa")]


def relative_risk(concentration: Column, beta: Column, counterfactual: Column) -> Column:
    return F.exp(beta * F.greatest(F.lit(0.0), concentration - counterfactual))


def attributable_fraction(concentration: Column, beta: Column, counterfactual: Column) -> Column:
    """Share of cases due to exposure above the counterfactual."""
    rr = relative_risk(concentration, beta, counterfactual)
    return (rr - 1) / rr


def wind_sector(bearing: Column, width: float = 30.0) -> Column:
    """Lower edge of the bearing's sector; 360 degrees is 0."""
    return F.floor(F.pmod(bearing, F.lit(360.0)) / width) * width


def speed_label(speed: Column) -> Column:
    return F.when(speed < 0.5, "calm").when(speed < 2, "light").when(speed < 4, "moderate").when(speed.isNotNull(), "strong")


def local_time(utc: Column, zone: str = "Asia/Taipei") -> Column:
    """Naive local time of a naive UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("timestamp_ntz")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")
