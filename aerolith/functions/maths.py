"""Circular and spherical geometry, quantiles, row-wise folds and safe ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's mean radius in km, and the factor that makes a MAD comparable to a standard deviation.
EARTH_KM = 6371.0088
MAD_FACTOR = 0.67449


def circular_mean(degrees: Column) -> Column:
    """Aggregate: direction of the mean unit vector, in [0, 360)."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def circular_resultant(degrees: Column) -> Column:
    """Aggregate: length of the mean unit vector, 0 (no direction) to 1 (one direction)."""
    r = F.radians(degrees)
    return F.sqrt(F.pow(F.avg(F.sin(r)), 2) + F.pow(F.avg(F.cos(r)), 2))


def weighted_resultant(degrees: Column, weight: Column) -> Column:
    """Aggregate: length of the weighted mean unit vector; null without weight."""
    r, total = F.radians(degrees), F.sum(weight)
    return F.sqrt(F.pow(F.try_divide(F.sum(weight * F.cos(r)), total), 2) + F.pow(F.try_divide(F.sum(weight * F.sin(r)), total), 2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is clamped to 1, beyond which asin isn't defined."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def mean_across(columns: list[Column]) -> Column:
    """Row-wise mean of what is not null; null if all are."""
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))
    return F.try_divide(reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns)), n)


def any_across(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_across(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def safe_ratio(a: Column, b: Column, least: float = 1e-3) -> Column:
    """a / b where b is clear of zero, else null."""
    return F.when(F.abs(b) > least, a / b)


def right_closed(x: Column, edges: list[float]) -> Column:
    """Index of the bin (edge[i-1], edge[i]] that x is in: 0 below the first edge, len(edges) above the last."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[i], F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def average_rank(x: Column, partition: list[str]) -> Column:
    """Rank in a partition, ties at their mean."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(x)
    ties = Window.partitionBy(*partition, x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson's r over rows where both are known; null (never an error) where one is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def digest(*parts) -> Column:
    """md5 of columns or values joined by bars: a draw that any engine can repeat."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def draw(*parts) -> Column:
    """The digest's first 32 bits, as a share of 1."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long") / float(1 << 32)
