"""Coverage-gated aggregation, partition reports and conditional summaries.

An aggregate whose coverage is under its threshold is null, never a biased mean; the
denominators stay beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import circular_mean, circular_resultant, correlation


def daily(df: DataFrame, keys: list[str], ts: str, value: str, usable: Column | None = None, circular: Column | None = None, expected: int = 24, least: int = 16) -> DataFrame:
    """Per key and day: mean, min, max, n_valid, consistency, coverage_ratio, meets_threshold; mean null under `least` readings.

    Circular rows get the mean direction, no extremes, and the resultant's length as consistency.
    One pass over the data serves both kinds.
    """
    x = F.col(value).cast("double")
    round_ = F.coalesce(circular, F.lit(False)) if circular is not None else F.lit(False)
    rows = df.where(usable if usable is not None else F.col(value).isNotNull()).withColumn("__x", x).withColumn("__round", round_)
    out = rows.groupBy(*keys, F.to_date(ts).alias("date"), "__round").agg(
        F.avg("__x").alias("__mean"),
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
        F.count("__x").alias("n_valid"),
        circular_mean(F.col("__x")).alias("__direction"),
        circular_resultant(F.col("__x")).alias("__length"),
    )
    enough = F.col("n_valid") >= least
    line = ~F.col("__round")
    return out.select(
        *keys,
        "date",
        F.when(enough, F.when(line, F.col("__mean")).otherwise(F.col("__direction"))).alias("mean"),
        F.when(line, F.col("__min")).alias("min"),
        F.when(line, F.col("__max")).alias("max"),
        "n_valid",
        F.when(~line, F.col("__length")).alias("consistency"),
        (F.col("n_valid") / F.lit(float(expected))).alias("coverage_ratio"),
        F.col("__round").alias("is_circular"),
        enough.alias("meets_threshold"),
    )


def monthly(days: DataFrame, keys: list[str], least: float = 0.75) -> DataFrame:
    """Per key and month over the days that meet their threshold; mean null under `least` of the month's days."""
    month = F.trunc("date", "MM")
    rows = days.where("meets_threshold").groupBy(*keys, month.alias("month")).agg(
        F.avg("mean").alias("__mean"),
        circular_mean(F.col("mean")).alias("__direction"),
        F.max("is_circular").alias("is_circular"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum("n_valid").alias("n_valid_hours"),
    )
    in_month = F.day(F.last_day("month")).cast("long")
    coverage = F.col("n_days") / in_month
    return rows.select(
        *keys,
        "month",
        F.when(coverage >= least, F.when(F.col("is_circular"), F.col("__direction")).otherwise(F.col("__mean"))).alias("mean"),
        "n_days",
        "n_valid_hours",
        in_month.alias("days_in_month"),
        coverage.alias("coverage_ratio"),
        (coverage >= least).alias("meets_threshold"),
    )


def partition_summary(df: DataFrame, year: Column, entity: str, measure: str, valid: Column) -> DataFrame:
    """Per year: rows, entities, measures, valid rows and their share."""
    return df.groupBy(year.cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(entity).alias("entities"),
        F.count_distinct(measure).alias("measures"),
        F.count_if(valid).alias("valid"),
        F.round(F.count_if(valid) / F.count(F.lit(1)), 4).alias("valid_ratio"),
    )


def completeness(df: DataFrame, by: list[Column], valid: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("hours"), F.count_if(valid).alias("valid"), F.round(F.count_if(valid) / F.count(F.lit(1)), 4).alias("ratio"))


def lifecycle(df: DataFrame, entity: str, year: Column) -> DataFrame:
    """First and last year of each entity, years present, span, and whether a year is missing between."""
    out = df.groupBy(entity).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("years_present"))
    span = (F.col("last_year") - F.col("first_year") + 1).cast("long")
    return out.select(entity, F.col("first_year").cast("long").alias("first_year"), F.col("last_year").cast("long").alias("last_year"), "years_present", span.alias("span"), (F.col("years_present") < span).alias("has_gap"))


def share_of(df: DataFrame, by: list[str], what: Column, name: str) -> DataFrame:
    """Rows and the count and share of those where `what` holds."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(what).alias(name), F.round(F.count_if(what) / F.count(F.lit(1)), 6).alias(f"{name}_share"))


def pair_diagnostics(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Two measures side by side: pairs, a over b where b > 0 (median, and the order statistics nearest to 5% and 95%), correlation, a > b, a = b, b <= 0."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__ratio", F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(correlation(a, b), 6).alias("corr"),
        F.count_if(F.col(a) > F.col(b)).alias("impossible"),
        F.count_if(F.col(a) == F.col(b)).alias("identical"),
        F.count_if(F.col(b) <= 0).alias("zero"),
    )
    # the median lies between the two middle places
    last = F.col("__all") - 1
    places = {"p05": F.floor(0.05 * last + 0.5), "p95": F.floor(0.95 * last + 0.5), "__low": F.floor(last / 2), "__high": F.floor(F.col("__all") / 2)}
    tails = at_places(pairs, by, "__ratio", places).withColumn("median_ratio", F.col("__low") * 0.5 + F.col("__high") * 0.5).withColumns({c: F.round(c, 6) for c in ("median_ratio", "p05", "p95")})
    keys = [F.col(k).alias(f"__{k}") for k in by]
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out.join(tails.select(*keys, "median_ratio", "p05", "p95"), same, "left").select(*out.columns, "median_ratio", "p05", "p95")


def before_after(df: DataFrame, moments: DataFrame, ts: str, value: str) -> DataFrame:
    """Per moment (a small table of name and instant): counts and extremes before it and from it on."""
    late = F.col(ts) >= F.col("instant")
    return df.select(ts, value).crossJoin(F.broadcast(moments)).groupBy("name").agg(
        F.count_if(~late).alias("n_before"),
        F.count_if(late).alias("n_after"),
        F.min(F.when(late, F.col(value))).alias("min_after"),
        F.max(F.when(late, F.col(value))).alias("max_after"),
    )


def descriptive(df: DataFrame, columns: list[str], reach: float = 0.002) -> DataFrame:
    """count, min, median, mean, max and sample deviation of each column, one row each.

    Approximate quantiles `reach` beside the middle bracket each median; only the values in between are put in order,
    and how many lie below is counted. A bracket that misses is widened, so medians are exact.
    """
    rows = df.select(*columns).unpivot([], columns, "variable", "x").where("x IS NOT NULL")
    while True:
        sides = [max(0.0, 0.5 - reach), min(1.0, 0.5 + reach)]
        low, high = (F.lit(None).cast(rows.schema["x"].dataType) if reach > 0.5 else F.col("__c")[i] for i in (0, 1))
        cuts = F.broadcast(rows.groupBy("variable").agg(F.percentile_approx("x", sides, 2000).alias("__c")).select("variable", low.alias("__low"), high.alias("__high")))
        below, above = F.coalesce(F.col("x") < F.col("__low"), F.lit(False)), F.coalesce(F.col("x") > F.col("__high"), F.lit(False))
        met = rows.join(cuts, "variable")
        known = met.groupBy("variable").agg(
            F.count("x").alias("n"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.stddev_samp("x").alias("sd"), F.count_if(below).alias("below"), F.count_if(above).alias("above"), F.first("__low").alias("low"), F.first("__high").alias("high")
        )
        found = known.collect()
        # both middle places, (n - 1) // 2 and n // 2, lie in the bracket
        if all(r["below"] <= (r["n"] - 1) // 2 and r["n"] // 2 < r["n"] - r["above"] for r in found):
            break
        reach *= 16
    known = df.sparkSession.createDataFrame(found, known.schema)
    inside = rows.join(F.broadcast(known.select("variable", "n", "below", "low", "high")), "variable").where("coalesce(x >= low, true) AND coalesce(x <= high, true)")
    counts = inside.groupBy("variable", "n", "below", "x").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.col("below") + F.sum("__n").over(Window.partitionBy("variable").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda place: F.max(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place), F.col("x").cast("double")))
    middle = counts.withColumn("__upto", upto).groupBy("variable").agg((at(F.floor((F.col("n") - 1) / 2)) * 0.5 + at(F.floor(F.col("n") / 2)) * 0.5).alias("median"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    out = names.join(known, "variable", "left").join(middle, "variable", "left")
    return out.select("variable", F.coalesce("n", F.lit(0)).alias("n"), "min", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), "max", F.round("sd", 6).alias("sd"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n commonest values; ties to the smaller value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)


def last_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last whole row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def at_peak(df: DataFrame, keys: list[str], size: Column, then: Column, columns: list[str]) -> DataFrame:
    """All columns from the one row where `size` is largest; ties to the smallest `then`."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(size, then)).alias("__p")).select(*keys, *(F.col(f"__p.{c}").alias(f"peak_{c}") for c in columns))


def shares_of_total(df: DataFrame, by: str, amount: Column) -> DataFrame:
    """Rows and sums by bucket, and each bucket's share of all rows and sums (few buckets)."""
    w = Window.partitionBy(F.lit(1))
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    return out.select(by, "n", "total", F.round(F.col("n") / F.sum("n").over(w), 6).alias("n_share"), F.round(F.col("total") / F.sum("total").over(w), 6).alias("total_share"))


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key, for each named place (from 0, told from `__all`, the count of the key's values), the value there in order; and `__all`.

    Values are counted first, then summed in bins, so no task holds all of a key's values; nulls don't count.
    """
    from aerolith.operators.windows import cumulated

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = cumulated(counts, keys, value)
    found = []
    for name, at in places.items():
        found.append(F.max(F.when((F.col("__upto") > at) & (F.col("__upto") - F.col("__n") <= at), F.col(value))).alias(name))
    return rows.groupBy(*keys).agg(*found, F.max("__all").alias("__all"))


def order_statistics(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per key, for each named q, the order statistic nearest to it: the one at round(q * (n - 1)), halves up."""
    return at_places(df, keys, value, {name: F.floor(q * (F.col("__all") - 1) + 0.5) for name, q in quantiles.items()}).drop("__all")


def linear_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Per key the quantile as `F.percentile` finds it, linear between two places, of keys too long for one task."""
    place = q * (F.col("__all") - 1)
    low, high = F.col("__low").cast("double"), F.col("__high").cast("double")
    between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    found = at_places(df, keys, value, {"__low": F.floor(place), "__high": F.ceil(place)})
    return found.select(*keys, F.when(low == high, low).otherwise(between).alias(name))


def nearest_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Per key the order statistic nearest to q."""
    return order_statistics(df, keys, value, {name: q})
