"""Jobs over a store of observations. Loops over measures, folds or horizons are columns of one plan, not driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.flags import usable
from aerolith.operators import aggregate, joins, qc, scores, windows
from aerolith.sources import archives, stores


def clean(observations: DataFrame, sentinels: dict, rain: list[str], bounds: dict) -> DataFrame:
    """Duplicate members collapsed, then sentinels, no-rain zeros and ranges; the order matters, as ranges judge what is left valid."""
    rows = qc.collapse_duplicates(observations, ["station", "item", "ts"], [F.col("member")])
    rows = qc.sentinels(rows, "item", "value", "flag", sentinels)
    rows = qc.no_rain_is_zero(rows, "item", "value", "flag", rain)
    return qc.ranges(rows, "item", "value", "flag", bounds)


def build(spark: SparkSession, archive_path: str, store: str, flags: list[str], sentinels: dict, rain: list[str], bounds: dict) -> DataFrame:
    """Archives to the store, refusing keys whose members disagree; returns a summary of each year."""
    cells = archives.cells_to_observations(archives.read_archives(spark, archive_path))
    conflicts = qc.duplicate_conflicts(cells, ["station", "item", "ts"], ["value", "flag"]).limit(5).collect()
    if conflicts:
        raise ValueError(f"members disagree, for example {conflicts[0].asDict()}")
    stores.write_observations(clean(cells, sentinels, rain, bounds), store, flags)
    kept = stores.scan_observations(spark, store)
    return aggregate.partition_summary(kept, F.col("year"), "station", "item", F.col("flag") == "valid")


def aggregates(observations: DataFrame, circular_items: list[str], least_hours: int = 16, least_days: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Daily and monthly tables of every station and item, one plan for all items."""
    days = aggregate.daily(observations, ["station", "item"], "ts", "value", usable(F.col("value"), F.col("flag")), F.col("item").isin(*circular_items), least=least_hours)
    return days, aggregate.monthly(days, ["station", "item"], least_days)


# What can be said of a run of excursions, and why, by the rule that decides; rules are asked in this order.
VERDICTS = {
    "unplaced": ("uncheckable", "no_coordinates"),
    "high_without_support": ("uncheckable", "too_few_scoreable_neighbours"),
    "low_without_support": ("uncheckable", "no_scoreable_neighbour"),
    "shared": ("regional_episode", "synchronous_rise"),
    "cut": ("uncheckable", "duration_censored"),
    "brief": ("uncorroborated_short_rise", "short_and_alone"),
    "lasting": ("uncorroborated_sustained_rise", "sustained_and_alone"),
}


def verdict(placed: Column, scoreable: Column, elevated: Column, direction: Column, length: Column, censored: Column, stations: int = 4, longest: int = 2, least: int = 1) -> Column:
    """struct(verdict, reason) of a run, by the first rule of VERDICTS that holds.

    An episode takes `stations` at once, the run's own among them, so a high run is only open to
    judgement if one less could have joined; a low run is never an episode and asks for one neighbour. An
    episode stands whatever the run's length, and so comes before the rules on length, which a
    censored run is not open to.
    """
    up = direction > 0
    holds = {
        "shared": up & (elevated + 1 >= stations),
        "unplaced": ~placed,
        "cut": censored,
        "brief": (length <= longest) & (elevated < least),
        "low_without_support": ~up & (scoreable == 0),
        "high_without_support": up & (scoreable + 1 < stations),
    }
    *asked, last = VERDICTS
    rule = qc.cascade([(holds[name], name) for name in asked], last)
    told = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("verdict"), F.lit(x[1]).alias("reason")) for pair in VERDICTS.items() for x in pair))
    return F.element_at(told, rule)


def judged(runs: DataFrame, points: DataFrame, station: str, stations: int = 4, longest: int = 2, least: int = 1) -> DataFrame:
    """Corroborated runs with verdict and reason; points: the stations that have coordinates.

    Counts of neighbours are null for a station without coordinates (nothing could be measured) and
    0 for one that has nobody near.
    """
    placed = points.select(station).distinct().withColumn("has_coordinates", F.lit(True))
    rows = runs.join(placed, station, "left").withColumn("has_coordinates", F.coalesce("has_coordinates", F.lit(False)))
    counts = {c: F.when(F.col("has_coordinates"), F.coalesce(c, F.lit(0))) for c in ("placed", "scoreable", "elevated")}
    rows = rows.withColumns(counts)
    said = verdict(F.col("has_coordinates"), F.col("scoreable"), F.col("elevated"), F.col("direction"), F.col("length"), F.col("censored"), stations, longest, least)
    return rows.withColumn("__v", said).select("*", "__v.verdict", "__v.reason").drop("__v")


def excursions(observations: DataFrame, edges: DataFrame, points: DataFrame, entity: list[str], station: str, cell: list[str], lag: int = 1, shifts: tuple[int, ...] = (-28, -14, 14, 28), **bars) -> DataFrame:
    """Runs of excursions with boundaries, neighbours' corroboration and a verdict.

    observations have value and boolean usable and rejected; unusable rows are never scored but
    tell why a run ends. entity identifies a series and holds the station; bars go to the verdict.
    """
    scored = windows.robust_scores(observations.where("usable"), cell, "value")
    runs = windows.boundaries(windows.excursion_runs(scored, entity, "ts"), scored, entity, "ts", observations)
    return judged(joins.corroborate(runs, edges, scored, station, "ts", lag, list(shifts)), points, station, **bars)


def backtest(hourly: DataFrame, entity: list[str], horizons: list[int], cuts: DataFrame, exceeds: float) -> DataFrame:
    """Metrics of persistence and climatology per fold and horizon on the same test rows, and persistence's skill."""
    grid = windows.hourly_grid(hourly, entity, "ts")
    h = F.explode(F.array(*map(F.lit, horizons)))
    ahead = grid.withColumn("h", h).select(*entity, (F.col("ts") - F.make_dt_interval(F.lit(0), "h")).alias("ts"), F.col("ts").alias("at"), F.col("value").alias("truth"), "h")
    pairs = scores.time_folds(ahead.join(grid, [*entity, "ts"]).where("truth is not null"), "at", cuts)
    cell = [*entity, "fold", "h", "__hour"]
    rows = pairs.withColumn("__hour", F.hour("at"))
    means = rows.where("role = 'train'").groupBy(*cell).agg(F.avg("truth").alias("mean"))
    test = rows.where("role = 'test'").join(means, cell, "left")
    long = test.select("fold", "h", "truth", F.explode(F.array(F.struct(F.lit("persistence").alias("model"), F.col("value").alias("predicted")), F.struct(F.lit("climatology").alias("model"), F.col("mean").alias("predicted")))).alias("m")).select("fold", "h", "truth", "m.*")
    return scores.metrics(long, ["fold", "h", "model"], "truth", "predicted", exceeds)
