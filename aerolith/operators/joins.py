"""Joins beyond the built-in forms: nearest, within a radius, shifted in time, checked, reconciling, upserts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import EARTH_KM, haversine_km
from aerolith.session import cut

KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180


#: Grids for the nearest: level l cuts the globe's 360 degrees into 2 ** l; the finest cells are about 1.2 km high.
LEVELS = 16
#: Points of a cell that are met without looking into its quarters.
FEW = 64
#: Points of a place that meet others as one row, and pairs of points that one salt of a cell makes.
CHUNK, UNIT = 512, 1_000_000


def _reach(lat: Column, km: Column) -> Column:
    """Degrees of longitude that a circle of km around a point at lat spans to either side; 180 where it holds a pole."""
    r = km / EARTH_KM
    s = F.sin(r) / F.cos(F.radians(lat))
    return F.when((F.abs(lat) + F.degrees(r) >= 90 - 1e-9) | (s >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(s)) + 1e-9)


def _row(lat: Column, step) -> Column:
    return F.floor((lat + 90) / step).cast("long")


def _column(lon: Column, n) -> Column:
    return F.pmod(F.floor((lon + 180) * n / 360.0).cast("long"), F.lit(n).cast("long") if isinstance(n, int) else n)


def _columns(lon: Column, reach: Column, n) -> Column:
    """Columns of n around the globe that lon - reach to lon + reach touches, each once."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    a, b = F.floor((lon - reach + 180) * n / 360.0).cast("long"), F.floor((lon + reach + 180) * n / 360.0).cast("long")
    return F.array_distinct(F.transform(F.sequence(a, F.least(b, a + n - 1)), lambda k: F.pmod(k, n)))


def _points(df: DataFrame, columns: tuple[str, str, str], prefix: str) -> DataFrame:
    """(key, lat, lon) of the rows whose coordinates are numbers, under names of the prefix."""
    key, lat, lon = columns
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (lat, lon)]
    return df.where(known[0] & known[1]).select(F.col(key).alias(f"{prefix}k"), F.col(lat).cast("double").alias(f"{prefix}lat"), F.col(lon).cast("double").alias(f"{prefix}lon"))


def _chunked(points: DataFrame, prefix: str) -> DataFrame:
    """One row for up to about CHUNK points of a place: its coordinates, how many they are (n) and their keys."""
    lat, lon = f"{prefix}lat", f"{prefix}lon"
    held = points.groupBy(lat, lon).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("chunks"))
    dealt = points.join(held, [lat, lon]).withColumn("chunk", F.pmod(F.xxhash64(F.struct(f"{prefix}k")), F.col("chunks")))
    return dealt.groupBy(lat, lon, "chunk").agg(F.count(F.lit(1)).alias(f"{prefix}n"), F.collect_list(F.struct(f"{prefix}k")).alias(f"{prefix}ks")).drop("chunk")


def _met(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Rows of left (alat, alon, an points) beside those of right (blat, blon, bn) at most km apart, with km.

    A grid has rows of km height and columns as wide at the equator: a left row visits the cells
    that its circle touches (more columns towards the poles, around the date line too), so this is an
    equi-join on cells. Cells of much work (points times points) are dealt among salts, and the
    number of tasks follows from the work, not from the tables' bytes.
    """
    step = max(km / KM_PER_DEGREE, 1e-6)
    n = max(1, int(360 / step))
    cells = ["row", "column"]
    left = left.withColumn("row", F.explode(F.sequence(_row(F.col("alat"), step) - 1, _row(F.col("alat"), step) + 1)))
    left = left.withColumn("column", F.explode(_columns(F.col("alon"), _reach(F.col("alat"), F.lit(float(km))), n)))
    right = right.withColumn("row", _row(F.col("blat"), step)).withColumn("column", _column(F.col("blon"), n))
    work = left.groupBy(*cells).agg(F.sum("an").alias("a")).join(right.groupBy(*cells).agg(F.sum("bn").alias("b")), cells)
    work = cut(work.select(*cells, (F.col("a").cast("double") * F.col("b")).alias("pairs")))
    tasks = int(min(4096, max(1, math.ceil((work.agg(F.sum("pairs")).first()[0] or 0.0) / (2 * UNIT)))))
    salts = F.least(F.lit(1024), F.ceil(F.col("pairs") / UNIT)).cast("int")
    left = left.join(work, cells).withColumn("salt", F.pmod(F.xxhash64("alat", "alon", *(c for c in left.columns if c == "aks")), salts)).drop("pairs")
    right = right.join(work, cells).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop("pairs")
    d = haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    met = left.repartition(tasks, *cells, "salt").join(right, [*cells, "salt"])
    return met.withColumn("km", d).where(F.col("km") <= km).drop(*cells, "salt")


def within_radius(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str], km: float, digits: int | None = None) -> DataFrame:
    """(a's key, b's key, km apart, rounded to digits if given) for points at most km apart.

    Places meet, in chunks of their points, and are measured once; the points' pairs come last.
    Points without coordinates are near nothing.
    """
    met = _met(cut(_chunked(_points(a, a_cols, "a"), "a")), cut(_chunked(_points(b, b_cols, "b"), "b")), km)
    apart = F.col("km") if digits is None else F.round("km", digits)
    met = met.select("aks", "bks", apart.alias("km")).select(F.explode("aks").alias("a"), "bks", "km").select("a", F.explode("bks").alias("b"), "km")
    return met.select(F.col("a.ak").alias(a_cols[0]), F.col("b.bk").alias(b_cols[0]), "km")


def neighbour_edges(points: DataFrame, key: str, lat: str, lon: str, km: float, digits: int | None = None) -> DataFrame:
    """Directed edges between different points at most km apart."""
    other = points.select(F.col(key).alias("neighbour"), F.col(lat).alias("__lat2"), F.col(lon).alias("__lon2"))
    return within_radius(points, other, (key, lat, lon), ("neighbour", "__lat2", "__lon2"), km, digits).where(F.col(key) != F.col("neighbour"))


def place_pairs(points: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """(__lat, __lon, __lat2, __lon2, km): directed pairs of the places of points at most km apart, each with itself too; written once.

    As many as the places' neighbourhoods make, however many points stand at each place.
    """
    places = cut(_points(points, (lat, lat, lon), "a").select("alat", "alon", F.lit(1).alias("an")).distinct())
    met = _met(places, places.select(F.col("alat").alias("blat"), F.col("alon").alias("blon"), F.col("an").alias("bn")), km)
    return cut(met.select(F.col("alat").alias("__lat"), F.col("alon").alias("__lon"), F.col("blat").alias("__lat2"), F.col("blon").alias("__lon2"), "km"))


def neighbour_sums(pairs: DataFrame, points: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """points (with __lat, __lon) and, for each column c, near_c: its sum over the other points of the group (`by`) within reach; null for points without a place.

    pairs: `place_pairs`. Sums go from place to place, and a point's own value is taken from its
    place's, so the work is that of the pairs of places and of the points. Null counts as 0.
    """
    spot = [*by, "__lat", "__lon"]
    sums = points.groupBy(*spot).agg(*(F.sum(c).alias(f"near_{c}") for c in columns))
    sums = sums.withColumnsRenamed({"__lat": "__lat2", "__lon": "__lon2"})
    reach = pairs.join(sums, ["__lat2", "__lon2"]).groupBy(*spot).agg(*(F.sum(f"near_{c}").alias(f"near_{c}") for c in columns)).withColumn("__placed", F.lit(True))
    less = lambda c: F.when(F.col("__placed"), F.coalesce(F.col(f"near_{c}"), F.lit(0.0)) - F.coalesce(F.col(c), F.lit(0.0)))
    return points.join(reach, spot, "left").withColumns({f"near_{c}": less(c) for c in columns}).drop("__placed")


def nearest(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str]) -> DataFrame:
    """For each key of a the nearest point of b, ties to the smaller key; keys without coordinates are left out.

    Grids of LEVELS sizes stand in for a search tree. The finest grid in which a's point shares its
    cell with some point of b bounds the distance, by twice the cell's height; so the nearest lies
    in the cells around the point's own in the grid of twice that height. Cells of many points (where
    b lies apart or in towns) are not met whole: their occupied quarters are taken instead, those
    that could still hold the nearest, until what is left is small. All steps are equi-joins on cells. Points
    of b at one place count once, by their smallest key.
    """
    left = _points(a, a_cols, "a").distinct()
    right = _points(b, b_cols, "b").groupBy("blat", "blon").agg(F.min("bk").alias("bk"))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    n, step = F.pow(F.lit(2.0), F.col("level")).cast("long"), F.lit(360.0) / F.pow(F.lit(2.0), F.col("level")).cast("long")
    grids = right.withColumn("level", level).withColumn("row", _row(F.col("blat"), step)).withColumn("column", _column(F.col("blon"), n))
    held = grids.groupBy("level", "row", "column").agg(F.count(F.lit(1)).alias("held"))
    tried = left.withColumn("level", level).withColumn("row", _row(F.col("alat"), step)).withColumn("column", _column(F.col("alon"), n))
    finest = tried.join(held, ["level", "row", "column"], "left_semi").groupBy("ak", "alat", "alon").agg(F.max("level").alias("finest"))
    km = F.lit(2 * 360.0 * KM_PER_DEGREE) / F.pow(F.lit(2.0), F.col("finest"))
    asked = finest.withColumn("level", F.greatest(F.lit(0), F.col("finest") - 1)).withColumn("most", km)
    asked = asked.withColumn("row", F.explode(F.sequence(_row(F.col("alat"), step) - 1, _row(F.col("alat"), step) + 1)))
    asked = asked.withColumn("column", F.explode(_columns(F.col("alon"), _reach(F.col("alat"), F.least(F.col("most"), F.lit(EARTH_KM * 1.5))), n)))
    asked = asked.select("ak", "alat", "alon", "most", "level", "row", "column").join(held, ["level", "row", "column"])
    small = (F.col("held") <= FEW) | (F.col("level") == LEVELS - 1)
    asked = cut(asked)
    found = asked.where(small)
    while asked.where(~small).limit(1).count():
        # a cell's points lie within half its diagonal of its middle, so the nearest of them is known to within that
        quarters = asked.where(~small).select("ak", "alat", "alon", "most", (F.col("level") + 1).alias("level"), F.explode(F.array(*(F.struct((2 * F.col("row") + i).alias("row"), (2 * F.col("column") + j).alias("column")) for i in (0, 1) for j in (0, 1)))).alias("c"))
        quarters = quarters.select("ak", "alat", "alon", "most", "level", "c.*").join(held, ["level", "row", "column"])
        half = step * (KM_PER_DEGREE * 0.7072)
        middle = haversine_km(F.col("alat"), F.col("alon"), F.least(F.lit(90.0), (F.col("row") + 0.5) * step - 90), (F.col("column") + 0.5) * step - 180)
        quarters = quarters.withColumn("middle", middle).withColumn("half", half)
        most = quarters.groupBy("ak").agg(F.min(F.col("middle") + F.col("half")).alias("upper"))
        quarters = quarters.join(most, "ak").withColumn("most", F.least("most", F.col("upper") + 1e-6)).where(F.col("middle") - F.col("half") <= F.col("most"))
        asked = cut(quarters.select(*asked.columns))
        found = found.unionByName(asked.where(small))
    d = haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    met = found.join(grids, ["level", "row", "column"]).groupBy("ak").agg(F.min(F.struct(d.alias("km"), F.col("bk").alias("k"))).alias("m"))
    return met.select(F.col("ak").alias(a_cols[0]), F.col("m.k").alias(b_cols[0]), F.col("m.km").alias("km"))


def radius_cohorts(distances: DataFrame, key: str, km: str, radii: list[float]) -> DataFrame:
    """For nested radii: how many keys lie within each; one pass, a column for each radius."""
    aggs = [F.count_distinct(F.when(F.col(km) <= r, F.col(key))).alias(f"r{i}") for i, r in enumerate(radii)]
    rows = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.col(f"r{i}").alias("members")) for i, r in enumerate(radii))))
    return distances.agg(*aggs).select(rows.alias("r")).select("r.*")


def checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A many-to-one join that fails, while it runs, if a key occurs twice on the right."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    one = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("the right side of a many-to-one join repeats a key")).cast("boolean"))
    return left.join(right.withColumn("__n", n).where(one).drop("__n"), on, how)


def shifted(left: DataFrame, right: DataFrame, on: list[str], ts: str, hours: int, columns: list[str], how: str = "left") -> DataFrame:
    """Columns of the row of `right` that lies `hours` later (earlier if negative), by an equi-join on the shifted time."""
    moved = right.select(*on, (F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(hours))).alias(ts), *(F.col(c).alias(f"{c}_{'p' if hours >= 0 else 'm'}{abs(hours)}") for c in columns))
    return left.join(moved, [*on, ts], how)


def corroborate(runs: DataFrame, edges: DataFrame, scored: DataFrame, entity: str, ts: str, lag: int, shifts: list[int]) -> DataFrame:
    """Per run: neighbours placed, scoreable and elevated in its direction within `lag` hours, and the mean number elevated at shifted calendars.

    Shifts are rows of one join, not a loop: a run's hours are exploded once and met by time.
    """
    hours = F.sequence(F.col("start") - F.make_dt_interval(F.lit(0), F.lit(lag)), F.col("end") + F.make_dt_interval(F.lit(0), F.lit(lag)), F.expr("interval 1 hour"))
    opened = runs.select(entity, "start", "direction", F.explode(hours).alias("__h"))
    opened = opened.withColumn("shift", F.explode(F.array(*(F.lit(d) for d in [0, *shifts])))).withColumn("__h", F.col("__h") + F.make_dt_interval(F.col("shift")))
    seen = scored.where("z is not null").select(F.col(entity).alias("neighbour"), F.col(ts).alias("__h"), "excursion", F.col("direction").alias("__d"))
    met = opened.join(edges.select(entity, "neighbour"), entity).join(seen, ["neighbour", "__h"])
    raised = F.col("excursion") & (F.col("__d") == F.col("direction"))
    per = met.groupBy(entity, "start", "shift").agg(F.count_distinct("neighbour").alias("scoreable"), F.count_distinct(F.when(raised, F.col("neighbour"))).alias("elevated"))
    now = F.col("shift") == 0
    found = per.groupBy(entity, "start").agg(F.coalesce(F.max(F.when(now, F.col("scoreable"))), F.lit(0)).alias("scoreable"), F.coalesce(F.max(F.when(now, F.col("elevated"))), F.lit(0)).alias("elevated"), F.avg(F.when(~now, F.col("elevated"))).alias("elevated_shifted"))
    placed = edges.groupBy(entity).agg(F.count_distinct("neighbour").alias("placed"))
    return runs.join(placed, entity, "left").join(found, [entity, "start"], "left")


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of either side and where it occurs: both, left_only or right_only."""
    left, right = a.select(key).distinct().withColumn("__l", F.lit(True)), b.select(key).distinct().withColumn("__r", F.lit(True))
    where = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return left.join(right, key, "full").select(key, where.alias("presence"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only a, and only b has, repeats counted."""
    only_a = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    return only_a.crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right")))
