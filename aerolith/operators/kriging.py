"""Held-out interpolation: every point predicted from points beyond a buffer, by nearest, inverse distances, mean and ordinary kriging.

Radius 0 is plain leave-one-out; wider buffers ask what an empty stretch of map would ask. Points
meet place by place (`joins.place_pairs`), so work grows with places times neighbouring places, and
points of one place are predicted once. The variogram is fitted inside each fold on its own training points: one fitted on all
would have seen the point it is judged by. A fold that can't be predicted stays, with the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.maths import EARTH_KM
from aerolith.operators import joins
from aerolith.session import cut

# Variogram shapes of distance over range, from 0 at 0 to 1 (the hole effect overshoots); a range is where about 95% is reached.
SHAPES = {
    "spherical": lambda u: np.where(u < 1, 1.5 * u - 0.5 * u**3, 1.0),
    "exponential": lambda u: 1 - np.exp(-3 * u),
    "gaussian": lambda u: 1 - np.exp(-3 * u * u),
    "hole-effect": lambda u: 1 - (1 - 3 * u) * np.exp(-3 * u),
}


def training_rows(values: DataFrame, by: list[str], key: str, value: str, buffers: list[float], search_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """by, key, buffer_km, neighbour, km, __lat, __lon, __z: what a fold (a point of a field and a buffer) may learn from.

    values hold one row for each point of a field (`by`, a month say), which may stand elsewhere in another; nulls are not observed.
    """
    known = values.where(F.col(value).isNotNull()).withColumn("__spot", F.struct(F.col(key).alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")))
    spots = known.select("__spot", "__spot.lat", "__spot.lon").distinct()
    edges = joins.neighbour_edges(spots, "__spot", "lat", "lon", search_km).where(F.col("__spot.k") != F.col("neighbour.k"))
    other = known.select(*by, F.col("__spot").alias("neighbour"), F.col(value).cast("double").alias("__z"))
    met = edges.join(other, "neighbour").join(known.select(*by, "__spot"), [*by, "__spot"])
    met = met.select(*by, F.col("__spot.k").alias(key), F.col("neighbour.k").alias("neighbour"), "km", F.col("neighbour.lat").alias("__lat"), F.col("neighbour.lon").alias("__lon"), "__z")
    beyond = F.filter(F.array(*(F.lit(float(b)) for b in buffers)), lambda b: F.col("km") > b)
    return met.withColumn("buffer_km", F.explode(beyond))


def _known(values: DataFrame, by: list[str], key: str, value: str, buffers: list[float], lat: str, lon: str) -> DataFrame:
    """Observed points: by, __k, __lat, __lon, __z. A buffer reaches at least the fold's own place, so all points of a place learn from the same rows."""
    if min(buffers) < 0:
        raise ValueError("a buffer is at least 0 km")
    return values.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("__k"), F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon"), F.col(value).cast("double").alias("__z"))


def interpolate_held_out(values: DataFrame, by: list[str], key: str, value: str, buffers: list[float], search_km: float, least: int = 8) -> DataFrame:
    """by, key, buffer_km, observed, n_train, method, predicted, failed: nearest (ties to the smaller key), idw2 (under 0.1 km counts as that) and mean of each fold; `too_few` under `least` training points.

    Folds are told place by place, from sums over the places within search_km: points of one place share theirs.
    """
    fold, spot = [*by, key, "buffer_km"], [*by, "__lat", "__lon"]
    known = _known(values, by, key, value, buffers, "lat", "lon")
    at = known.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"), F.sum("__z").alias("s"), F.min(F.struct("__k", "__z")).alias("first")).withColumnsRenamed({"__lat": "__lat2", "__lon": "__lon2"})
    met = joins.place_pairs(known, "__lat", "__lon", search_km).where(F.col("km") > min(buffers)).join(at, ["__lat2", "__lon2"])
    w = 1 / F.pow(F.greatest(F.col("km"), F.lit(0.1)), 2)
    told = []
    for i, b in enumerate(buffers):
        of = lambda f, c, b=b: f(F.when(F.col("km") > float(b), c))
        told += [of(F.sum, F.col("n")).alias(f"n{i}"), of(F.sum, F.col("s")).alias(f"s{i}"), of(F.sum, w * F.col("s")).alias(f"ws{i}"), of(F.sum, w * F.col("n")).alias(f"wn{i}"), of(F.min, F.struct("km", "first")).alias(f"near{i}")]
    cells = [F.struct(F.lit(float(b)).alias("buffer_km"), F.col(f"n{i}").alias("n_train"), F.col(f"near{i}.first.__z").alias("nearest"), (F.col(f"ws{i}") / F.col(f"wn{i}")).alias("idw2"), (F.col(f"s{i}") / F.col(f"n{i}")).alias("mean")) for i, b in enumerate(buffers)]
    told = met.groupBy(*spot).agg(*told).select(*spot, F.explode(F.array(*cells)).alias("c")).select(*spot, "c.*")
    folds = known.select(*by, F.col("__k").alias(key), "__lat", "__lon", F.col("__z").alias("observed"), F.explode(F.array(*(F.lit(float(b)) for b in buffers))).alias("buffer_km"))
    rows = folds.join(told, [*spot, "buffer_km"], "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))
    method = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("predicted")) for m in ("nearest", "idw2", "mean"))))
    few = F.col("n_train") < least
    return rows.withColumn("m", method).select(*fold, "observed", "n_train", "m.method", F.when(~few, F.col("m.predicted")).alias("predicted"), F.when(few, "too_few").alias("failed"))


def kilometres(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


def fit_variogram(apart: np.ndarray, half_squares: np.ndarray, shape, lags: int = 8, ranges: int = 40) -> tuple[float, float, float]:
    """(nugget, sill, range) nearest to the semivariances in `lags` classes of distance, by counts; neither nugget nor sill below 0.

    For one range the rest is linear with two unknowns, so ranges are tried on a geometric scale.
    """
    bin_of = np.minimum((apart / (apart.max() or 1.0) * lags).astype(int), lags - 1)
    n = np.bincount(bin_of, minlength=lags)
    h, g = (np.bincount(bin_of, x, minlength=lags)[n > 0] / n[n > 0] for x in (apart, half_squares))
    n = n[n > 0].astype(float)
    best = (np.inf, 0.0, 0.0, 1.0)
    for reach in np.geomspace(max(h[h > 0].min(initial=apart.max() or 1.0), 1e-9) / 2, 3 * (apart.max() or 1.0), ranges):
        f = shape(h / reach)
        a, b, c, d, e = n.sum(), n @ f, n @ (f * f), n @ g, n @ (f * g)
        det = a * c - b * b
        tried = [(d / a, 0.0), (0.0, max(e / c, 0.0) if c else 0.0)]
        if det > 1e-12 * a * c:
            tried.append(((d * c - e * b) / det, (e * a - d * b) / det))
        for nugget, sill in tried:
            if nugget >= 0 and sill >= 0:
                miss = float(n @ (g - nugget - sill * f) ** 2)
                if miss < best[0] - 1e-12:
                    best = (miss, float(nugget), float(sill), float(reach))
    return best[1:]


def krige(lat: np.ndarray, lon: np.ndarray, z: np.ndarray, to_lat: float, to_lon: float, shape) -> tuple[float | None, float | None, str | None]:
    """(predicted, sd, failed) of one point by ordinary kriging from training points; `singular` where the system has no answer."""
    if len(z) and z.min() == z.max():
        return float(z[0]), 0.0, None
    apart = kilometres(lat[:, None], lon[:, None], lat, lon)
    i, j = np.triu_indices(len(z), 1)
    nugget, sill, reach = fit_variogram(apart[i, j], (z[i] - z[j]) ** 2 / 2, shape)
    gamma = lambda h: np.where(h > 0, nugget + sill * shape(h / reach), 0.0)
    n = len(z)
    system = np.ones((n + 1, n + 1))
    system[:n, :n], system[n, n] = gamma(apart), 0.0
    right = np.append(gamma(kilometres(lat, lon, to_lat, to_lon)), 1.0)
    try:
        weights = np.linalg.solve(system, right)
    except np.linalg.LinAlgError:
        return None, None, "singular"
    predicted, variance = float(weights[:n] @ z), float(weights @ right)
    if not np.isfinite(predicted) or np.abs(system @ weights - right).max() > 1e-6 * max(1.0, np.abs(right).max()):
        return None, None, "singular"
    return predicted, float(np.sqrt(max(variance, 0.0))), None


def krige_held_out(values: DataFrame, by: list[str], key: str, value: str, buffers: list[float], search_km: float, families: list[str], neighbours: int = 32, least: int = 8, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """As `interpolate_held_out`, with sd: ordinary kriging from the `neighbours` nearest training points (a moving neighbourhood), one row for each family of variograms."""
    spot = [*by, "__lat", "__lon"]
    known = _known(values, by, key, value, buffers, lat, lon)
    # a place's first `neighbours` points by key, and the nearest so many places: what lies beyond can't be among the nearest points
    first = known.withColumn("__i", F.row_number().over(Window.partitionBy(*spot).orderBy("__k"))).where(F.col("__i") <= neighbours)
    first = first.groupBy(*spot).agg(F.sort_array(F.collect_list(F.struct("__k", "__z"))).alias("points")).withColumnsRenamed({"__lat": "__lat2", "__lon": "__lon2"})
    beyond = F.filter(F.array(*(F.lit(float(b)) for b in buffers)), lambda b: F.col("km") > b)
    met = joins.place_pairs(known, "__lat", "__lon", search_km).join(first.select(*by, "__lat2", "__lon2", F.col("points")[0]["__k"].alias("least")), ["__lat2", "__lon2"]).withColumn("buffer_km", F.explode(beyond))
    ranked = lambda df, tie: df.withColumn("__r", F.row_number().over(Window.partitionBy(*spot, "buffer_km").orderBy("km", tie))).where(F.col("__r") <= neighbours)
    met = ranked(met, "least").drop("__r").join(first, [*by, "__lat2", "__lon2"]).withColumn("p", F.explode("points"))
    met = ranked(met.select(*spot, "buffer_km", "km", "__lat2", "__lon2", F.col("p.__k").alias("tie"), F.col("p.__z").alias("__z")), "tie")
    held = cut(met.groupBy(*spot, "buffer_km").agg(F.sort_array(F.collect_list(F.struct("__r", F.col("__lat2").alias("lat"), F.col("__lon2").alias("lon"), F.col("__z").alias("z")))).alias("t")))
    held = held.repartition(1 + held.count() // 128, *spot, "buffer_km").select(*spot, "buffer_km", *(F.col(f"t.{c}").alias(f"__{c}s") for c in ("lat", "lon", "z")))
    types = dict(values.dtypes)
    head = [*spot, "buffer_km"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                z = np.array(r["__zs"], dtype=float)
                for family in families:
                    told = (None, None, "too_few") if len(z) < least else krige(np.array(r["__lats"]), np.array(r["__lons"]), z, r["__lat"], r["__lon"], SHAPES[family])
                    out.append((*(r[c] for c in head), len(z), f"kriging_{family}", *told))
            yield pd.DataFrame(out, columns=[*head, "n_train", "method", "predicted", "sd", "failed"])

    told = held.mapInPandas(run, "".join(f"{c} {types[c]}, " for c in by) + "__lat double, __lon double, buffer_km double, n_train long, method string, predicted double, sd double, failed string")
    each = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("b"), F.lit(f"kriging_{f}").alias("f")) for b in buffers for f in families)))
    folds = known.select(*by, F.col("__k").alias(key), "__lat", "__lon", F.col("__z").alias("observed"), each.alias("c")).withColumn("buffer_km", F.col("c.b")).withColumn("method", F.col("c.f"))
    rows = folds.join(told, [*spot, "buffer_km", "method"], "left")
    failed = F.when(F.col("n_train").isNull(), "too_few").otherwise(F.col("failed"))
    return rows.select(*by, key, "observed", "buffer_km", F.coalesce("n_train", F.lit(0)).cast("long").alias("n_train"), "method", "predicted", "sd", failed.alias("failed"))


def fold_errors(folds: DataFrame) -> DataFrame:
    """Per buffer and method: folds, failed ones, MAE and RMSE of the others."""
    e = F.col("predicted") - F.col("observed")
    return folds.groupBy("buffer_km", "method").agg(F.count(F.lit(1)).alias("folds"), F.count("failed").alias("failed"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))
