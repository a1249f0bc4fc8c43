"""Statistics by sums over places against the same over given edges, and on towns whose edges could not be made."""

import random

from aerolith.operators import joins, networks, stats


def _town(spark):
    r = random.Random(4)
    spots = [(23.0 + r.random() * 3, 120.0 + r.random() * 2) for _ in range(25)] + [(10.0, 50.0), (-40.0, 179.99), (-40.0, -179.99)]
    rows = [(i, *spots[i % 28 if i < 50 else r.randrange(25)], None if i % 11 == 5 else r.gauss(5, 2)) for i in range(90)] + [(90, None, 121.0, 3.0), (91, float("nan"), 121.0, 4.0)]
    return spark.createDataFrame(rows, "k long, lat double, lon double, v double")


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def _same(a, b):
    a, b = _rows(a), _rows(b)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or abs(p - q) < 2e-6


def test_sums_over_places_equal_sums_over_edges(spark):
    df = _town(spark).cache()
    v, edges = df.select("k", "v"), joins.neighbour_edges(df, "k", "lat", "lon", 80.0).cache()
    even = stats.row_standardised(edges, "k")
    _same(networks.morans_i(df, "k", "v", 80.0), stats.morans_i(v, even, [], "k", "neighbour", "v"))
    _same(networks.local_moran(df, "k", "v", 80.0), stats.local_moran(v, even, "k", "neighbour", "v"))
    _same(networks.correlogram(df, "k", "v", 80.0, [10.0, 50.0]), stats.correlogram(v, edges, "k", "neighbour", "v", [10.0, 50.0]))
    _same(networks.idw_leave_one_out(df, "k", "v", 80.0), stats.idw_leave_one_out(v, edges, "k", "neighbour", "v"))
    _same(networks.weights_sensitivity(df, "k", "v", [30.0, 80.0]), stats.weights_sensitivity(v, edges, "k", "neighbour", "v", [30.0, 80.0]))
    _same(networks.moran_null(df, "k", "v", 80.0, draws=12), stats.moran_null(v, even, "k", "neighbour", "v", draws=12))


def test_many_points_of_one_place_make_no_edges(spark):
    """1.6 billion edges: without any of them."""
    df = spark.range(40000).selectExpr("id AS k", "25.0D AS lat", "121.0D AS lon", "CAST(id % 7 AS DOUBLE) AS v")
    n = 40000
    got = networks.morans_i(df, "k", "v", 10.0).collect()[0]
    assert got["n"] == n and abs(got["moran_i"] + 1 / (n - 1)) < 2e-6
    assert {r["neighbours"] for r in networks.idw_leave_one_out(df, "k", "v", 10.0).select("neighbours").distinct().collect()} == {n - 1}


def test_residuals_over_places_equal_those_over_edges(spark):
    from pyspark.sql import functions as F

    from aerolith.operators import residuals

    df = _town(spark).where("NOT isnan(lat)").withColumn("x", F.col("k") % 5).withColumn("g", F.col("k") % 2).cache()
    edges = joins.neighbour_edges(df, "k", "lat", "lon", 80.0).cache()
    _same(residuals.residual_moran_within(df, ["g"], "k", "v", ["x"], 80.0, draws=12), residuals.residual_moran(df, ["g"], "k", "v", ["x"], edges, draws=12))


def test_folds_are_told_by_place(spark):
    """20,000 points at 8 places 11 km apart: 350 million training rows are never made."""
    from aerolith.operators import kriging

    df = spark.range(20000).selectExpr("id AS k", "25.0D + (id % 8) / 10.0D AS lat", "121.0D AS lon", "CAST(id % 8 AS DOUBLE) AS v")
    got = {tuple(r) for r in kriging.interpolate_held_out(df, [], "k", "v", [0.0, 15.0], 30.0).where("k % 8 = 0 AND method = 'mean'").select("buffer_km", "n_train", "predicted").distinct().collect()}
    assert got == {(0.0, 5000, 1.5), (15.0, 2500, 2.0)}
