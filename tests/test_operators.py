"""Operators on small hand-built frames: boundaries, refusals, ties, leaks, injected signals."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from aerolith.functions import domain, maths
from aerolith.functions.flags import parse_cell
from aerolith.operators import aggregate, gapfill, joins, panels, qc, scores, stats, windows

T0 = dt.datetime(2015, 1, 1)


def hour(k):
    return T0 + dt.timedelta(hours=k)


def series(spark, values, entity="a"):
    return spark.createDataFrame([(entity, hour(k), v) for k, v in values], "entity string, ts timestamp_ntz, value double")


@pytest.mark.parametrize(
    "raw,want",
    [("12.3", (12.3, "valid", False)), ("15#", (15.0, "instrument_check_invalid", True)), ("#", (None, "instrument_check_invalid", False)), ("NR", (None, "no_rain", False)), (".33", (0.33, "valid", False)), ("", (None, "missing", False)), (None, (None, "missing", False)), ("7?", (None, "unparseable", False)), ("abc", (None, "unparseable", False)), ("NA#", (None, "instrument_check_invalid", False)), ("*nr", (None, "program_check_invalid", False)), ("--", (None, "missing", False)), ("N/A", (None, "not_applicable", False)), ("A", (None, "rain_present", False)), (" -3 x", (-3.0, "manual_check_invalid", True))],
)
def test_parse_cell(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(parse_cell("raw").alias("c")).first()["c"]
    assert tuple(got) == want


def test_mean_is_withheld_under_the_threshold(spark):
    df = series(spark, [(k, float(k)) for k in range(15)]).unionByName(series(spark, [(k, 1.0) for k in range(16)], "b"))
    got = {r["entity"]: r for r in aggregate.daily(df, ["entity"], "ts", "value").collect()}
    assert got["a"]["mean"] is None and got["a"]["n_valid"] == 15 and not got["a"]["meets_threshold"]
    assert got["b"]["mean"] == 1.0 and got["b"]["meets_threshold"]


def test_circular_mean_around_north(spark):
    df = series(spark, [(k, 350.0 if k % 2 else 10.0) for k in range(24)])
    r = aggregate.daily(df, ["entity"], "ts", "value", circular=F.lit(True)).first()
    assert min(r["mean"], 360 - r["mean"]) < 1e-6 and r["min"] is None and abs(r["consistency"] - math.cos(math.radians(10))) < 1e-9


def test_monthly_needs_three_quarters(spark):
    days = [("a", dt.date(2015, 2, k), 2.0, 24, True, False) for k in range(1, 22)] + [("a", dt.date(2015, 3, k), 2.0, 24, True, False) for k in range(1, 24)]
    df = spark.createDataFrame(days, "entity string, date date, mean double, n_valid long, meets_threshold boolean, is_circular boolean")
    got = {r["month"].month: r for r in aggregate.monthly(df, ["entity"]).collect()}
    assert got[2]["mean"] == 2.0 and got[3]["mean"] is None and got[3]["n_days"] == 23


def test_sentinels_and_ranges_only_touch_valid(spark):
    df = spark.createDataFrame([("WS", 888.0, "valid"), ("WS", 888.0, "manual_check_invalid"), ("WS", 60.0, "valid"), ("X", 888.0, "valid"), ("WS", None, "valid")], "item string, value double, flag string")
    out = qc.ranges(qc.sentinels(df, "item", "value", "flag", {"WS": {888: "calm"}}), "item", "value", "flag", {"WS": (0, 50)}).collect()
    assert [tuple(r) for r in out] == [("WS", None, "calm"), ("WS", 888.0, "manual_check_invalid"), ("WS", 60.0, "out_of_range"), ("X", 888.0, "valid"), ("WS", None, "valid")]


def test_null_counts_as_a_version(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, 3.0), (2, 3.0)], "k int, v double")
    assert [tuple(r) for r in qc.duplicate_conflicts(df, ["k"], ["v"]).collect()] == [(1, 2, 2)]


def test_lags_do_not_leak_between_entities(spark):
    df = series(spark, [(k, float(k)) for k in range(5)]).unionByName(series(spark, [(k, 100.0 + k) for k in range(5)], "b"))
    out = windows.lag_features(df, ["entity"], "ts", "value", [1, 3], [2]).collect()
    for r in out:
        k = int((r["ts"] - T0).total_seconds() // 3600)
        base = 0 if r["entity"] == "a" else 100
        assert r["lag_1"] == base + k and r["lag_3"] == (base + k - 2 if k >= 2 else None)
        assert r["mean_2"] == (base + k - 0.5 if k else None)


def test_rolling_needs_every_value(spark):
    out = windows.lag_features(series(spark, [(0, 1.0), (1, None), (2, 3.0), (3, 5.0)]), ["entity"], "ts", "value", [], [2]).orderBy("ts").collect()
    assert [r["mean_2"] for r in out] == [None, None, None, 4.0]


def test_runs_end_at_gaps(spark):
    df = series(spark, [(0, 5.0), (1, 5.0), (3, 5.0), (4, 5.0), (5, 5.0), (6, 6.0)])
    got = sorted((r["start"], r["length"]) for r in windows.stuck_runs(df, ["entity"], "ts", "value").collect())
    assert got == [(hour(0), 2), (hour(3), 3)]


def test_interpolation_bounds_the_whole_gap_and_not_edges(spark):
    df = series(spark, [(0, None), (1, 1.0), (2, None), (3, 3.0), (4, None), (5, None), (6, None), (7, 7.0), (8, None)])
    out = windows.interpolate(df, ["entity"], "ts", "value", 2).orderBy("ts").collect()
    assert [r["value"] for r in out] == [None, 1.0, 2.0, 3.0, None, None, None, 7.0, None]
    assert [r["value_imputed"] for r in out] == [False, False, True, False, False, False, False, False, False]


def test_excursions_and_boundaries(spark):
    base = [(k, 20.0 + (k % 3 - 1) * 2) for k in range(60)]
    values = [(k, 80.0 if 20 <= k <= 22 else -40.0 if k == 23 else v) for k, v in base if k != 40]
    df = series(spark, values).withColumn("cell", F.lit(1))
    scored = windows.robust_scores(df, ["entity", "cell"], "value")
    runs = windows.boundaries(windows.excursion_runs(scored, ["entity"], "ts"), scored, ["entity"], "ts").orderBy("start").collect()
    assert [(r["start"], r["length"], r["direction"], r["left_reason"], r["right_reason"]) for r in runs] == [(hour(20), 3, 1, "below_threshold", "direction_reversal"), (hour(23), 1, -1, "direction_reversal", "below_threshold")]
    # only below_threshold says that a run ended; a reversal leaves its length unknown
    assert runs[0]["peak_at"] == hour(20) and all(r["censored"] for r in runs)


def test_small_cells_refuse_to_score(spark):
    out = windows.robust_scores(series(spark, [(k, float(k)) for k in range(19)]), ["entity"], "value").first()
    assert out["z"] is None and out["excursion"] is None and out["unscored"] == "small_cell"
    flat = windows.robust_scores(series(spark, [(k, 1.0) for k in range(30)]), ["entity"], "value").first()
    assert flat["unscored"] == "no_spread"


def test_radius_join_equals_all_pairs(spark):
    import random

    rng = random.Random(1)
    pts = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(200, 0.0, 179.9), (201, 0.0, -179.9), (202, None, 1.0)]
    df = spark.createDataFrame(pts, "k int, lat double, lon double")

    def km(a, b):
        p, q = map(math.radians, (a[1], b[1]))
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in pts for b in pts if a is not b and a[1] is not None and b[1] is not None and km(a, b) <= 900}
    assert {(r["k"], r["neighbour"]) for r in joins.neighbour_edges(df, "k", "lat", "lon", 900).collect()} == want


def test_checked_join_refuses_repeats(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats a key"):
        joins.checked(left, right, ["k"]).collect()


def test_donor_recovers_an_injected_line(spark):
    rows = [("a", hour(k), None if 30 <= k < 35 else 2.0 * (k % 17) + 5) for k in range(80)] + [("b", hour(k), float(k % 17)) for k in range(80)] + [("c", hour(k), float((k * 7) % 5)) for k in range(80)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, value double")
    edges = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 1.0)], "entity string, neighbour string, km double")
    best = gapfill.donors(df, edges, "entity", "ts", "value")
    assert best.first()["neighbour"] == "b"
    out = gapfill.fill_from_donors(df, best, "entity", "ts", "value").where("value_imputed").collect()
    assert len(out) == 5 and all(abs(r["value"] - (2 * (int((r["ts"] - T0).total_seconds() // 3600) % 17) + 5)) < 1e-6 for r in out)


def test_iterative_fill_recovers_a_linear_column(spark):
    rows = [(float(i), None if i % 7 == 0 else 3.0 * i + 1, float(i % 4)) for i in range(60)]
    out = gapfill.fill_iteratively(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"]).where("y_imputed").collect()
    assert out and all(abs(r["y"] - (3 * r["x"] + 1)) < 1e-6 for r in out)


def test_hidden_values_are_scored(spark):
    df = series(spark, [(k, float(k)) for k in range(200)])
    hidden = gapfill.hide(df, "entity", "ts", "value", 0.3, 1)
    r = gapfill.fill_errors(windows.interpolate(hidden, ["entity"], "ts", "value", 5), "truth", "value", ["entity"]).first()
    assert r["hidden"] > 20 and r["mae"] < 1e-9 and r["recovered"] > 0.8


def test_metrics_refuse_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (float("nan"), 1.0), (2.0, float("inf")), (None, 1.0)], "y double, p double")
    r = scores.metrics(df.withColumn("g", F.lit(1)), ["g"], "y", "p", 2.5).first()
    assert r["n"] == 2 and abs(r["rmse"] - math.sqrt(0.5)) < 1e-6 and r["r2"] == 0.5 and r["f1"] == 0.0
    flat = scores.metrics(spark.createDataFrame([(1, 1.0, 2.0)], "g int, y double, p double"), ["g"], "y", "p", 2.5).first()
    assert flat["r2"] is None and flat["f1"] is None


def test_ols_recovers_coefficients(spark):
    import random

    rng = random.Random(2)
    rows = [(x, z, 2 + 3 * x - z + rng.gauss(0, 0.01)) for x, z in ((rng.random(), rng.random()) for _ in range(400))]
    got = {r["term"]: r for r in stats.ols(spark.createDataFrame(rows, "x double, z double, y double"), "y", ["x", "z"]).collect()}
    assert abs(got["intercept"]["coef"] - 2) < 0.01 and abs(got["x"]["coef"] - 3) < 0.01 and abs(got["z"]["coef"] + 1) < 0.01
    assert got["x"]["vif"] < 1.1 and got["x"]["r2"] > 0.999


def test_benjamini_hochberg_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    out = stats.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").orderBy("p").collect()
    assert [round(r["adjusted"], 6) for r in out] == [0.04, 0.053333, 0.053333, 0.5] and [r["significant"] for r in out] == [True, False, False, False]


def test_moran_of_a_gradient_is_high(spark):
    pts = spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, v double")
    edges = spark.createDataFrame([(i, j) for i in range(20) for j in (i - 1, i + 1) if 0 <= j < 20], "k int, neighbour int")
    r = stats.morans_i(pts, stats.row_standardised(edges, "k"), [], "k", "neighbour", "v").first()
    assert r["moran_i"] > 0.8 and r["z"] > 3 and abs(r["expected"] + 1 / 19) < 1e-6


def test_association_refuses(spark):
    df = spark.createDataFrame([("few", 1.0, 2.0, 1), ("few", 2.0, 3.0, 1), *[("flat", 1.0, float(i), 1) for i in range(5)], *[("up", float(i), float(i * i), i % 2) for i in range(9)]], "g string, a double, b double, w int")
    got = {r["g"]: r for r in stats.association(df, ["g"], "a", "b", "w").collect()}
    assert got["few"]["refusal"] == "too_few" and got["few"]["pearson"] is None
    assert got["flat"]["refusal"] == "constant" and got["up"]["spearman"] == 1.0


def test_paf_and_sectors(spark):
    r = spark.range(1).select(domain.attributable_fraction(F.lit(5.0), F.lit(0.1), F.lit(5.0)).alias("zero"), domain.attributable_fraction(F.lit(15.0), F.lit(0.1), F.lit(5.0)).alias("paf"), domain.wind_sector(F.lit(360.0)).cast("int").alias("s"), domain.wind_sector(F.lit(-10.0)).cast("int").alias("n")).first()
    assert r["zero"] == 0 and abs(r["paf"] - (1 - math.exp(-1))) < 1e-12 and r["s"] == 0 and r["n"] == 330


def test_cbpf_finds_the_injected_direction(spark):
    rows = [(float(k % 360), 3.0, 100.0 if 80 <= k % 360 < 100 else 10.0) for k in range(3600)] + [(85.0, 0.2, 100.0)] * 50  # calm hours count for no sector
    out = panels.cbpf(spark.createDataFrame(rows, "b double, s double, v double"), "s", "b", "v", 0.9, 30.0, [2, 4], 20, calm=0.5).orderBy(F.desc_nulls_last("probability")).first()
    assert out["sector"] in (60, 90) and out["probability"] > 0.3


def test_folds_test_each_row_once(spark):
    st = spark.createDataFrame([(k, None if k % 5 == 0 else f"z{k % 3}") for k in range(23)], "k int, zone string")
    folds = scores.station_folds(st, "k", "zone", 4)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [5, 6, 6, 6]
    assert tuple(scores.tested_once(folds, st, ["k"]).first()) == (0, 0)


def test_bins_are_right_closed(spark):
    got = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 4.0, 9.0, None)], "x double").select(maths.right_closed(F.col("x"), [1, 4]).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 0, 1, 1, 2, None]


def test_operators_on_empty_frames(spark):
    empty = series(spark, [])
    for df in (aggregate.daily(empty, ["entity"], "ts", "value"), windows.hourly_grid(empty, ["entity"], "ts"), windows.stuck_runs(empty, ["entity"], "ts", "value"), windows.robust_scores(empty, ["entity"], "value"), windows.interpolate(empty, ["entity"], "ts", "value", 2), stats.ols(empty, "value", [])):
        assert df.collect() == []


def test_permutations_tell_a_gradient_from_noise(spark):
    edges = stats.row_standardised(spark.createDataFrame([(i, j) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30], "k int, neighbour int"), "k")
    up = stats.moran_null(spark.createDataFrame([(i, float(i)) for i in range(30)], "k int, v double"), edges, "k", "neighbour", "v", draws=39).first()
    assert up["p"] <= 0.05 and abs(up["null_mean"]) < 0.2
    import random

    rng = random.Random(5)
    mixed = stats.moran_null(spark.createDataFrame([(i, rng.random()) for i in range(30)], "k int, v double"), edges, "k", "neighbour", "v", draws=39).first()
    assert mixed["p"] > 0.05


def test_transfer_trains_on_earlier_years_only(spark):
    df = spark.createDataFrame([("a", 2015), ("a", 2016), ("a", 2018), ("b", 2015)], "s string, y int")
    out = scores.transfer_folds(df, "s", "y").collect()
    assert all(r["train_year"] < r["test_year"] for r in out) and {r["s"] for r in out} == {"a"} and len(out) == 6


def test_why_runs_end(spark):
    values = [(k, 80.0 if k in (20, 30, 40, 50, 0) else 20.0 + (k % 3 - 1) * 2) for k in range(59)] + [(59, 80.0)]
    present = series(spark, [v for v in values if v[0] != 19]).withColumn("usable", ~F.hour("ts").isin(7) | (F.dayofmonth("ts") != 2)).withColumn("rejected", F.lit(True))
    present = present.withColumn("usable", F.col("usable") & ~((F.hour("ts") == 17) & (F.dayofmonth("ts") == 2))).withColumn("rejected", F.hour("ts") == 7)
    scored = windows.robust_scores(present.where("usable").withColumn("cell", F.lit(1)), ["entity", "cell"], "value")
    runs = windows.boundaries(windows.excursion_runs(scored, ["entity"], "ts"), scored, ["entity"], "ts", present, (hour(0), hour(58)))
    got = {r["start"]: (r["left_reason"], r["right_reason"], r["censored"]) for r in runs.collect()}
    assert got[hour(0)] == ("outside_requested_span", "below_threshold", True)
    assert got[hour(20)] == ("absent", "below_threshold", True)
    assert got[hour(30)] == ("below_threshold", "agency_rejected", True)
    assert got[hour(40)] == ("below_threshold", "value_null", True)
    assert got[hour(50)] == ("below_threshold", "below_threshold", False)
    assert got[hour(59)] == ("below_threshold", "outside_requested_span", True)
    edge = windows.boundaries(windows.excursion_runs(scored, ["entity"], "ts"), scored, ["entity"], "ts", present).orderBy("start").collect()
    assert edge[0]["left_reason"] == "series_edge" and edge[-1]["right_reason"] == "series_edge"


def test_verdicts_in_their_order(spark):
    from aerolith.plans import jobs

    rows = [
        # placed, scoreable, elevated, direction, length, censored
        (False, None, None, 1, 1, False, "uncheckable", "no_coordinates"),
        (True, 2, 2, 1, 1, False, "uncheckable", "too_few_scoreable_neighbours"),
        (True, 0, 0, -1, 1, False, "uncheckable", "no_scoreable_neighbour"),
        (True, 3, 3, 1, 1, True, "regional_episode", "synchronous_rise"),
        (True, 3, 3, -1, 1, False, "uncorroborated_sustained_rise", "sustained_and_alone"),
        (True, 3, 0, 1, 1, True, "uncheckable", "duration_censored"),
        (True, 3, 0, 1, 2, False, "uncorroborated_short_rise", "short_and_alone"),
        (True, 3, 1, 1, 2, False, "uncorroborated_sustained_rise", "sustained_and_alone"),
        (True, 3, 0, 1, 3, False, "uncorroborated_sustained_rise", "sustained_and_alone"),
    ]
    df = spark.createDataFrame(rows, "p boolean, s int, e int, d int, n int, c boolean, verdict string, reason string")
    said = jobs.verdict(*(F.col(c) for c in "psednc"))
    for r in df.withColumn("v", said).collect():
        assert (r["v"]["verdict"], r["v"]["reason"]) == (r["verdict"], r["reason"])


def test_stuck_runs_of_a_blind_format(spark):
    df = series(spark, [(0, 1.0), (1, 3.0), (2, 3.0), (3, 0.0), (4, 0.0), (5, 0.0)]).withColumn("bad", F.hour("ts") == 1)
    out = windows.stuck_runs(df, ["entity"], "ts", "value", rejected=F.col("bad"), blind=F.hour("ts") > 2)
    got = {r["value"]: (r["rejected_share"], r["at_zero"], r["negative"], r["entered_from_below"], r["value_share"]) for r in out.collect()}
    assert got == {3.0: (0.5, False, False, True, 2 / 6), 0.0: (None, True, False, False, 3 / 6)}


def test_annual_folds_expand_by_quarters():
    folds = windows.annual_folds(2025)
    assert [f[0] for f in folds] == ["q2", "q3", "q4"] and all(f[2] == f[3] for f in folds) and folds[-1][4].year == 2026
