"""Ranks, order statistics, folds, event windows, grid cells and p values, each against a plain computation; no plan may hold one task for a key or a nested loop over rows."""

import datetime as dt
import math
import random

import pytest

from aerolith.operators import aggregate, audits, scores, stats, windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    # a third of all rows are one value of one key
    return [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 300)), rng.random() * 1e9, -1.5])) for _ in range(4000)] + [("a", 7.0)] * 2000 + [("lone", 3.0), ("none", None), ("nan", math.nan)]


def test_average_ranks(spark, rows):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id long, k string, v double, __note string")
    got = {r["id"]: r for r in windows.average_ranks(df, ["k"], "v").collect()}
    assert len(got) == len(rows) and got[0]["__note"] == "x"
    order = {k: sorted((v for q, v in rows if q == k and v is not None), key=lambda v: (math.isnan(v), v)) for k in {k for k, _ in rows}}
    first, count = {}, {}
    for k, vs in order.items():
        for i, v in enumerate(vs):
            first.setdefault((k, str(v)), i + 1)
            count[k, str(v)] = count.get((k, str(v)), 0) + 1
    for i, (k, v) in enumerate(rows):
        if v is None:
            assert got[i]["min_rank"] is None and got[i]["average_rank"] is None
        else:
            at = first[k, str(v)]
            assert (got[i]["min_rank"], got[i]["average_rank"]) == (at, at + (count[k, str(v)] - 1) / 2), (k, v)
    assert windows.average_ranks(df.limit(0), ["k"], "v").collect() == []


@pytest.mark.parametrize("keys", [["k"], []])
def test_order_statistics(spark, rows, keys):
    rows = [r for r in rows if r[0] != "nan"]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"] if keys else None: (r["low"], r["mid"], r["high"]) for r in aggregate.order_statistics(df, keys, "v", {"low": 0.0, "mid": 0.5, "high": 0.95}).collect()}
    for k in got:
        vs = sorted(v for q, v in rows if v is not None and (not keys or q == k))
        assert got[k] == tuple(vs[math.floor(q * (len(vs) - 1) + 0.5)] for q in (0.0, 0.5, 0.95))
    assert set(got) == ({k for k, v in rows if v is not None} if keys else {None})


def test_held_out_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 9.0), ("c", None)], "k string, v double")
    got = {(r["fold"], r["role"]): (r["n"], r["v"]) for r in scores.held_out_sums(df, "k", {"v": df.v}).collect()}
    assert got == {("a", "test"): (2, 3.0), ("a", "train"): (3, 14.0), ("b", "test"): (1, 5.0), ("b", "train"): (4, 12.0), ("c", "test"): (1, None), ("c", "train"): (4, 17.0)}
    assert [tuple(r) for r in scores.held_out_sums(df.where("k = 'b'"), "k", {}).collect()] == [("b", "test", 1)]
    assert "NestedLoop" not in plan(scores.held_out_sums(df, "k", {})) and scores.held_out_sums(df.limit(0), "k", {}).count() == 0


def test_event_windows_meet_by_day(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=rng.randrange(60 * 24 * 60)), float(rng.randrange(100))) for _ in range(3000)] + [(None, 1.0), (start, None)]
    events = [("x", dt.datetime(2024, 1, 10, 7), dt.datetime(2024, 1, 12, 19)), ("y", dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1)), ("far", dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 2)), ("open", dt.datetime(2024, 1, 5), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    out = audits.event_windows(df, spark.createDataFrame(events, "name string, start timestamp_ntz, end timestamp_ntz"), "ts", "value", 3)
    assert "NestedLoop" not in plan(out)
    want = {}
    for name, a, b in events[:3]:
        before = [v for t, v in rows if t and a - dt.timedelta(3) <= t < a]
        after = [v for t, v in rows if t and b <= t < b + dt.timedelta(3)]
        if before or after:
            mean = lambda x: round(sum(v for v in x if v is not None) / sum(v is not None for v in x), 6)
            want[name] = (len(before), len(after), mean(before), mean(after))
    got = {r["name"]: (r["n_before"], r["n_after"], r["mean_before"], r["mean_after"]) for r in out.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_nearest_cells(spark):
    rng = random.Random(9)
    lats, lons = [20.0, 20.5, 21.5, 24.0], [110.0, 111.0, 115.0]
    points = [(i, rng.choice([rng.uniform(15, 30), 20.25, 21.0, None]), rng.uniform(100, 120)) for i in range(300)]
    grid = spark.createDataFrame([(a, o) for a in lats for o in lons] + [(None, 5.0)], "lat double, lon double")
    got = {r["id"]: (r["cell_lat"], r["cell_lon"]) for r in audits.nearest_cell(spark.createDataFrame(points, "id long, lat double, lon double"), grid, "id").collect()}
    near = lambda x, axis: None if x is None else min(axis, key=lambda v: (abs(v - x), v))
    assert got == {i: (near(a, lats), near(o, [5.0, *lons])) for i, a, o in points}
    wide = spark.range(audits.AXIS + 1).selectExpr("cast(id as double) as lat", "1.0d as lon")
    with pytest.raises(Exception, match="more than"):
        audits.nearest_cell(spark.createDataFrame(points[:1], "id long, lat double, lon double"), wide, "id").collect()


def test_p_values():
    # against the density's own integral
    for freedom in (1, 2, 7, 30, 250):
        for t in (0.0, 0.3, -1.7, 4.2, 12.0):
            n, lo = 20_000, math.atan(abs(t) / math.sqrt(freedom))
            area = lambda a: sum(math.cos(a + (math.pi / 2 - a) * (i + 0.5) / n) ** (freedom - 1) for i in range(n)) * (math.pi / 2 - a) / n
            assert stats.two_sided_p(t, freedom) == pytest.approx(area(lo) / area(0.0), rel=1e-6, abs=1e-12)
    assert stats.two_sided_p(1.959964, 1e7) == pytest.approx(0.05, abs=1e-6) and stats.two_sided_p(1e9, 5.0) < 1e-30


@pytest.mark.parametrize("reach", [0.002, 1e-9])
def test_descriptive_puts_no_column_through_one_task(spark, reach):
    import statistics

    rng = random.Random(5)
    xs = [rng.choice([7.0, None, rng.random() * 1e6, -rng.random()]) for _ in range(3001)]
    rows = [(x, i % 5, None) for i, x in enumerate(xs)]
    out = aggregate.descriptive(spark.createDataFrame(rows, "a double, b int, c double").repartition(7), ["a", "b", "c"], reach)
    assert "median(" not in plan(out) and "percentile(" not in plan(out)
    got = {r["variable"]: r for r in out.collect()}
    known = [x for x in xs if x is not None]
    assert got["a"]["median"] == pytest.approx(statistics.median(known), abs=1e-6) and (got["a"]["n"], got["a"]["min"], got["a"]["max"]) == (len(known), min(known), max(known))
    assert got["b"]["median"] == 2.0 and (got["c"]["n"], got["c"]["median"], got["c"]["sd"]) == (0, None, None)
    # a column without rows keeps its row, as in SQL
    assert [(r["variable"], r["n"]) for r in aggregate.descriptive(spark.createDataFrame([], "a double"), ["a"], reach).collect()] == [("a", 0)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_median_ratios_come_from_bins(spark, by):
    import statistics

    rng = random.Random(7)
    rows = [(rng.choice(["a", None]), rng.random() * 9, rng.choice([0.0, 2.0, rng.random()])) for _ in range(1501)] + [("lone", 3.0, 2.0), ("none", 1.0, 0.0)]
    out = aggregate.pair_diagnostics(spark.createDataFrame(rows, "k string, a double, b double"), by, "a", "b")
    assert "median(" not in plan(out) and "percentile(" not in plan(out)
    got = {r["k"] if by else None: r["median_ratio"] for r in out.collect()}
    for k in got:
        ratios = [a / b for q, a, b in rows if b > 0 and (not by or q == k)]
        assert got[k] == (pytest.approx(statistics.median(ratios), abs=1e-6) if ratios else None)
    assert len(got) == (4 if by else 1)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.75, 1.0])
def test_linear_quantiles_are_those_of_percentile(spark, rows, q):
    from pyspark.sql import functions as F

    from aerolith.operators import panels

    df = spark.createDataFrame([r for r in rows if r[0] != "nan"], "k string, v double")
    assert aggregate.linear_quantile(df, [], "v", q).first()[0] == df.agg(F.percentile("v", q)).first()[0]
    wind = df.select(F.lit(1.0).alias("speed"), F.lit(90.0).alias("bearing"), "v")
    assert "percentile(" not in plan(panels.cbpf(wind, "speed", "bearing", "v", q, 30.0, [0.5], 1))
