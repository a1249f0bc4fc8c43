"""Nearest and radius joins against all pairs: poles, date line, clusters, odd coordinates, plans without products."""

import math
import random

from aerolith.operators import joins

SCHEMA = "id long, lat double, lon double, km string"


def far(p, q):
    a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def points(seed, n):
    rng = random.Random(seed)
    out = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180), "x") for i in range(n)]
    out += [(n + i, 25 + rng.gauss(0, 0.05), 121 + rng.gauss(0, 0.05), "x") for i in range(n)]  # a town
    return out + [(10 * n + i, float(lat), float(lon), "x") for i, (lat, lon) in enumerate([(90, 0), (-90, 10), (89.9, 170), (0, 180), (0, -180), (0, 179.9), (0, -179.9), (25, 121)])]


ODD = [(-1, None, 1.0, "x"), (-2, 1.0, None, "x"), (-3, float("nan"), 1.0, "x")]


def frames(spark):
    a, b = points(1, 60), points(2, 50)
    return a, b, spark.createDataFrame(a + a[:5] + ODD, SCHEMA), spark.createDataFrame(b + ODD, SCHEMA).withColumnRenamed("id", "other")


def test_nearest_equals_all_pairs(spark):
    a, b, left, right = frames(spark)
    out = joins.nearest(left, right, ("id", "lat", "lon"), ("other", "lat", "lon"))
    got = {r["id"]: (r["other"], r["km"]) for r in out.collect()}
    assert set(got) == {p[0] for p in a}
    for p in a:
        best = min(far(p, q) for q in b)
        assert abs(got[p[0]][1] - best) < 1e-6
        chosen = next(q for q in b if q[0] == got[p[0]][0])
        assert abs(far(p, chosen) - best) < 1e-6 and chosen[0] == min(q[0] for q in b if q[1:3] == chosen[1:3])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert joins.nearest(left, right.limit(0), ("id", "lat", "lon"), ("other", "lat", "lon")).collect() == []
    assert joins.nearest(left.limit(0), right, ("id", "lat", "lon"), ("other", "lat", "lon")).collect() == []


def test_radius_equals_all_pairs(spark):
    a, b, left, right = frames(spark)
    for km in (3.0, 150.0, 2500.0, 12_000.0):
        got = sorted({(r["id"], r["other"]) for r in joins.within_radius(left, right, ("id", "lat", "lon"), ("other", "lat", "lon"), km).collect()})
        assert got == sorted((p[0], q[0]) for p in a for q in b if far(p, q) <= km), km


def test_one_point_far_from_all(spark):
    left = spark.createDataFrame([(1, -50.0, -100.0, "x")], SCHEMA)
    right = spark.createDataFrame([(7, 25.0, 121.0, "x"), (8, 24.0, 120.0, "x"), (9, 25.0, 121.0, "x")], SCHEMA).withColumnRenamed("id", "other")
    got = joins.nearest(left, right, ("id", "lat", "lon"), ("other", "lat", "lon")).collect()
    assert [(r["id"], r["other"]) for r in got] == [(1, min((far((0, -50, -100), (0, q[1], q[2])), q[0]) for q in [(7, 25.0, 121.0), (8, 24.0, 120.0), (9, 25.0, 121.0)])[1])]


def test_nearest_of_sets_that_lie_apart(spark):
    rng = random.Random(8)
    near = [(i, rng.uniform(20, 24), rng.uniform(100, 104), "x") for i in range(150)]
    away = [(i, rng.uniform(22, 32), rng.uniform(125, 135), "x") for i in range(900)] + [(900 + i, 27.5, 126.25, "x") for i in range(300)]
    left, right = spark.createDataFrame(near, SCHEMA), spark.createDataFrame(away, SCHEMA).withColumnRenamed("id", "other")
    got = {r["id"]: (r["other"], r["km"]) for r in joins.nearest(left, right, ("id", "lat", "lon"), ("other", "lat", "lon")).collect()}
    assert len(got) == 150
    for p in near:
        best = min((far(p, q), q[0]) for q in away)
        assert abs(got[p[0]][1] - best[0]) < 1e-6 and (got[p[0]][0] == best[1] or best[1] >= 900)
