"""Joins in every logical form, nearest and radius joins, shifted joins, checks and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import GRID, HOURS, grid, haversine_sql, hours, placed, placed_sql
from aerolith.operators import joins, panels


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def inner_multiway(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def left_outer(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left")


@query(f"WITH {GRID} SELECT entity, CAST(ts AS DATE) AS day, count(*) AS hours, count(value) AS known FROM grid GROUP BY 1, 2")
def left_densified(spark, d):
    return grid(spark, d).groupBy("entity", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("hours"), F.count("value").alias("known"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS presence FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k")
def presence_reconcile(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return joins.reconcile(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_join(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(n, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT event_type, day, count(e.event_id) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) x LEFT JOIN (SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE value > 450) e USING (event_type, day) GROUP BY 1, 2")
def cross_expected_keys(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    keys = e.select("event_type").distinct().crossJoin(e.select("day").distinct())
    return keys.join(e.where("value > 450"), ["event_type", "day"], "left").groupBy("event_type", "day").agg(F.count("event_id").alias("n"))


_C, _S = placed_sql("customer", "c_custkey"), placed_sql("supplier", "s_suppkey")


@query(f"WITH p AS (SELECT c_custkey, s_suppkey, {haversine_sql('c', 's')} AS km FROM {_C} c, {_S} s), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS n FROM p) SELECT c_custkey, s_suppkey, round(km, 4) AS km FROM r WHERE n = 1")
def nearest_reference(spark, d):
    c, s = placed(table(spark, d, "customer"), "c_custkey"), placed(table(spark, d, "supplier"), "s_suppkey")
    return joins.nearest(c, s, ("c_custkey", "lat", "lon"), ("s_suppkey", "lat", "lon")).withColumn("km", F.round("km", 4))


@query(f"SELECT c_custkey, s_suppkey, round({haversine_sql('c', 's')}, 4) AS km FROM {_C} c, {_S} s WHERE {haversine_sql('c', 's')} <= 60")
def within_radius(spark, d):
    c, s = placed(table(spark, d, "customer"), "c_custkey"), placed(table(spark, d, "supplier"), "s_suppkey")
    return joins.within_radius(c, s, ("c_custkey", "lat", "lon"), ("s_suppkey", "lat", "lon"), 60.0, digits=4)


@query(f"SELECT a.s_suppkey, b.s_suppkey AS neighbour, round({haversine_sql('a', 'b')}, 4) AS km FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey AND {haversine_sql('a', 'b')} <= 150")
def neighbour_edges(spark, d):
    s = placed(table(spark, d, "supplier"), "s_suppkey")
    return joins.neighbour_edges(s, "s_suppkey", "lat", "lon", 150.0, digits=4)


@query(f"WITH p AS (SELECT c_custkey, min({haversine_sql('c', 's')}) AS km FROM {_C} c, {_S} s GROUP BY 1), r(radius) AS (VALUES (5.0::DOUBLE), (20.0), (60.0)) SELECT radius, count(*) FILTER (km <= radius) AS members FROM p, r GROUP BY 1")
def radius_cohorts(spark, d):
    c, s = placed(table(spark, d, "customer"), "c_custkey"), placed(table(spark, d, "supplier"), "s_suppkey")
    return joins.radius_cohorts(joins.nearest(c, s, ("c_custkey", "lat", "lon"), ("s_suppkey", "lat", "lon")), "c_custkey", "km", [5, 20, 60])


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def checked_many_to_one(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.checked(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query(f"WITH {HOURS} SELECT a.entity, a.ts, b.value AS value_p1, c.value AS value_m1 FROM hours a LEFT JOIN hours b ON a.entity = b.entity AND b.ts = a.ts + INTERVAL 1 HOUR LEFT JOIN hours c ON a.entity = c.entity AND c.ts = a.ts - INTERVAL 1 HOUR")
def shifted_join(spark, d):
    h = hours(spark, d)
    out = joins.shifted(h.select("entity", "ts"), h, ["entity"], "ts", 1, ["value"])
    return joins.shifted(out, h, ["entity"], "ts", -1, ["value"])


@query("SELECT c_custkey AS key, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def keyed_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return joins.upsert(old, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")), ["key"])


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.02)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.02 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)) AS only_right")
def frame_difference(spark, d):
    li = table(spark, d, "lineitem")
    return joins.same_rows(li.where("l_quantity > 10").select("l_orderkey", "l_linenumber"), li.where("l_tax > 0.02").select("l_orderkey", "l_linenumber"))


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def relational_division(spark, d):
    return panels.present_in_all(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("""WITH k AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 300), u AS (SELECT DISTINCT user_id FROM k), t AS (SELECT DISTINCT event_type FROM k), m AS (SELECT user_id, event_type FROM u, t EXCEPT SELECT user_id, event_type FROM k)
 SELECT user_id, array_to_string(list_sort(list(event_type)), ',') AS missing FROM m GROUP BY 1""")
def missing_members(spark, d):
    out = panels.missing_members(table(spark, d, "events").where("value > 300"), "user_id", "event_type")
    return out.select("user_id", F.array_join("missing", ",").alias("missing"))


_ISLANDS = f"""{HOURS}, s AS (SELECT *, median(value) OVER (PARTITION BY entity, hour(ts)) AS m, count(value) OVER (PARTITION BY entity, hour(ts)) AS n FROM hours),
 s2 AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY entity, hour(ts)) AS mad FROM s),
 s3 AS (SELECT entity, ts, value, CASE WHEN n >= 10 AND mad > 0 THEN 0.67449 * (value - m) / mad END AS z FROM s2), s4 AS (SELECT *, abs(z) >= 2 AS ex, CASE WHEN abs(z) >= 2 THEN CAST(sign(z) AS INTEGER) END AS dir FROM s3),
 h AS (SELECT *, CASE WHEN dir = lag(dir) OVER w AND ts - lag(ts) OVER w = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM s4 WHERE ex WINDOW w AS (PARTITION BY entity ORDER BY ts)),
 r AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM h)"""


def scored(spark, d):
    from aerolith.operators.windows import robust_scores

    return robust_scores(hours(spark, d).withColumn("hour", F.hour("ts")), ["entity", "hour"], "value", least=10, threshold=2.0)


@query(f"""WITH {_ISLANDS}, runs AS (SELECT entity, run, min(ts) AS start, max(ts) AS "end", min(dir) AS direction FROM r GROUP BY 1, 2),
 sh(shift) AS (VALUES (0), (-14), (14)), o AS (SELECT entity, start, direction, shift, unnest(generate_series(start - INTERVAL 1 HOUR, "end" + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) + shift * INTERVAL 1 DAY AS ts FROM runs, sh),
 m AS (SELECT o.entity, o.start, o.shift, s.entity AS nb, s.ex AND s.dir = o.direction AS up FROM o JOIN s4 s ON s.ts = o.ts AND s.entity <> o.entity AND s.z IS NOT NULL),
 p AS (SELECT entity, start, shift, count(DISTINCT nb) AS sc, count(DISTINCT nb) FILTER (up) AS el FROM m GROUP BY 1, 2, 3),
 f AS (SELECT entity, start, coalesce(max(sc) FILTER (shift = 0), 0) AS scoreable, coalesce(max(el) FILTER (shift = 0), 0) AS elevated, round(avg(el) FILTER (shift <> 0), 6) AS elevated_shifted FROM p GROUP BY 1, 2)
 SELECT runs.entity, runs.start, (SELECT count(DISTINCT entity) - 1 FROM s4) AS placed, scoreable, elevated, elevated_shifted FROM runs LEFT JOIN f USING (entity, start)""")
def corroboration(spark, d):
    """Every other event type is a neighbour of each."""
    from aerolith.operators.windows import excursion_runs

    s = scored(spark, d)
    names = s.select("entity").distinct()
    edges = names.crossJoin(names.withColumnRenamed("entity", "neighbour")).where("entity <> neighbour")
    out = joins.corroborate(excursion_runs(s, ["entity"], "ts"), edges, s, "entity", "ts", 1, [-14, 14])
    return out.select("entity", "start", "placed", "scoreable", "elevated", F.round("elevated_shifted", 6).alias("elevated_shifted"))


@query("""WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS mean FROM events GROUP BY 1, 2)
 SELECT a.date, round(a.mean / b.mean, 6) AS ratio, a.mean > b.mean AS above FROM daily a JOIN daily b USING (date) WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def self_join_ratio(spark, d):
    table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("mean")).createOrReplaceTempView("daily_means")
    return spark.sql("SELECT date, round(a.mean / b.mean, 6) AS ratio, a.mean > b.mean AS above FROM daily_means a JOIN daily_means b USING (date) WHERE a.event_type = 'click' AND b.event_type = 'view'")
