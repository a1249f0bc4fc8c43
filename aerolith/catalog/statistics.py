"""Association, regression, trends, spatial statistics, device-day tables, models and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import GRID, fit_sql, grid, haversine_sql, hours, ols_sql, placed, placed_sql
from aerolith.operators import networks, stats, windows

_S = placed_sql("supplier", "s_suppkey")
_EDGES = f"e AS (SELECT a.s_suppkey AS k, b.s_suppkey AS nb, {haversine_sql('a', 'b')} AS km FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey AND {haversine_sql('a', 'b')} <= 250), ew AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY k) AS weight FROM e)"


def _balances(spark, d):
    return placed(table(spark, d, "supplier"), "s_suppkey").select("s_suppkey", "s_acctbal", "lat", "lon")


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS average_rank, CAST(rank() OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS min_rank FROM events")
def ranks(spark, d):
    return windows.average_ranks(table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_type"], "user_id").drop("event_type", "user_id")


@query("""WITH r AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 5.0::DOUBLE ELSE CAST(hour(ts) AS DOUBLE) END AS a, value AS b, event_type AS g FROM events WHERE value > 100), x AS (SELECT *, a - avg(a) OVER (PARTITION BY user_id, g) AS da, b - avg(b) OVER (PARTITION BY user_id, g) AS db,
 rank() OVER (PARTITION BY user_id ORDER BY a) + (count(*) OVER (PARTITION BY user_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY user_id ORDER BY b) + (count(*) OVER (PARTITION BY user_id, b) - 1) / 2.0 AS rb FROM r),
 s AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) < 3 THEN 'too_few' WHEN stddev_pop(a) = 0 OR stddev_pop(b) = 0 THEN 'constant' END AS refusal, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS p, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS q, CASE WHEN stddev_pop(da) > 0 AND stddev_pop(db) > 0 THEN round(corr(da, db), 6) END AS w FROM x GROUP BY 1)
 SELECT user_id, n, CASE WHEN refusal IS NULL THEN p END AS pearson, CASE WHEN refusal IS NULL THEN q END AS spearman, CASE WHEN refusal IS NULL THEN w END AS within, refusal FROM s""")
def association(spark, d):
    """Of each user's larger events: hour and value, within event types; users with few events, or a constant side, are refused."""
    e = table(spark, d, "events").where("value > 100").select("user_id", F.when(F.col("user_id") % 3 == 0, 5.0).otherwise(F.hour("ts").cast("double")).alias("a"), F.col("value").alias("b"), F.col("event_type").alias("g"))
    return stats.association(e, ["user_id"], "a", "b", "g")


def _rounded(fit):
    return fit.select("term", F.round("coef", 2).alias("coef"), F.round("se", 3).alias("se"), F.round("t", 3).alias("t"), F.round("vif", 5).alias("vif"), F.round("r2", 6).alias("r2"), "n")


@query(ols_sql("base AS (SELECT 0 AS g, 1.0::DOUBLE AS w, l_extendedprice AS y, l_quantity AS x1 FROM lineitem)", ["l_quantity"]))
def ols_simple(spark, d):
    return _rounded(stats.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]))


@query(ols_sql("base AS (SELECT 0 AS g, 1.0::DOUBLE AS w, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem)", ["l_quantity", "l_discount", "l_tax"]))
def ols_several(spark, d):
    return _rounded(stats.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query("""WITH t AS (SELECT event_type, epoch(ts) / 86400.0 - 19723 AS x, value AS y FROM events) SELECT event_type, round(regr_slope(CASE WHEN x < 15 THEN y END, CASE WHEN x < 15 THEN x END), 5) AS slope_before, round(regr_slope(CASE WHEN x >= 15 THEN y END, CASE WHEN x >= 15 THEN x END), 5) AS slope_after,
 count(*) FILTER (x < 15) AS n_before, count(*) FILTER (x >= 15) AS n_after FROM t GROUP BY 1""")
def segmented_slopes(spark, d):
    t = table(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6 - 19723).alias("x"), F.col("value").alias("y"))
    return stats.segmented_slopes(t, ["event_type"], "x", "y", 15.0).withColumns({c: F.round(c, 5) for c in ("slope_before", "slope_after")})


@query("""WITH m AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2) SELECT a.k AS o_orderpriority, round(median((b.y - a.y) / (b.x - a.x)), 3) AS slope, count(*) AS pairs FROM m a JOIN m b ON a.k = b.k AND b.x > a.x GROUP BY 1""")
def theil_sen(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("x")).agg(F.avg("o_totalprice").alias("y"))
    return stats.theil_sen(m, ["o_orderpriority"], "x", "y").withColumn("slope", F.round("slope", 3))


@query(f"""WITH {_EDGES}, m AS (SELECT avg(s_acctbal) AS m FROM supplier), z AS (SELECT s_suppkey AS k, s_acctbal - m AS z FROM supplier, m), v AS (SELECT count(*)::DOUBLE AS n, sum(z * z) AS v FROM z),
 c AS (SELECT sum(weight * a.z * b.z) AS c, sum(weight) AS w FROM ew JOIN z a ON a.k = ew.k JOIN z b ON b.k = ew.nb), s1 AS (SELECT sum(pow(x.weight + y.weight, 2)) / 2 AS s1 FROM ew x JOIN ew y ON x.k = y.nb AND x.nb = y.k),
 s2 AS (SELECT sum(pow(o + i, 2)) AS s2 FROM (SELECT k, sum(weight) AS o FROM ew GROUP BY 1) JOIN (SELECT nb AS k, sum(weight) AS i FROM ew GROUP BY 1) USING (k)),
 t AS (SELECT *, n / w * c / v AS i, -1.0::DOUBLE / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * w * w) / ((n * n - 1) * w * w) - 1.0::DOUBLE / ((n - 1) * (n - 1)) AS var FROM v, c, s1, s2)
 SELECT CAST(n AS BIGINT) AS n, round(i, 6) AS moran_i, round(e, 6) AS expected, round((i - e) / sqrt(var), 4) AS z FROM t""")
def moran(spark, d):
    return networks.morans_i(_balances(spark, d), "s_suppkey", "s_acctbal", 250.0)


@query(f"""WITH {_EDGES}, m AS (SELECT avg(s_acctbal) AS m, var_pop(s_acctbal) AS v FROM supplier), z AS (SELECT s_suppkey AS k, s_acctbal - m AS z, v FROM supplier, m), l AS (SELECT ew.k, sum(weight * z.z) AS lag FROM ew JOIN z ON z.k = ew.nb GROUP BY 1)
 SELECT z.k AS s_suppkey, round(z * lag / v, 6) AS local_i, CASE WHEN z >= 0 THEN 'high' ELSE 'low' END || '-' || CASE WHEN lag >= 0 THEN 'high' ELSE 'low' END AS quadrant FROM z JOIN l USING (k)""")
def local_moran(spark, d):
    return networks.local_moran(_balances(spark, d), "s_suppkey", "s_acctbal", 250.0)


@query(f"""WITH {_EDGES}, m AS (SELECT avg(s_acctbal) AS m, var_pop(s_acctbal) AS v FROM supplier), z AS (SELECT s_suppkey AS k, s_acctbal - m AS z, v FROM supplier, m)
 SELECT CAST(CASE WHEN km <= 50 THEN 0 WHEN km <= 120 THEN 1 ELSE 2 END AS INTEGER) AS band, count(*) AS pairs, round(avg(a.z * b.z / a.v), 6) AS moran_i FROM e JOIN z a ON a.k = e.k JOIN z b ON b.k = e.nb GROUP BY 1""")
def correlogram(spark, d):
    return networks.correlogram(_balances(spark, d), "s_suppkey", "s_acctbal", 250.0, [50.0, 120.0])


@query(f"""WITH {_EDGES} SELECT s_suppkey, s_acctbal AS y_true, round(predicted, 2) AS predicted, neighbours FROM supplier JOIN (SELECT e.k, sum(b.s_acctbal / pow(greatest(km, 0.1), 2)) / sum(1 / pow(greatest(km, 0.1), 2)) AS predicted, count(*) AS neighbours FROM e JOIN supplier b ON b.s_suppkey = e.nb GROUP BY 1) g ON g.k = s_suppkey""")
def idw_leave_one_out(spark, d):
    return networks.idw_leave_one_out(_balances(spark, d), "s_suppkey", "s_acctbal", 250.0).withColumn("predicted", F.round("predicted", 2))


@query("""WITH p AS (SELECT user_id, round(1 / (1 + sum(value) / 1000), 9) AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM p), a AS (SELECT *, least(1.0, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
 SELECT user_id, p, round(adj, 6) AS adjusted, adj <= 0.5 AS significant FROM a""")
def benjamini_hochberg(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.round(1 / (1 + F.sum("value") / 1000), 9).alias("p"))
    out = stats.benjamini_hochberg(p, "p", 0.5)
    return out.withColumn("adjusted", F.round("adjusted", 6))


# --- device-day tables as SQL over views -----------------------------------------------------


def _view(spark, d):
    table(spark, d, "events").createOrReplaceTempView("sensor_events")


@query("""SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS readings, count(DISTINCT CAST(extract(hour FROM ts) AS BIGINT)) AS observed_hours, count(*) FILTER (value > 400) AS extreme, count(DISTINCT event_type) AS variables, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def device_day(spark, d):
    _view(spark, d)
    return spark.sql("SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS readings, count(DISTINCT hour(ts)) AS observed_hours, count(*) FILTER (WHERE value > 400) AS extreme, count(DISTINCT event_type) AS variables, min(value) AS low, max(value) AS high FROM sensor_events GROUP BY 1, 2")


_COHORT = """days AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS readings FROM events GROUP BY 1, 2), dev AS (SELECT user_id, count(*) AS days, CAST(sum(readings) AS BIGINT) AS readings FROM days GROUP BY 1)"""


@query(f"""WITH {_COHORT}, d(min_days) AS (VALUES (5), (15), (25)), r(min_readings) AS (VALUES (20), (60)) SELECT CAST(min_days AS INTEGER) AS min_days, CAST(min_readings AS INTEGER) AS min_readings, count(*) FILTER (days >= min_days AND readings >= min_readings) AS devices FROM dev, d, r GROUP BY 1, 2""")
def cohort_thresholds(spark, d):
    _view(spark, d)
    return spark.sql("""WITH days AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS readings FROM sensor_events GROUP BY 1, 2), dev AS (SELECT user_id, count(*) AS days, sum(readings) AS readings FROM days GROUP BY 1)
      SELECT min_days, min_readings, count(*) FILTER (WHERE days >= min_days AND readings >= min_readings) AS devices FROM dev CROSS JOIN VALUES (5), (15), (25) AS d(min_days) CROSS JOIN VALUES (20), (60) AS r(min_readings) GROUP BY ALL""")


@query(f"""WITH {_COHORT}, x AS (SELECT *, CASE WHEN days < 10 THEN 'few_days' WHEN readings < 50 THEN 'few_readings' WHEN user_id % 7 = 0 THEN 'out_of_area' END AS reason FROM dev) SELECT coalesce(reason, 'eligible') AS reason, count(*) AS devices, CAST(sum(readings) AS BIGINT) AS readings FROM x GROUP BY 1""")
def cohort_exclusions(spark, d):
    _view(spark, d)
    return spark.sql("""WITH days AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS readings FROM sensor_events GROUP BY 1, 2), dev AS (SELECT user_id, count(*) AS days, sum(readings) AS readings FROM days GROUP BY 1),
      x AS (SELECT * EXCEPT (days), CASE WHEN days < 10 THEN 'few_days' WHEN readings < 50 THEN 'few_readings' WHEN user_id % 7 = 0 THEN 'out_of_area' END AS reason FROM dev) SELECT coalesce(reason, 'eligible') AS reason, count(*) AS devices, sum(readings) AS readings FROM x GROUP BY 1""")


@query("""SELECT user_id, count(*) AS rows, (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_type, date_trunc('hour', ts) HAVING count(*) > 1)) AS duplicate_hours FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > 50) GROUP BY 1""")
def subqueries(spark, d):
    _view(spark, d)
    return spark.sql("SELECT user_id, count(*) AS rows, (SELECT count(*) FROM (SELECT 1 FROM sensor_events GROUP BY user_id, event_type, date_trunc('hour', ts) HAVING count(*) > 1)) AS duplicate_hours FROM sensor_events WHERE event_type IN (SELECT event_type FROM sensor_events GROUP BY 1 HAVING avg(value) > 50) GROUP BY 1")


# --- explorer queries ------------------------------------------------------------------------


@query("WITH daily AS (SELECT event_type AS item, CAST(ts AS DATE) AS date, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1, 2) SELECT item, count(*) FILTER (mean > 150) AS high_days, count(*) AS days FROM daily WHERE date >= DATE '2024-01-05' GROUP BY item HAVING days >= 10 ORDER BY high_days DESC, item LIMIT 10")
def explorer_high_days(spark, d):
    table(spark, d, "events").groupBy(F.col("event_type").alias("item"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n")).createOrReplaceTempView("daily")
    return spark.sql("SELECT item, count(*) FILTER (WHERE mean > 150) AS high_days, count(*) AS days FROM daily WHERE date >= '2024-01-05' GROUP BY item HAVING days >= 10 ORDER BY high_days DESC, item LIMIT 10")


@query("WITH daily AS (SELECT event_type AS item, CAST(ts AS DATE) AS date, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2) SELECT date, mean::DOUBLE AS mean, 'click' AS source FROM daily WHERE item = 'click' UNION ALL SELECT date, mean, 'view' FROM daily WHERE item = 'view'")
def explorer_union_view(spark, d):
    table(spark, d, "events").groupBy(F.col("event_type").alias("item"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 4).alias("mean")).createOrReplaceTempView("daily2")
    return spark.sql("SELECT date, mean::double AS mean, 'click' AS source FROM daily2 WHERE item = 'click' UNION ALL SELECT date, mean, 'view' FROM daily2 WHERE item = 'view'")


# --- models and resampling: rows only ---------------------------------------------------------


@query()
def bootstrap_means(spark, d):
    return stats.block_bootstrap(hours(spark, d), ["entity"], "ts", "value", block=24)


@query()
def bootstrap_slopes(spark, d):
    """Slope of each event type's daily means with its interval over resampled blocks of days."""
    days = hours(spark, d).groupBy("entity", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return stats.block_bootstrap_slope(days, ["entity"], "day", "value", block=7)


@query()
def permutation_test(spark, d):
    return stats.permutation_p(hours(spark, d).withColumn("weekend", F.weekday("ts") >= 5), ["entity"], "weekend", "value")


def _features(spark, d):
    from aerolith.functions.domain import temporal_features
    from aerolith.operators.windows import lag_features, target

    g = target(lag_features(grid(spark, d), ["entity"], "ts", "value", [1, 2, 24], [3]), ["entity"], "ts", "value", 1)
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    return g.select("*", *temporal_features(F.col("ts"))[:2]).withColumn("role", F.when(F.col("ts") < cut, "train").otherwise("test"))


@query()
def gbt_forecast(spark, d):
    from aerolith.operators.models import fit_predict

    rows = fit_predict(_features(spark, d), ["lag_1", "lag_2", "lag_24", "mean_3", "hour_sin", "hour_cos"], "target", kind="gbt")
    return rows.select("entity", "ts", "target", "predicted")


@query()
def forest_forecast(spark, d):
    from aerolith.operators.models import fit_predict

    rows = fit_predict(_features(spark, d), ["lag_1", "lag_2", "hour_sin", "hour_cos"], "target", kind="forest")
    return rows.select("entity", "ts", "target", "predicted")


@query(f"""WITH {GRID}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS n FROM grid), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN n END AS kn FROM i),
 f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(kn IGNORE NULLS) OVER b AS i0, first_value(value IGNORE NULLS) OVER a AS v1, first_value(kn IGNORE NULLS) OVER a AS i1 FROM k WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 x AS (SELECT entity, ts, value, n, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN i1 = i0 THEN v0 ELSE v0 + (v1 - v0) * (n - i0) / (i1 - i0) END AS x FROM f),
 l AS (SELECT entity AS g, 1.0::DOUBLE AS w, ts, value, n, x AS y, lag(x, 1) OVER o AS x1, lag(x, 24) OVER o AS x2, lag(x, 25) OVER o AS x3, count(*) OVER (PARTITION BY entity) AS c FROM x WINDOW o AS (PARTITION BY entity ORDER BY ts)),
 rows_ AS (SELECT *, n - 26 AS pos, CAST(floor(0.7::DOUBLE * (c - 25)) AS BIGINT) AS cut FROM l WHERE n > 25 AND c >= 75), base AS (SELECT * FROM rows_ WHERE pos < cut), {fit_sql('base', 3)}
 SELECT g AS entity, ts, value AS y_true, round(k0 + k1 * x1 + k2 * x2 + k3 * x3, 3) AS predicted, round(x1 + 1e-7, 3) AS persistence FROM rows_ r JOIN (SELECT g, k0, k1, k2, k3 FROM fit) USING (g) WHERE pos >= cut AND value IS NOT NULL""")
def seasonal_forecast(spark, d):
    from aerolith.operators.models import seasonal_autoregression

    return seasonal_autoregression(grid(spark, d), "entity", "ts", "value").withColumns({"predicted": F.round("predicted", 3), "persistence": F.round(F.col("persistence") + 1e-7, 3)})


@query(f"""WITH base AS (SELECT 0 AS g, 1.0::DOUBLE AS w, CAST(o_orderdate AS DATE) AS ts, CAST(month(o_orderdate) AS INTEGER) AS cell, o_totalprice AS y, CAST(o_orderkey % 13 AS DOUBLE) AS x1, CAST(o_custkey % 7 AS DOUBLE) AS x2, year(o_orderdate) + month(o_orderdate) / 12.0::DOUBLE AS x3 FROM orders), {fit_sql('base', 3)},
 p AS (SELECT *, row_number() OVER (ORDER BY cell, ts, x1, x2, x3) - 1 AS place FROM base), c AS (SELECT cell, min(place) AS first, count(*) AS k FROM p GROUP BY 1),
 asked AS (SELECT ts, x3, first + CAST(floor(CAST('0x' || md5(concat_ws('|', place, d, 3))[1:8] AS BIGINT) / 4294967296.0::DOUBLE * k) AS BIGINT) AS place FROM p JOIN c USING (cell), generate_series(0, 4) s(d)),
 o AS (SELECT date_trunc('month', ts) AS month, avg(y) AS y FROM base GROUP BY 1), m AS (SELECT date_trunc('month', a.ts) AS month, avg(k0 + k1 * p.x1 + k2 * p.x2 + k3 * a.x3) AS y FROM asked a JOIN p USING (place), fit GROUP BY 1),
 t AS (SELECT 'o' AS what, year(month) + (month(month) - 1) / 12.0::DOUBLE AS x, y FROM o UNION ALL SELECT 'm', year(month) + (month(month) - 1) / 12.0::DOUBLE, y FROM m),
 s AS (SELECT a.what, round(median((b.y - a.y) / (b.x - a.x)), 6) AS slope FROM t a JOIN t b ON a.what = b.what AND b.x > a.x GROUP BY 1),
 both_ AS (SELECT max(slope) FILTER (what = 'o') AS observed_slope, max(slope) FILTER (what = 'm') AS normalised_slope FROM s)
 SELECT round(observed_slope, 2) AS observed_slope, round(normalised_slope, 2) AS normalised_slope, round(CASE WHEN observed_slope <> 0 THEN (observed_slope - normalised_slope) / observed_slope END, 4) AS weather_share FROM both_""")
def weather_share(spark, d):
    """Of the trend of orders' prices, the share that goes once other columns are drawn from all years' rows of the month; the linear model."""
    from aerolith.operators.models import normalise_weather, weather_share

    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 13).cast("double").alias("load"), (F.col("o_custkey") % 7).cast("double").alias("calm"), (F.year("o_orderdate") + F.month("o_orderdate") / F.lit(12.0)).alias("trend"))
    return weather_share(normalise_weather(o, "ts", "y", ["load", "calm"], ["trend"], cell=F.month("ts"), kind="linear")).withColumns({c: F.round(c, 2) for c in ("observed_slope", "normalised_slope")})


@query()
def weather_normalised(spark, d):
    from aerolith.operators.models import normalise_weather

    h = hours(spark, d).withColumn("wind", (F.hour("ts") * 7 % 11).cast("double")).withColumn("heat", F.col("value") % 13).withColumn("trend", F.dayofyear("ts").cast("double"))
    return normalise_weather(h, "ts", "value", ["wind", "heat"], ["trend"])
