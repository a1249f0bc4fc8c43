"""Panels over years, scores, folds, deltas, health grids and conditional probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import GRID, HOURS, grid, hours
from aerolith.operators import panels, scores

_YEARS = "years AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) / 10000 AS value FROM orders GROUP BY 1, 2)"


def _years(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 10000).alias("value"))


@query("""WITH a AS (SELECT event_type, CAST(year(ts) AS INTEGER) AS year, round(avg(value), 6) AS mean, max(value) AS max, count(value) AS days, count(*) FILTER (value > 200) AS exceedances FROM events GROUP BY 1, 2),
 b AS (SELECT *, round(days / dayofyear(make_date(CAST(year AS BIGINT), 12, 31))::DOUBLE, 6) AS coverage, days / dayofyear(make_date(CAST(year AS BIGINT), 12, 31))::DOUBLE >= 0.75 AS comparable FROM a)
 SELECT *, CASE WHEN comparable THEN rank() OVER (PARTITION BY year, comparable ORDER BY mean DESC) END AS rank FROM b""")
def annual_ranked(spark, d):
    return panels.annual(table(spark, d, "events"), "event_type", "ts", "value", 200.0)


@query(f"""WITH {_YEARS}, s(start) AS (VALUES (1995), (1997), (1999)), f AS (SELECT start, entity, count(*) AS n FROM years, s WHERE year >= start AND year <= 2000 GROUP BY 1, 2 HAVING count(*) = 2000 - start + 1)
 SELECT CAST(start AS INTEGER) AS start, count(*) AS entities, CAST(sum(n) AS BIGINT) AS entity_years FROM f GROUP BY 1""")
def balanced_options(spark, d):
    return panels.balanced_options(_years(spark, d), "entity", "year", 2000, [1995, 1997, 1999])


@query(f"""WITH {_YEARS}, s(start) AS (VALUES (1995), (1996), (1997), (1998), (1999)), f AS (SELECT start, entity, count(*) AS n FROM years, s WHERE year >= start AND year <= 2000 GROUP BY 1, 2 HAVING count(*) = 2000 - start + 1)
 SELECT CAST(start AS INTEGER) AS start, count(*) AS entities, CAST(sum(n) AS BIGINT) AS entity_years FROM f GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1""")
def balanced_choice(spark, d):
    return panels.choose_start(panels.balanced_options(_years(spark, d), "entity", "year", 2000, [1995, 1996, 1997, 1998, 1999]))


@query(f"""WITH {_YEARS}, p AS (SELECT * FROM years WHERE year BETWEEN 1996 AND 1999), f AS (SELECT entity FROM p GROUP BY 1 HAVING count(DISTINCT year) = 4)
 SELECT year, count(*) AS n_all, round(avg(value), 6) AS mean_all, count(f.entity) AS n_balanced, round(avg(value) FILTER (f.entity IS NOT NULL), 6) AS mean_balanced FROM p LEFT JOIN f USING (entity) GROUP BY 1""")
def national_trend(spark, d):
    return panels.national_trend(_years(spark, d), "entity", "year", "value", 1996, 1999)


@query(f"WITH {_YEARS} SELECT c_mktsegment, year, count(*) AS entities, round(avg(value), 6) AS mean FROM years JOIN customer ON entity = c_custkey GROUP BY 1, 2")
def trend_by_group(spark, d):
    y = _years(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment"), "entity")
    return panels.trend_by_group(y, "c_mktsegment", "year", "value")


_FUNCTIONS = "fn(function, bound, beta, counterfactual) AS (VALUES ('all', 'mid', 0.008::DOUBLE, 5.0::DOUBLE), ('all', 'high', 0.012, 5.0), ('heart', 'mid', 0.015, 2.4))"


def _functions(spark):
    return spark.sql("SELECT * FROM VALUES ('all', 'mid', 0.008D, 5.0D), ('all', 'high', 0.012D, 5.0D), ('heart', 'mid', 0.015D, 2.4D) AS t(function, bound, beta, counterfactual)")


@query(f"WITH {_YEARS}, {_FUNCTIONS} SELECT entity, year, function, bound, counterfactual, round((exp(beta * greatest(0.0, value - counterfactual)) - 1) / exp(beta * greatest(0.0, value - counterfactual)), 6) AS paf FROM years, fn")
def sensitivity_grid(spark, d):
    return panels.sensitivity_grid(_years(spark, d), "entity", "year", "value", _functions(spark))


@query(f"""WITH {_YEARS}, {_FUNCTIONS}, g AS (SELECT year, function, bound, counterfactual, round((exp(beta * greatest(0.0, value - counterfactual)) - 1) / exp(beta * greatest(0.0, value - counterfactual)), 6) AS paf FROM years, fn), m AS (SELECT year, function, bound, counterfactual, median(paf) AS m FROM g GROUP BY 1, 2, 3, 4)
 SELECT year, round(min(m), 6) AS low, round(median(m), 6) AS mid, round(max(m), 6) AS high, count(*) AS assumptions FROM m GROUP BY 1""")
def health_spread(spark, d):
    return panels.assumption_spread(panels.sensitivity_grid(_years(spark, d), "entity", "year", "value", _functions(spark)), "year")


_CBPF = """t AS (SELECT quantile_cont(value, 0.9) AS q FROM events), x AS (SELECT CAST(floor(((user_id * 7) % 360) / 30) * 30 AS BIGINT) AS sector, user_id % 9 AS speed, CAST(CASE WHEN user_id % 9 <= 1 THEN 0 WHEN user_id % 9 <= 4 THEN 1 ELSE 2 END AS INTEGER) AS speed_bin, value FROM events),
 g AS (SELECT sector, speed_bin, count(*) AS n, count(*) FILTER (value > q) AS n_high, CASE WHEN count(*) >= 60 THEN round(count(*) FILTER (value > q) / count(*)::DOUBLE, 6) END AS probability FROM x, t WHERE speed > 0 GROUP BY 1, 2)"""


def _winds(spark, d):
    return table(spark, d, "events").select("value", (F.col("user_id") * 7 % 360).alias("bearing"), (F.col("user_id") % 9).cast("double").alias("speed"))


@query(f"WITH {_CBPF} SELECT * FROM g")
def cbpf_grid(spark, d):
    return panels.cbpf(_winds(spark, d), "speed", "bearing", "value", 0.9, 30.0, [1, 4], 60)


@query(f"WITH {_CBPF} SELECT (SELECT count(*) FROM x) AS n_hours, (SELECT count(*) FROM x WHERE speed = 0) AS n_calm, count(*) FILTER (probability IS NULL) AS n_suppressed, (SELECT sector FROM g WHERE probability IS NOT NULL ORDER BY probability DESC, sector, speed_bin LIMIT 1) AS peak_sector, (SELECT speed_bin FROM g WHERE probability IS NOT NULL ORDER BY probability DESC, sector, speed_bin LIMIT 1) AS peak_speed FROM g")
def cbpf_summary(spark, d):
    return panels.cbpf_summary(_winds(spark, d), panels.cbpf(_winds(spark, d), "speed", "bearing", "value", 0.9, 30.0, [1, 4], 60), "speed", "bearing", "value")


@query("""SELECT event_type, round(sqrt(pow(sum(value * cos(radians(user_id % 360))) / sum(value), 2) + pow(sum(value * sin(radians(user_id % 360))) / sum(value), 2)), 6) AS concentration FROM events GROUP BY 1""")
def directional_concentration(spark, d):
    from aerolith.functions.maths import weighted_resultant

    return table(spark, d, "events").groupBy("event_type").agg(F.round(weighted_resultant(F.col("user_id") % 360, F.col("value")), 6).alias("concentration"))


_PERSIST = f"{GRID}, p AS (SELECT entity, ts, value, lag(value) OVER (PARTITION BY entity ORDER BY ts) AS predicted FROM grid)"
_METRICS = """count(*) AS n, round(sqrt(avg((predicted - value) * (predicted - value))), 6) AS rmse, round(avg(abs(predicted - value)), 6) AS mae, round(CASE WHEN var_pop(value) > 0 THEN 1 - sum((predicted - value) * (predicted - value)) / (var_pop(value) * count(*)) END, 6) AS r2,
 round(2.0 * count(*) FILTER (value > 250 AND predicted > 250) / nullif(count(*) FILTER (predicted > 250) + count(*) FILTER (value > 250), 0), 6) AS f1"""


@query(f"WITH {_PERSIST} SELECT entity, {_METRICS} FROM p WHERE value IS NOT NULL AND predicted IS NOT NULL GROUP BY 1")
def persistence_metrics(spark, d):
    return scores.metrics(scores.persistence(grid(spark, d), ["entity"], "ts", "value"), ["entity"], "value", "predicted", 250.0)


_CLIMATE = f"""{HOURS}, tr AS (SELECT * FROM hours WHERE ts < TIMESTAMP '2024-01-20'), te AS (SELECT * FROM hours WHERE ts >= TIMESTAMP '2024-01-20'), c AS (SELECT entity, month(ts) AS m, hour(ts) AS h, avg(value) AS v FROM tr GROUP BY 1, 2, 3),
 q AS (SELECT te.entity, te.ts, te.value, coalesce(c.v, (SELECT avg(value) FROM tr)) AS predicted FROM te LEFT JOIN c ON c.entity = te.entity AND c.m = month(te.ts) AND c.h = hour(te.ts))"""


@query(f"WITH {_CLIMATE} SELECT entity, ts, value, round(predicted + 1e-7, 3) AS predicted FROM q")
def climatology(spark, d):
    h = hours(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return scores.climatology(h.where(F.col("ts") < cut), h.where(F.col("ts") >= cut), ["entity"], "ts", "value").select("entity", "ts", "value", F.round(F.col("predicted") + 1e-7, 3).alias("predicted"))


@query(f"""WITH {_CLIMATE}, b AS (SELECT entity, ts, value, lag(value) OVER (PARTITION BY entity ORDER BY ts) AS predicted FROM hours), m AS (SELECT entity, 'climatology' AS model, round(sqrt(avg((predicted - value) * (predicted - value))), 6) AS rmse FROM q GROUP BY 1 UNION ALL SELECT entity, 'persistence', round(sqrt(avg((predicted - value) * (predicted - value))), 6) FROM b WHERE ts >= TIMESTAMP '2024-01-20' AND predicted IS NOT NULL GROUP BY 1)
 SELECT entity, round(1 - max(rmse) FILTER (model = 'climatology') / max(rmse) FILTER (model = 'persistence'), 6) AS skill FROM m GROUP BY 1""")
def skill_against_persistence(spark, d):
    h = hours(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    late = F.col("ts") >= cut
    c = scores.metrics(scores.climatology(h.where(~late), h.where(late), ["entity"], "ts", "value"), ["entity"], "value", "predicted", 250.0)
    p = scores.metrics(scores.persistence(h, ["entity"], "ts", "value").where(late), ["entity"], "value", "predicted", 250.0)
    both = c.withColumn("model", F.lit("climatology")).unionByName(p.withColumn("model", F.lit("persistence")))
    return scores.skill(both, ["entity"], "climatology", "persistence")


@query("SELECT s_suppkey, s_nationkey, CAST((row_number() OVER (ORDER BY s_nationkey NULLS LAST, s_suppkey) - 1) % 5 AS BIGINT) AS fold FROM supplier")
def station_folds(spark, d):
    return scores.station_folds(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", 5)


@query("SELECT t.event_type AS fold, CASE WHEN e.event_type = t.event_type THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM events e, (SELECT DISTINCT event_type FROM events) t GROUP BY 1, 2")
def leave_one_out(spark, d):
    return scores.held_out_sums(table(spark, d, "events"), "event_type", {})


@query("""WITH c(fold, a, b) AS (VALUES (0, TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-17'), (1, TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-24')) SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN ts < a THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM events, c WHERE ts < b GROUP BY 1, 2""")
def time_folds(spark, d):
    c = spark.sql("SELECT * FROM VALUES (0, timestamp_ntz'2024-01-10', timestamp_ntz'2024-01-17'), (1, timestamp_ntz'2024-01-17', timestamp_ntz'2024-01-24') AS t(fold, test_from, test_to)")
    return scores.time_folds(table(spark, d, "events").select("ts"), "ts", c).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)) AS never, (SELECT count(*) FROM (SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 250000 GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def tested_once(spark, d):
    test = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return scores.tested_once(test, table(spark, d, "customer"), ["c_custkey"])


_SCORES = "sc AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'base' ELSE 'full' END AS variant, round(sqrt(avg(value * value)), 6) AS rmse, round(avg(value) / 500, 6) AS r2 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)"


def _scores(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return e.groupBy("user_id", F.when(F.col("event_type") == "click", "base").otherwise("full").alias("variant")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rmse"), F.round(F.avg("value") / 500, 6).alias("r2"))


_DELTAS = "dl AS (SELECT user_id, round(max(rmse) FILTER (variant = 'full') - max(rmse) FILTER (variant = 'base'), 6) AS d_rmse, round(max(r2) FILTER (variant = 'full') - max(r2) FILTER (variant = 'base'), 6) AS d_r2 FROM sc GROUP BY 1)"


@query(f"WITH {_SCORES}, {_DELTAS} SELECT * FROM dl")
def paired_deltas(spark, d):
    return scores.paired_deltas(_scores(spark, d), ["user_id"], "variant", "base", "full", ["rmse", "r2"])


@query(f"""WITH {_SCORES}, {_DELTAS} SELECT CAST(user_id % 3 AS BIGINT) AS part, count(*) AS folds, count(*) FILTER (d_rmse < 0 AND d_r2 > 0) AS both_improved, count(*) FILTER (d_rmse > 0 AND d_r2 < 0) AS both_worse, count(*) FILTER (d_rmse = 0 AND d_r2 = 0) AS ties,
 count(*) FILTER (NOT (d_rmse < 0 AND d_r2 > 0) AND NOT (d_rmse > 0 AND d_r2 < 0) AND NOT (d_rmse = 0 AND d_r2 = 0)) AS mixed, round(median(d_rmse), 5) AS median_d_rmse, round(median(d_r2), 5) AS median_d_r2 FROM dl GROUP BY 1""")
def delta_summary(spark, d):
    deltas = scores.paired_deltas(_scores(spark, d), ["user_id"], "variant", "base", "full", ["rmse", "r2"]).withColumn("part", F.col("user_id") % 3)
    out = scores.delta_summary(deltas, ["part"], "d_rmse", "d_r2")
    return out.withColumns({c: F.round(c, 5) for c in ("median_d_rmse", "median_d_r2")})


@query(f"WITH {_SCORES}, {_DELTAS} SELECT CAST(user_id % 5 AS BIGINT) AS part, count(d_r2) AS splits, round(avg(d_r2), 6) AS mean, min(d_r2) AS worst, count(*) FILTER (d_r2 <= 0) AS not_beating FROM dl GROUP BY 1")
def score_summary(spark, d):
    deltas = scores.paired_deltas(_scores(spark, d), ["user_id"], "variant", "base", "full", ["rmse", "r2"]).withColumn("part", F.col("user_id") % 5)
    return scores.summary(deltas, ["part"], "d_r2")
