"""Audits, ledgers, designs and event windows over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import GRID, HOURS, draw_sql, fit_sql, grid, hours, placed
from aerolith.catalog.joins import _ISLANDS, scored
from aerolith.catalog.statistics import _EDGES
from aerolith.operators import audits, windows


@query(f"""WITH {_ISLANDS}, q AS (SELECT s4.*, s.n AS cn, hour(s4.ts) AS h FROM s4 JOIN s USING (entity, ts)), c AS (SELECT entity, h, max(cn) AS n FROM q WHERE z IS NOT NULL GROUP BY 1, 2)
 SELECT q.entity, count(z) AS scored, count(*) FILTER (ex) AS excursions, round(count(*) FILTER (ex) / nullif(count(z), 0)::DOUBLE, 6) AS rate, (SELECT CAST(median(n) AS DOUBLE) FROM c WHERE c.entity = q.entity) AS median_cell FROM q GROUP BY 1""")
def exceedance_rates(spark, d):
    return audits.exceedance_rates(scored(spark, d), ["entity"], ["entity", "hour"])


@query(f"""WITH {_ISLANDS}, q AS (SELECT entity, CASE WHEN s2.n < 30 THEN 'small_cell' WHEN mad = 0 THEN 'no_spread' END AS unscored, abs(value - m) AS dev FROM s2) SELECT entity, unscored, count(*) AS hours, round(max(dev), 6) AS max_deviation, round(median(dev), 6) AS median_deviation FROM q WHERE unscored IS NOT NULL GROUP BY 1, 2""")
def unscored_deviation(spark, d):
    h = hours(spark, d).withColumn("hour", F.hour("ts"))
    return audits.unscored_deviation(windows.robust_scores(h, ["entity", "hour"], "value", least=30), ["entity"])


@query("""WITH a AS (SELECT event_type AS k, value FROM events WHERE user_id % 5 <> 0), r AS (SELECT event_type AS k, value, user_id % 2 AS p FROM events WHERE user_id % 5 = 0), m AS (SELECT *, median(value) OVER (PARTITION BY k) AS m FROM a),
 c AS (SELECT k, any_value(m) AS m, median(abs(value - m)) AS mad, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 20 AND median(abs(value - m)) > 0), b AS (SELECT count(*) FILTER (abs(0.67449 * (value - m) / mad) >= 2.0) / count(*)::DOUBLE AS base FROM a JOIN c USING (k))
 SELECT k, p, count(*) AS rejected, count(m) AS scored, count(*) FILTER (abs(0.67449 * (value - m) / mad) >= 2.0) AS extreme, round(count(*) FILTER (abs(0.67449 * (value - m) / mad) >= 2.0) / count(m)::DOUBLE, 6) AS rate, round(count(*) FILTER (abs(0.67449 * (value - m) / mad) >= 2.0) / count(m)::DOUBLE / any_value(base), 4) AS lift FROM r LEFT JOIN c USING (k), b GROUP BY 1, 2""")
def agency_agreement(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), "value", "user_id", (F.col("user_id") % 2).alias("p"))
    return audits.agency_agreement(e.where("user_id % 5 = 0"), e.where("user_id % 5 <> 0"), ["k"], "value", ["k", "p"], threshold=2.0)


@query(f"""WITH {HOURS}, b AS (SELECT entity, ts, floor(value / 100) AS v, value % 7 < 1 AS rejected FROM hours), k AS (SELECT *, lag(v) OVER w AS p, lag(ts) OVER w AS pt FROM b WINDOW w AS (PARTITION BY entity ORDER BY ts)),
 i AS (SELECT *, sum(CASE WHEN v = p AND ts - pt = INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM k), r AS (SELECT count(*) AS length, min(v) = 0 AS at_zero, avg(rejected::INT) AS rejected FROM i GROUP BY entity, run)
 SELECT CAST(CASE WHEN length <= 1 THEN 0 WHEN length <= 3 THEN 1 ELSE 2 END AS INTEGER) AS bucket, at_zero, count(*) AS runs, CAST(sum(length) AS BIGINT) AS hours, round(avg(rejected), 6) AS rejected_share FROM r GROUP BY 1, 2""")
def calibration_curve(spark, d):
    """Rejected share by length over all runs of an unchanging value, single hours included."""
    h = hours(spark, d).withColumn("rejected", F.col("value") % 7 < 1).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    runs = windows.stuck_runs(h, ["entity"], "ts", "value", least=1, rejected=F.col("rejected"))
    return audits.calibration_curve(runs, "length", "rejected_share", [1, 3], F.col("at_zero"))


@query(f"WITH {HOURS}, w AS (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (entity = 'click') AS click, avg(value) FILTER (entity = 'view') AS view FROM hours GROUP BY 1) SELECT day, round(click + 1e-7, 4) AS click, round(view + 1e-7, 4) AS view FROM w WHERE click IS NOT NULL AND view IS NOT NULL")
def complete_panel(spark, d):
    h = hours(spark, d).withColumn("day", F.to_date("ts"))
    return audits.complete_panel(h, ["day"], "entity", ["click", "view"], "value").select("day", F.round(F.col("click") + 1e-7, 4).alias("click"), F.round(F.col("view") + 1e-7, 4).alias("view"))


@query("SELECT event_type, hour(ts) < 12 AS morning, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(corr(value, user_id), 6) AS corr FROM events GROUP BY 1, 2")
def association_context(spark, d):
    e = table(spark, d, "events").withColumn("morning", F.hour("ts") < 12).withColumn("u", F.col("user_id").cast("double"))
    return audits.association_context(e, ["event_type", "morning"], "value", "u")


@query("""WITH p AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 90 END AS lat, CASE WHEN user_id % 3 = 0 THEN event_id % 2 ELSE 7 END AS lon FROM events) SELECT user_id, count(*) AS rows, count(lat) AS valid_rows, count(DISTINCT CASE WHEN lat IS NOT NULL THEN (lon, lat) END) AS places,
 CASE WHEN count(lat) = 0 THEN 'unplaced' WHEN count(DISTINCT CASE WHEN lat IS NOT NULL THEN (lon, lat) END) = 1 THEN 'fixed' ELSE 'moved' END AS state FROM p GROUP BY 1""")
def device_locations(spark, d):
    p = table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 90).alias("lat"), F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 2).otherwise(7).alias("lon"))
    return audits.locations(p, "user_id", "lon", "lat", F.col("lat").isNotNull())


@query("SELECT o_custkey, CAST(o_custkey % 11 AS DOUBLE) AS truth, round(avg(o_totalprice) + 1e-7, 4) AS predicted, count(*) AS n FROM orders GROUP BY 1")
def collapse_predictions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 11).cast("double").alias("truth"), F.col("o_totalprice").alias("predicted"))
    return audits.collapse_predictions(o, ["o_custkey"], "truth", "predicted").withColumn("predicted", F.round(F.col("predicted") + 1e-7, 4))


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS rows, count(*) FILTER (click IS NOT NULL AND view IS NOT NULL) AS complete, count(*) FILTER (click IS NULL) AS lacks_click, count(*) FILTER (view IS NULL) AS lacks_view FROM w GROUP BY 1""")
def coverage_ledger(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).pivot("event_type", ["click", "view"]).agg(F.max("value"))
    return audits.coverage_ledger(w, ["user_id"], ["click", "view"])


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'analysed' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) THEN 'no_target' ELSE 'incomplete' END AS reason FROM customer""")
def station_scope(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return audits.scope(table(spark, d, "customer"), o.where("o_totalprice > 100000"), o.where("o_totalprice > 300000"), "c_custkey")


@query(f"""WITH {HOURS}, e AS (SELECT DISTINCT entity FROM hours), g AS (SELECT entity, unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-05 23:00:00', INTERVAL 1 HOUR)) AS ts FROM e) SELECT g.entity, g.ts FROM g LEFT JOIN hours h USING (entity, ts) WHERE h.value IS NULL""")
def missing_expected(spark, d):
    h = hours(spark, d)
    return audits.missing_expected(h, h, "entity", "ts", "2024-01-03", "2024-01-06")


@query("""WITH r AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT l_returnflag, coalesce(r.n, 0) AS rows_found, coalesce(t.n, 0) AS rows_told FROM r FULL JOIN t USING (l_returnflag) WHERE coalesce(r.n, 0) <> coalesce(t.n, 0)""")
def ledger_mismatch(spark, d):
    li = table(spark, d, "lineitem")
    told = li.where("l_linestatus = 'F'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("nulls"))
    return audits.reconcile_ledgers(li, told, ["l_returnflag"], "l_tax")


@query("SELECT event_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS weight FROM events")
def inverse_cluster_weight(spark, d):
    return audits.inverse_cluster_weight(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"]).select("event_id", "weight")


@query("""WITH x AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS sf, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders), s(s) AS (VALUES (0), (1), (2), (3), (4)), k(k) AS (VALUES (1), (2), (3), (4)),
 f AS (SELECT 'station' AS design, s AS hs, CAST(NULL AS INTEGER) AS hq FROM s UNION ALL SELECT 'quarter', NULL, k FROM k UNION ALL SELECT 'joint', s, k FROM s, k),
 r AS (SELECT design, hs, hq, CASE WHEN (hs IS NULL OR sf = hs) AND (hq IS NULL OR q = hq) THEN 'test' WHEN design <> 'joint' OR (sf <> hs AND q <> hq) THEN 'train' ELSE 'excluded' END AS role FROM x, f)
 SELECT design, hs AS held_station_fold, hq AS held_quarter, role, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def held_out_design(spark, d):
    x = table(spark, d, "orders").select((F.col("o_custkey") % 5).cast("int").alias("sf"), F.quarter("o_orderdate").alias("q"))
    return audits.held_out_design(x, "sf", "q", 5).groupBy("design", "held_station_fold", "held_quarter", "role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat_ws('|', o_orderkey, 0)), o_orderkey LIMIT 100")
def hashed_sample(spark, d):
    return audits.sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query("""WITH k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS t FROM supplier) SELECT s_suppkey FROM k WHERE t <= 7 OR (i % greatest(t // 7, 1) = 0 AND i // greatest(t // 7, 1) < 7)""")
def evenly_spread(spark, d):
    return audits.spread(table(spark, d, "supplier"), "s_suppkey", 7)


@query("""WITH ev(name, s, e) AS (VALUES ('first', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12'), ('second', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-21')) SELECT name, count(*) FILTER (ts < s) AS n_before, count(*) FILTER (ts >= e) AS n_after, round(avg(value) FILTER (ts < s), 6) AS mean_before, round(avg(value) FILTER (ts >= e), 6) AS mean_after FROM events JOIN ev ON (ts >= s - INTERVAL 3 DAY AND ts < s) OR (ts >= e AND ts < e + INTERVAL 3 DAY) GROUP BY 1""")
def event_windows(spark, d):
    ev = spark.sql("SELECT * FROM VALUES ('first', timestamp_ntz'2024-01-10', timestamp_ntz'2024-01-12'), ('second', timestamp_ntz'2024-01-20', timestamp_ntz'2024-01-21') AS t(name, start, end)")
    return audits.event_windows(table(spark, d, "events"), ev, "ts", "value", 3)


@query("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT CAST(year(day) AS INTEGER) AS year, count(*) FILTER (dayofyear(day) BETWEEN 60 AND 79) AS n, avg(v) FILTER (dayofyear(day) BETWEEN 60 AND 79) - avg(v) FILTER (dayofyear(day) BETWEEN 40 AND 59) AS change FROM p GROUP BY 1) SELECT year, n, round(change, 2) AS change FROM c WHERE change IS NOT NULL""")
def placebo_years(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"))
    return audits.placebos(days, "day", "v", 60, 20).withColumn("change", F.round("change", 2))


@query("""WITH p AS (SELECT c_custkey, CAST((c_custkey * 37) % 1200 AS DOUBLE) / 100.0 + 20.0 AS lat, CAST((c_custkey * 91) % 1500 AS DOUBLE) / 100.0 + 110.0 AS lon FROM customer), g AS (SELECT DISTINCT CAST(20 + s_suppkey % 12 AS DOUBLE) AS lat, CAST(110 + s_suppkey % 15 AS DOUBLE) AS lon FROM supplier),
 y AS (SELECT c_custkey, g.lat AS v, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(g.lat - p.lat), g.lat) AS n FROM p, (SELECT DISTINCT lat FROM g) g), x AS (SELECT c_custkey, g.lon AS v, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(g.lon - p.lon), g.lon) AS n FROM p, (SELECT DISTINCT lon FROM g) g)
 SELECT c_custkey, y.v AS cell_lat, x.v AS cell_lon FROM y JOIN x USING (c_custkey) WHERE y.n = 1 AND x.n = 1""")
def nearest_cell(spark, d):
    cells = table(spark, d, "supplier").select((20 + F.col("s_suppkey") % 12).cast("double").alias("lat"), (110 + F.col("s_suppkey") % 15).cast("double").alias("lon"))
    return audits.nearest_cell(placed(table(spark, d, "customer"), "c_custkey"), cells, "c_custkey")


_PRICES = "base AS (SELECT 0 AS g, 1.0::DOUBLE AS w, l_suppkey AS c, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem)"


@query(f"""WITH {_PRICES}, {fit_sql('base', 2)}, e AS (SELECT c, n, k0, k1, k2, rss, i11 * (x1 - m1) + i12 * (x2 - m2) AS a1, i12 * (x1 - m1) + i22 * (x2 - m2) AS a2, m1, m2, y - k0 - k1 * x1 - k2 * x2 AS e FROM base JOIN fit USING (g)),
 z AS (SELECT *, 1 / n - m1 * a1 - m2 * a2 AS a0 FROM e), s AS (SELECT c, sum(a0 * e) AS s0, sum(a1 * e) AS s1, sum(a2 * e) AS s2 FROM z GROUP BY 1), v AS (SELECT sqrt(sum(s0 * s0)) AS c0, sqrt(sum(s1 * s1)) AS c1, sqrt(sum(s2 * s2)) AS c2 FROM s),
 i AS (SELECT any_value(k0) AS k0, any_value(k1) AS k1, any_value(k2) AS k2, any_value(rss) / (any_value(n) - 3) AS q, sum(a0 * a0) AS v0, sum(a1 * a1) AS v1, sum(a2 * a2) AS v2 FROM z)
 SELECT 'intercept' AS term, round(k0, 2) AS coef, round(k0 / sqrt(q * v0), 3) AS t_iid, round(k0 / c0, 3) AS t_cluster FROM i, v UNION ALL SELECT 'l_quantity', round(k1, 2), round(k1 / sqrt(q * v1), 3), round(k1 / c1, 3) FROM i, v UNION ALL SELECT 'l_discount', round(k2, 2), round(k2 / sqrt(q * v2), 3), round(k2 / c2, 3) FROM i, v""")
def clustered_errors(spark, d):
    out = audits.clustered_errors(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey")
    return out.select("term", F.round("coef", 2).alias("coef"), F.round("t_iid", 3).alias("t_iid"), F.round("t_cluster", 3).alias("t_cluster"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def page_titles(spark, d):
    """The catalogue parser's work on the given pages: labelled fields out of HTML text."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.octet_length("html").cast("long").alias("bytes"))


@query(f"""WITH base AS (SELECT 0 AS g, 1.0::DOUBLE AS w, value AS y, sin(radians(user_id)) AS x1, cos(radians(user_id)) AS x2 FROM events), {fit_sql('base', 2)} SELECT (SELECT round(regr_r2(value, user_id), 6) FROM events) AS r2_raw, round(1 - rss / yy, 6) AS r2_encoded FROM fit""")
def encoding_gain(spark, d):
    from aerolith.operators import pitfalls

    return pitfalls.encoding_gain(table(spark, d, "events"), "value", "user_id").select(F.round("r2_raw", 6).alias("r2_raw"), F.round("r2_encoded", 6).alias("r2_encoded"))


_POISSON = " + ".join(f"(u > {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r})::INT" for k in range(6))


@query(f"""WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 4 AS fold, l_extendedprice AS y, l_quantity AS q, l_tax AS t, l_discount AS d FROM lineitem),
 one AS (SELECT 0 AS g, 1.0::DOUBLE AS w, y, d AS x1 FROM li), {fit_sql('one', 1, 'f1')}, two AS (SELECT 0 AS g, 1.0::DOUBLE AS w, y, d AS x1, q AS x2 FROM li), {fit_sql('two', 2, 'f2')},
 seen AS (SELECT f.fold AS g, 1.0::DOUBLE AS w, y, q AS x1, t AS x2 FROM li JOIN (SELECT DISTINCT fold FROM li) f ON li.fold <> f.fold), {fit_sql('seen', 2, 'f3')},
 opt AS (SELECT g, any_value(1 - rss / yy) - (1 - sum(pow(y - k0 - k1 * q - k2 * t, 2)) / (var_pop(y) * count(*))) AS v FROM li JOIN f3 ON li.fold = f3.g GROUP BY g),
 drawn AS (SELECT s AS g, y, q AS x1, t AS x2, {draw_sql('l_orderkey', 'l_linenumber', 'l_partkey', '1000 + s')} AS u FROM li, (SELECT unnest(range(0, 20)) AS s)), boot AS (SELECT *, ({_POISSON})::DOUBLE AS w FROM drawn), {fit_sql('boot', 2, 'f4')},
 signs AS (SELECT 'intercept' AS of, avg((k0 > 0)::INT) AS a, avg((k0 < 0)::INT) AS b FROM f4 UNION ALL SELECT 'l_quantity', avg((k1 > 0)::INT), avg((k1 < 0)::INT) FROM f4 UNION ALL SELECT 'l_tax', avg((k2 > 0)::INT), avg((k2 < 0)::INT) FROM f4)
 SELECT 'leak_share' AS what, CAST(NULL AS VARCHAR) AS of, round((1 - f2.rss / f2.yy - (1 - f1.rss / f1.yy)) / (1 - f2.rss / f2.yy), 5) AS value FROM f1, f2 UNION ALL SELECT 'optimism', CAST(g AS VARCHAR), round(v, 5) FROM opt UNION ALL SELECT 'same_sign', of, round(greatest(a, b), 5) FROM signs""")
def regression_pitfalls(spark, d):
    """Leakage, optimism and sign stability on lineitem, one row each term or fold."""
    from aerolith.operators import pitfalls

    li = table(spark, d, "lineitem").withColumn("fold", F.col("l_orderkey") % 4)
    leak = pitfalls.leakage_price(li, "l_extendedprice", ["l_discount"], "l_quantity").select(F.lit("leak_share").alias("what"), F.lit(None).cast("string").alias("of"), F.col("leak_share").alias("value"))
    opt = pitfalls.optimism(li, "l_extendedprice", ["l_quantity", "l_tax"], "fold").select(F.lit("optimism").alias("what"), F.col("fold").cast("string").alias("of"), (F.col("r2_in") - F.col("r2_out")).alias("value"))
    sign = pitfalls.sign_stability(li, "l_extendedprice", ["l_quantity", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"]).select(F.lit("same_sign").alias("what"), F.col("term").alias("of"), F.col("same_sign").alias("value"))
    return leak.unionByName(opt).unionByName(sign).withColumn("value", F.round("value", 5))


@query("""WITH f AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1), e AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 0) SELECT coalesce(f.k, e.k) AS k, coalesce(n, 0) AS rows, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'present' END AS state FROM f FULL JOIN e ON f.k = e.k""")
def key_ledger(spark, d):
    from aerolith.sources.imports import key_ledger as ledger

    found = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return ledger(found, table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("k")), ["k"])


@query("""WITH x AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), d AS (SELECT DISTINCT c, y FROM x), p AS (SELECT a.c, a.y AS train_year, b.y AS test_year FROM d a JOIN d b ON a.c = b.c AND a.y < b.y)
 SELECT train_year, test_year, CASE WHEN y = train_year THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM x JOIN p USING (c) WHERE y = train_year OR y = test_year GROUP BY 1, 2, 3""")
def transfer_folds(spark, d):
    from aerolith.operators.scores import transfer_folds as folds

    x = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"))
    return folds(x, "c", "y").groupBy("train_year", "test_year", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HOURS}, e AS (SELECT DISTINCT entity FROM hours) SELECT a.entity, b.entity AS neighbour, count(*) AS n, round(1 - corr(a.value, b.value), 6) AS dissimilarity FROM hours a JOIN hours b ON a.ts = b.ts AND a.entity <> b.entity GROUP BY 1, 2""")
def series_dissimilarity(spark, d):
    from aerolith.operators.stats import dissimilarity

    h = hours(spark, d)
    names = h.select("entity").distinct()
    edges = names.crossJoin(names.withColumnRenamed("entity", "neighbour")).where("entity <> neighbour")
    return dissimilarity(h, edges, "entity", "neighbour", "ts", "value")


@query(f"""WITH {_EDGES}, d AS (SELECT unnest(range(0, 100)) AS draw), sp AS (SELECT draw, s_suppkey AS k, row_number() OVER (PARTITION BY draw ORDER BY s_suppkey) AS i FROM supplier, d),
 sh AS (SELECT draw, s_acctbal AS v, row_number() OVER (PARTITION BY draw ORDER BY CASE WHEN draw = 0 THEN '' ELSE md5(concat_ws('|', s_suppkey, draw, 1)) END, s_suppkey) AS i FROM supplier, d),
 z AS (SELECT draw, k, v - avg(v) OVER (PARTITION BY draw) AS z FROM sp JOIN sh USING (draw, i)), s AS (SELECT draw, count(*)::DOUBLE AS n, sum(z * z) AS v FROM z GROUP BY 1),
 c AS (SELECT a.draw, sum(weight * a.z * b.z) AS c, sum(weight) AS w FROM ew JOIN z a ON a.k = ew.k JOIN z b ON b.k = ew.nb AND b.draw = a.draw GROUP BY 1), m AS (SELECT draw, round(n / w * c / v, 6) AS i FROM s JOIN c USING (draw)), r AS (SELECT i AS real FROM m WHERE draw = 0)
 SELECT real AS moran_i, round(avg(i), 6) AS null_mean, (count(*) FILTER (abs(i) >= abs(real)) + 1) / (count(*) + 1)::DOUBLE AS p FROM m, r WHERE draw > 0 GROUP BY 1""")
def moran_permutations(spark, d):
    from aerolith.catalog.statistics import _balances
    from aerolith.operators import networks

    return networks.moran_null(_balances(spark, d), "s_suppkey", "s_acctbal", 250.0)


@query(f"""WITH {_EDGES.replace(', ew AS', ', unused AS')}, r(radius) AS (VALUES (100.0::DOUBLE), (250.0)), ew AS (SELECT radius, k, nb, 1.0::DOUBLE / count(*) OVER (PARTITION BY radius, k) AS weight FROM e JOIN r ON km <= radius), m AS (SELECT avg(s_acctbal) AS m FROM supplier), z AS (SELECT s_suppkey AS k, s_acctbal - m AS z FROM supplier, m)
 SELECT r.radius, (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) / sum(weight) * sum(weight * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS moran_i FROM r LEFT JOIN ew ON ew.radius = r.radius LEFT JOIN z a ON a.k = ew.k LEFT JOIN z b ON b.k = ew.nb GROUP BY 1""")
def weights_sensitivity(spark, d):
    from aerolith.catalog.statistics import _balances
    from aerolith.operators import networks

    return networks.weights_sensitivity(_balances(spark, d), "s_suppkey", "s_acctbal", [100.0, 250.0])


@query("""WITH m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), y AS (SELECT o_orderpriority, CAST(year(month) AS INTEGER) AS year, count(v) AS months, avg(v) AS mean FROM m GROUP BY 1, 2) SELECT o_orderpriority, year, months, CASE WHEN months >= 11 THEN round(mean, 3) END AS mean FROM y""")
def years_from_months(spark, d):
    from aerolith.operators import reports

    months = table(spark, d, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "MM").alias("month")).agg(F.avg("o_totalprice").alias("v"))
    return reports.years_from_months(months, ["o_orderpriority"], "month", "v").withColumn("mean", F.round("mean", 3))


@query("""WITH p AS (SELECT DISTINCT CASE trim(' ' || c_mktsegment || '  ') WHEN 'BUILDING' THEN 'HOUSES' ELSE trim(' ' || c_mktsegment || '  ') END AS segment, 'zone-' || (c_custkey % 4 + c_nationkey % 3) || '/member' || c_custkey AS member FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment <> 'MACHINERY'),
 q AS (SELECT segment, CASE WHEN segment <> 'AUTOMOBILE' THEN regexp_extract(member, 'zone-([0-4])', 1) END AS zone, member FROM p), z AS (SELECT segment, nullif(zone, '') AS zone, count(*) AS members FROM q WHERE nullif(zone, '') IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY segment) > 1 AS ambiguous, row_number() OVER (PARTITION BY segment ORDER BY members DESC, zone) AS n FROM z)
 SELECT s.segment, coalesce(r.zone, CASE s.segment WHEN 'AUTOMOBILE' THEN 'north' END) AS zone, coalesce(ambiguous, false) AS ambiguous FROM (SELECT DISTINCT segment FROM p) s LEFT JOIN r ON r.segment = s.segment AND r.n = 1""")
def station_zones(spark, d):
    """Market segments as stations, their customers as archive members whose path names a zone."""
    from aerolith.operators import reports

    c = table(spark, d, "customer").where("c_custkey % 3 = 0 or c_mktsegment <> 'MACHINERY'").withColumn("raw", F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))
    segment = reports.normalised_name("raw", {"BUILDING": "HOUSES"})
    path = F.concat(F.lit("zone-"), (F.col("c_custkey") % 4 + F.col("c_nationkey") % 3).cast("string"), F.lit("/member"), F.col("c_custkey").cast("string"))
    members = c.select(segment.alias("segment"), F.when(segment == "AUTOMOBILE", F.regexp_replace(path, "zone-", "flat-")).otherwise(path).alias("member"))
    return reports.zones(members, "segment", "member", "zone-([0-4])", {"AUTOMOBILE": "north", "HOUSES": "never used"})


@query(f"""WITH {HOURS}, m AS (SELECT entity, strftime(ts, '%Y-%m') AS month, round(avg(value), 2) AS m FROM hours GROUP BY 1, 2), p AS (SELECT entity, month, row_number() OVER (PARTITION BY entity ORDER BY m DESC, month DESC) AS n FROM m), o AS (SELECT entity, strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b, count(*) AS h, count(value) AS k FROM hours GROUP BY 1)
 SELECT o.entity, '{{"first_day":"' || a || '","last_day":"' || b || '","hours":' || h || ',"known":' || k || ',"peak_month":"' || month || '"}}' AS card FROM o JOIN p ON p.entity = o.entity AND p.n = 1""")
def station_cards(spark, d):
    from aerolith.operators import reports

    return reports.cards(hours(spark, d), "entity", "ts", "value")


@query("""WITH k AS (SELECT l_quantity AS x, row_number() OVER (ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_quantity) AS n FROM lineitem), s(size) AS (VALUES (50), (500), (5000), (0)), x AS (SELECT size, x FROM k, s WHERE n <= size OR size = 0), m AS (SELECT size, count(*)::DOUBLE AS n, avg(x) AS m FROM x GROUP BY 1),
 c AS (SELECT size, any_value(n) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM x JOIN m USING (size) GROUP BY 1), j AS (SELECT size, n, n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM c)
 SELECT CAST(size AS INTEGER) AS size, CAST(n AS BIGINT) AS n, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p FROM j""")
def normality_fallacy(spark, d):
    from aerolith.operators import reports

    li = table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), "l_quantity")
    return reports.normality_fallacy(li, "k", "l_quantity", [50, 500, 5000, 0])


@query("""WITH f(name, train_start, train_end, test_start, test_end) AS (VALUES ('q2', TIMESTAMP '1995-01-01', TIMESTAMP '1995-04-01', TIMESTAMP '1995-04-01', TIMESTAMP '1995-07-01'), ('q3', TIMESTAMP '1995-01-01', TIMESTAMP '1995-07-01', TIMESTAMP '1995-07-01', TIMESTAMP '1995-10-01'), ('q4', TIMESTAMP '1995-01-01', TIMESTAMP '1995-10-01', TIMESTAMP '1995-10-01', TIMESTAMP '1996-01-01'))
 SELECT name AS fold, CASE WHEN o_orderdate < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS rows FROM orders, f WHERE o_orderdate >= train_start AND o_orderdate < test_end GROUP BY 1, 2""")
def annual_folds(spark, d):
    """A year's expanding quarters: each trains on the year so far."""
    from aerolith.operators.scores import time_folds

    folds = windows.annual_folds(1995)
    cuts = spark.createDataFrame([(f[0], f[3], f[4]) for f in folds], "fold string, test_from timestamp_ntz, test_to timestamp_ntz")
    year = table(spark, d, "orders").where("o_orderdate >= '1995-01-01'")
    return time_folds(year.select("o_orderdate"), "o_orderdate", cuts).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"))
