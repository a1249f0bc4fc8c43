"""Held-out designs by ridge regression, counterfactuals of events and breaks of trend, gaps hidden as they really are."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import GRID, draw_sql, fit_sql, grid
from aerolith.operators import causal, folds

_FOLDS = """f AS (SELECT 'station' AS design, CAST(s AS INTEGER) AS held_station_fold, CAST(NULL AS INTEGER) AS held_quarter FROM range(5) t(s) UNION ALL SELECT 'quarter', NULL, CAST(q AS INTEGER) FROM range(1, 5) t(q) UNION ALL SELECT 'joint', CAST(s AS INTEGER), CAST(q AS INTEGER) FROM range(5) t(s), range(1, 5) u(q))"""


@query(f"""WITH r AS (SELECT CAST(l_suppkey % 5 AS INTEGER) AS s, CAST(quarter(l_shipdate) AS INTEGER) AS q, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_suppkey, l_shipdate) AS w FROM lineitem), {_FOLDS},
 c AS (SELECT avg(y) AS cy, avg(x1) AS c1, avg(x2) AS c2 FROM r),
 t AS (SELECT design, held_station_fold, held_quarter, count(*) AS train_rows, sum(w) AS w, sum(w * (y - cy)) AS sy, sum(w * (x1 - c1)) AS s1, sum(w * (x2 - c2)) AS s2, sum(w * (x1 - c1) ** 2) AS p11, sum(w * (x2 - c2) ** 2) AS p22, sum(w * (x1 - c1) * (x2 - c2)) AS p12, sum(w * (x1 - c1) * (y - cy)) AS p1, sum(w * (x2 - c2) * (y - cy)) AS p2, max(cy) AS cy, max(c1) AS c1, max(c2) AS c2, min(y) < max(y) AS varies
  FROM r, f, c WHERE (held_station_fold IS NULL OR s <> held_station_fold) AND (held_quarter IS NULL OR q <> held_quarter) GROUP BY 1, 2, 3),
 m AS (SELECT *, p11 - s1 * s1 / w AS v11, p22 - s2 * s2 / w AS v22, p12 - s1 * s2 / w AS v12, p1 - s1 * sy / w AS v1, p2 - s2 * sy / w AS v2 FROM t),
 z AS (SELECT *, sqrt(v11 / w) AS d1, sqrt(v22 / w) AS d2 FROM m),
 b AS (SELECT *, v1 / d1 / (v11 / d1 / d1 + 1) / d1 AS one, ((v22 / d2 / d2 + 1) * v1 / d1 - v12 / d1 / d2 * v2 / d2) / ((v11 / d1 / d1 + 1) * (v22 / d2 / d2 + 1) - (v12 / d1 / d2) ** 2) / d1 AS two1, ((v11 / d1 / d1 + 1) * v2 / d2 - v12 / d1 / d2 * v1 / d1) / ((v11 / d1 / d1 + 1) * (v22 / d2 / d2 + 1) - (v12 / d1 / d2) ** 2) / d2 AS two2 FROM z),
 e AS (SELECT f.*, r.y, r.x1, r.x2, b.* EXCLUDE (design, held_station_fold, held_quarter) FROM f JOIN r ON (held_station_fold IS NULL OR r.s = held_station_fold) AND (held_quarter IS NULL OR r.q = held_quarter) JOIN b ON b.design = f.design AND b.held_station_fold IS NOT DISTINCT FROM f.held_station_fold AND b.held_quarter IS NOT DISTINCT FROM f.held_quarter),
 p AS (SELECT *, 'quantity' AS model, cy + sy / w + one * (x1 - c1 - s1 / w) AS p FROM e UNION ALL SELECT *, 'both', cy + sy / w + two1 * (x1 - c1 - s1 / w) + two2 * (x2 - c2 - s2 / w) FROM e UNION ALL SELECT *, 'raw', x1 FROM e)
 SELECT design, held_station_fold, held_quarter, 'scored' AS state, max(train_rows) AS train_rows, count(*) AS test_rows, model, round(sqrt(avg((p - y) ** 2)), 2) AS rmse, round(avg(abs(p - y)), 2) AS mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY design, held_station_fold, held_quarter, model""")
def ridge_folds(spark, d):
    """Prices by weighted ridge on quantity, and quantity and discount, in all 29 folds of suppliers, quarters and both."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("l_suppkey", "l_shipdate"))
    r = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("s"), F.quarter("l_shipdate").alias("q"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").cast("double").alias("x1"), F.col("l_discount").alias("x2"), (1.0 / n).alias("w"))
    out = folds.ridge_folds(r, "s", "q", "y", {"quantity": ["x1"], "both": ["x1", "x2"]}, "w", 5, raw="x1")
    return out.withColumns({"rmse": F.round("rmse", 2), "mae": F.round("mae", 2)})


_DAYS = "d AS (SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x1, CAST(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS DOUBLE) AS x2 FROM orders GROUP BY 1, 2)"


def _days(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("station"), day.alias("date")).agg(F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("x1"), F.max(F.datediff(day, F.lit("1992-01-01"))).cast("double").alias("x2"))


def _events(spark):
    rows = [("spring", date(1995, 3, 1), date(1995, 4, 25), date(1995, 3, 1)), ("autumn", date(1996, 9, 1), date(1996, 10, 31), date(1996, 9, 1))]
    return spark.createDataFrame(rows, "name string, start date, end date, when date")


@query(f"""WITH {_DAYS}, v(event, a, z) AS (VALUES ('spring', DATE '1995-03-01', DATE '1995-04-25'), ('autumn', DATE '1996-09-01', DATE '1996-10-31')), ys AS (SELECT CAST(min(year(date)) AS INTEGER) AS lo, CAST(max(year(date)) AS INTEGER) AS hi FROM d),
 w AS (SELECT event, 0 AS shift, a, z FROM v UNION ALL SELECT event, CAST(y - year(a) AS INTEGER), CAST(a + to_years(CAST(y - year(a) AS INTEGER)) AS DATE), CAST(a + to_years(CAST(y - year(a) AS INTEGER)) AS DATE) + CAST(z - a AS INTEGER) FROM v, (SELECT unnest(range(lo, hi + 1)) AS y FROM ys) WHERE y NOT IN (1995, 1996)),
 base AS (SELECT event || '|' || shift || '|' || station AS g, 1.0::DOUBLE AS w, y, x1, x2 FROM d, w WHERE date < a - 30 OR date > z + 30), {fit_sql('base', 2)},
 i AS (SELECT event, shift, station, date, y, k0 + k1 * x1 + k2 * x2 AS p, n FROM d JOIN w ON date BETWEEN a AND z JOIN fit ON g = event || '|' || shift || '|' || station),
 e AS (SELECT event, shift, station, count(*) AS n_days, CAST(max(n) AS BIGINT) AS train_days, avg(y) AS om, avg(p) AS pm, avg(y - p) AS effect FROM i GROUP BY 1, 2, 3), k AS (SELECT *, CASE WHEN n_days < 14 THEN 'few_days' WHEN train_days < 500 THEN 'few_training_days' END AS refusal FROM e),
 pl AS (SELECT event, station, avg(effect) AS mean, stddev_samp(effect) AS sd, count(*) AS c FROM k WHERE shift <> 0 AND refusal IS NULL GROUP BY 1, 2),
 r AS (SELECT event, station, n_days, row_number() OVER (PARTITION BY event, station ORDER BY date) - 1 AS p, y - i.p AS r FROM i JOIN k USING (event, shift, station) WHERE shift = 0 AND refusal IS NULL),
 b AS (SELECT event, station, draw, CAST(floor({draw_sql('event', 'station', 'draw', 'p // least(7, n_days)', '1')} * (n_days - least(7, n_days) + 1)) + p % least(7, n_days) AS BIGINT) AS p FROM r, range(1, 201) t(draw)),
 q AS (SELECT event, station, avg(r.r) AS m FROM b JOIN r USING (event, station, p) GROUP BY event, station, draw), ci AS (SELECT event, station, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM q GROUP BY 1, 2)
 SELECT event, station, n_days, train_days, round(om, 3) AS observed_mean, CASE WHEN refusal IS NULL THEN round(pm, 3) END AS predicted_mean, CASE WHEN refusal IS NULL THEN round(effect, 3) END AS effect, CASE WHEN refusal IS NULL THEN round(100 * effect / pm, 4) END AS effect_pct, round(lo, 3) AS ci_low, round(hi, 3) AS ci_high,
  CASE WHEN refusal IS NULL THEN round(mean, 3) END AS placebo_mean, CASE WHEN refusal IS NULL THEN round(sd, 3) END AS placebo_sd, coalesce(c, 0) AS placebo_n, CASE WHEN refusal IS NULL THEN round((effect - mean) / sd, 4) END AS z, refusal FROM k LEFT JOIN pl USING (event, station) LEFT JOIN ci USING (event, station) WHERE shift = 0""")
def counterfactual_events(spark, d):
    """Two marked spells of orders' prices against lines fitted to all other days, with placebo years and block intervals."""
    out = causal.counterfactual(_days(spark, d), "station", "date", "y", ["x1", "x2"], _events(spark))
    return out.withColumns({c: F.round(c, 3) for c in ("observed_mean", "predicted_mean", "effect", "ci_low", "ci_high", "placebo_mean", "placebo_sd")} | {c: F.round(c, 4) for c in ("effect_pct", "z")})


@query("""WITH m AS (SELECT o_orderpriority AS station, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT station, min(m) AS f, max(m) AS l, count(*) AS n FROM m GROUP BY 1 HAVING n >= 36),
 v(event, w) AS (VALUES ('spring', DATE '1995-03-01'), ('autumn', DATE '1996-09-01')), k AS (SELECT station, event, f, (w - f) / 365.25::DOUBLE AS brk, (l - f) / 365.25::DOUBLE AS y FROM s, v),
 c AS (SELECT station, event, f, true AS real, brk AS c FROM k UNION ALL SELECT station, event, f, false, c FROM (SELECT *, 1 + unnest(range(CAST(ceil((y - 2) * 4) AS BIGINT))) / 4.0::DOUBLE AS c FROM k) WHERE abs(c - brk) >= 3),
 t AS (SELECT station, event, real, c, (m - f) / 365.25::DOUBLE AS t, v FROM m JOIN c USING (station)),
 b AS (SELECT station, event, real, c, regr_slope(v, t) FILTER (t < c) AS sb, regr_slope(v, t) FILTER (t >= c) AS sa, count(*) FILTER (t < c) AS nb, count(*) FILTER (t >= c) AS na FROM t GROUP BY 1, 2, 3, 4 HAVING nb >= 12 AND na >= 12),
 p AS (SELECT station, event, avg(sa - sb) AS mean, stddev_samp(sa - sb) AS sd, count(*) AS n FROM b WHERE NOT real GROUP BY 1, 2)
 SELECT event, station, nb AS n_before, na AS n_after, coalesce(n, 0) AS placebo_n, round(sb, 3) AS slope_before, round(sa, 3) AS slope_after, round(sa - sb, 3) AS delta, CASE WHEN n >= 3 THEN round(mean, 3) END AS placebo_mean, CASE WHEN n >= 3 THEN round(sd, 3) END AS placebo_sd, CASE WHEN n >= 3 THEN round((sa - sb - mean) / sd, 4) END AS z FROM b LEFT JOIN p USING (station, event) WHERE real""")
def trend_breaks(spark, d):
    """Slopes of monthly mean prices before and after two dates, beside breaks placed elsewhere."""
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("station"), F.trunc("o_orderdate", "MM").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    out = causal.trend_breaks(m, "station", "m", "v", _events(spark))
    return out.withColumns({c: F.round(c, 3) for c in ("slope_before", "slope_after", "delta", "placebo_mean", "placebo_sd")} | {"z": F.round("z", 4)})


_GAPPY = f"""{GRID}, s AS (SELECT entity, ts, CASE WHEN hour(ts) >= (day(ts) * 7 + length(entity)) % 9 THEN value END AS value FROM grid), i AS (SELECT *, row_number() OVER w AS i, count(value) OVER (w ROWS UNBOUNDED PRECEDING) AS c, lag(value IS NULL) OVER w AS was FROM s WINDOW w AS (PARTITION BY entity ORDER BY ts)),
 n AS (SELECT *, sum(CASE WHEN was IS DISTINCT FROM (value IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM i), g AS (SELECT entity, min(ts) AS start, count(*) AS length FROM n WHERE value IS NULL GROUP BY entity, run),
 z AS (SELECT entity, count(*) AS rows, count(value) AS known FROM s GROUP BY 1), q AS (SELECT g.*, rows, 0.3::DOUBLE * known / sum(length) OVER (PARTITION BY g.entity) AS f FROM g JOIN z USING (entity)),
 k AS (SELECT * EXCLUDE (f), unnest(range(1, 1 + CAST(floor(f) AS BIGINT) + CASE WHEN {draw_sql('entity', "strftime(start, '%Y-%m-%d %H:%M:%S')", "'copies'", '1')} < f - floor(f) THEN 1 ELSE 0 END)) AS copy FROM q),
 a AS (SELECT *, 1 + CAST(floor({draw_sql('entity', "strftime(start, '%Y-%m-%d %H:%M:%S')", 'copy', 'attempt', '1')} * (rows - length + 1)) AS BIGINT) AS first FROM k, range(1, 9) t(attempt)),
 v AS (SELECT a.entity, a.start, copy, a.length, first, first + a.length - 1 AS last, row_number() OVER (PARTITION BY a.entity, a.start, copy ORDER BY attempt) AS turn FROM a JOIN i e ON e.entity = a.entity AND e.i = first + a.length - 1 LEFT JOIN i b ON b.entity = a.entity AND b.i = first - 1 WHERE e.c - coalesce(b.c, 0) = a.length),
 p0 AS (SELECT entity, start, copy, length, first, last FROM v LIMIT 0)"""


def _round_sql(k: int) -> str:
    return f"""p{k} AS (SELECT entity, start, copy, length, first, last FROM (SELECT *, coalesce(max(last) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < first AND coalesce(min(CASE WHEN fresh = 0 THEN first END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4611686018427387904) > last AS clear
  FROM (SELECT *, 0 AS fresh FROM p{k - 1} UNION ALL SELECT v.* EXCLUDE (turn), 1 FROM v ANTI JOIN p{k - 1} USING (entity, start, copy) WHERE turn = {k}) WINDOW o AS (PARTITION BY entity ORDER BY first, fresh, start, copy)) WHERE fresh = 0 OR clear)"""


@query(f"""WITH {_GAPPY}, {', '.join(map(_round_sql, (1, 2, 3)))}, h AS (SELECT entity, length, unnest(range(first, last + 1)) AS i FROM p3), m AS (SELECT i.entity, i.ts, i.i, CASE WHEN h.i IS NULL THEN i.value END AS value, CASE WHEN h.i IS NOT NULL THEN i.value END AS truth, length FROM i LEFT JOIN h ON h.entity = i.entity AND h.i = i.i),
 x AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM m WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 y AS (SELECT *, CASE WHEN value IS NULL AND i1 - i0 - 1 <= 6 THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) ELSE value END AS filled FROM x WHERE truth IS NOT NULL)
 SELECT entity, CAST(CASE WHEN length <= 1 THEN 0 WHEN length <= 3 THEN 1 WHEN length <= 6 THEN 2 ELSE 3 END AS INTEGER) AS bucket, count(*) AS hidden, round(avg(CASE WHEN filled IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recovered, round(avg(abs(filled - truth)), 4) AS mae, round(sqrt(avg((filled - truth) ** 2)), 4) AS rmse FROM y GROUP BY 1, 2""")
def gap_bucket_errors(spark, d):
    """Linear filling of up to six hours, scored on runs hidden like the series' own gaps, by their length."""
    from aerolith.functions.maths import right_closed
    from aerolith.operators import gapfill, windows

    s = grid(spark, d).withColumn("value", F.when(F.hour("ts") >= (F.day("ts") * 7 + F.length("entity")) % 9, F.col("value")))
    masked = gapfill.hide_like_gaps(s, "entity", "ts", "value", 0.3)
    filled = windows.interpolate(masked, ["entity"], "ts", "value", 6).withColumn("bucket", right_closed(F.col("gap_length"), [1, 3, 6]).cast("int"))
    return gapfill.fill_errors(filled, "truth", "value", ["entity", "bucket"]).withColumns({c: F.round(c, 4) for c in ("mae", "rmse")})


@query()
def sarima_scores(spark, d):
    """Seasonal ARMA of each event type's hours, fitted to three weeks, against persistence at four horizons of the rest."""
    from datetime import datetime

    from aerolith.operators import sarima

    g, cut_at = grid(spark, d), datetime(2024, 1, 22)
    fits = sarima.choose_orders(g.where(F.col("ts") < F.lit(cut_at)), "entity", "ts", "value")
    out = sarima.forecast_scores(sarima.rolling_forecasts(g, fits, "entity", "ts", "value", cut_at, [1, 6, 24, 48], stride=3), ["entity", "horizon"])
    return out.withColumns({c: F.round(c, 3) for c in ("rmse", "persistence_rmse", "skill")})


@query()
def driver_shares(spark, d):
    """Mean shares of features in boosted forecasts of the next hour, for two feature sets."""
    from aerolith.catalog.statistics import _features
    from aerolith.operators import drivers

    rows = _features(spark, d).withColumn("fold", F.lit(1))
    sets = {"lags": ["lag_1", "lag_2", "lag_24"], "all": ["lag_1", "lag_2", "lag_24", "mean_3", "hour_sin", "hour_cos"]}
    return drivers.feature_sets(rows, sets, "target", "fold", "role", 150.0)[1].withColumns({c: F.round(c, 4) for c in ("mean_abs_share", "share_of_all")})


@query("""SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS INTEGER) AS row, s_name AS name, 'https://files.example/' || s_suppkey AS link, CASE WHEN n_nationkey % 3 > 0 THEN round(s_acctbal, 2)::VARCHAR END AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 > 0""")
def catalogue_tables(spark, d):
    """Catalogue pages, one for each nation, read by header labels: columns stand elsewhere on every other page, and some lack one; rows without a link are left out."""
    from aerolith.sources import html

    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    link = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("<a class=x href='https://files.example/"), F.col("s_suppkey").cast("string"), F.lit("'>get</a>"))).otherwise("")
    name, kind, value = cell(F.col("s_name")), cell(F.lit("all &amp; any")), cell(F.round("s_acctbal", 2).cast("string"))
    odd, short = F.col("n_nationkey") % 2 == 1, F.col("n_nationkey") % 3 == 0
    line = F.concat(F.lit("<tr>"), F.when(odd, F.concat(kind, cell(link), name)).otherwise(F.concat(name, cell(link))), F.when(short, "").otherwise(value), F.lit("</tr>"))
    rows = s.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct((F.col("s_suppkey") % 5 == 0).alias("last"), "s_suppkey", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("<html><table><tr>"), F.when(odd, "<th>Kind</th><th>Download</th><th>Name</th>").otherwise("<th>Name</th><th>Download</th>"), F.when(short, "").otherwise("<th>Balance</th>"), F.lit("</tr>"))
    pages = rows.select("n_nationkey", F.concat(head, F.array_join("l.line", ""), F.lit("</table>")).alias("html"))
    cells = html.table_cells(pages, "n_nationkey", "html")
    return html.by_label(cells, "n_nationkey", {"name": "Name", "balance": "Balance"}, {"link": "Download"}, ["link"]).drop("table")
