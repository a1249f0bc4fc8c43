"""Parsing, flags, rules, duplicates, runs, gaps, excursions and filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import ORACLE_SQL, query, table
from aerolith.catalog.frames import GRID, HOURS, draw_sql, grid, hours
from aerolith.catalog.joins import _ISLANDS, scored
from aerolith.functions.flags import parse_cell
from aerolith.operators import qc, windows

_RAW = """raw AS (SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS BIGINT) % 9 WHEN 0 THEN '' WHEN 1 THEN '#' WHEN 2 THEN 'NR' WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '#' WHEN 4 THEN '.5' WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '?' WHEN 6 THEN ' -' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.25 x ' WHEN 7 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw FROM lineitem)"""


def _raw(spark, d):
    q = F.col("l_quantity").cast("long")
    n, s = q % 9, q.cast("string")
    raw = F.when(n == 0, "").when(n == 1, "#").when(n == 2, "NR").when(n == 3, F.concat(s, F.lit("#"))).when(n == 4, ".5").when(n == 5, F.concat(s, F.lit("?"))).when(n == 6, F.concat(F.lit(" -"), s, F.lit(".25 x "))).when(n == 7, F.lit(None)).otherwise(s)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))


@query(f"""WITH {_RAW}, t AS (SELECT *, trim(coalesce(raw, '')) AS x FROM raw), p AS (SELECT *, nullif(regexp_extract(x, '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS n, trim(regexp_replace(x, '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', '')) AS m FROM t),
 f AS (SELECT *, CASE WHEN x = '' THEN 'missing' WHEN m = '' THEN 'valid' WHEN m = '#' THEN 'instrument_check_invalid' WHEN m = '*' THEN 'program_check_invalid' WHEN m IN ('x', 'X') THEN 'manual_check_invalid' WHEN m = 'NR' THEN 'no_rain' ELSE 'unparseable' END AS flag FROM p)
 SELECT l_orderkey, l_linenumber, CASE WHEN n IS NOT NULL AND flag <> 'unparseable' THEN CAST(n AS DOUBLE) END AS value, flag, n IS NOT NULL AND flag NOT IN ('unparseable', 'valid') AS value_retained FROM f""")
def parse_cells(spark, d):
    return _raw(spark, d).select("l_orderkey", "l_linenumber", parse_cell("raw").alias("c")).select("l_orderkey", "l_linenumber", "c.*")


_OBS = "obs AS (SELECT l_orderkey, l_linenumber, l_returnflag AS item, l_quantity AS value, CASE WHEN l_discount > 0.08 THEN 'no_rain' WHEN l_discount > 0.06 THEN 'instrument_check_invalid' ELSE 'valid' END AS flag FROM lineitem)"


def _obs(spark, d):
    flag = F.when(F.col("l_discount") > 0.08, "no_rain").when(F.col("l_discount") > 0.06, "instrument_check_invalid").otherwise("valid")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("item"), F.col("l_quantity").alias("value"), flag.alias("flag"))


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, item, CASE WHEN flag = 'valid' AND item = 'A' AND value IN (8, 9) OR flag = 'valid' AND item = 'R' AND value = 50 THEN NULL ELSE value END AS value, CASE WHEN flag = 'valid' AND item = 'A' AND value = 8 THEN 'calm' WHEN flag = 'valid' AND item = 'A' AND value = 9 THEN 'variable' WHEN flag = 'valid' AND item = 'R' AND value = 50 THEN 'overflow' ELSE flag END AS flag FROM obs")
def sentinel_values(spark, d):
    return qc.sentinels(_obs(spark, d), "item", "value", "flag", {"A": {8: "calm", 9: "variable"}, "R": {50: "overflow"}})


@query(f"WITH {_OBS}, n AS (SELECT l_orderkey, l_linenumber, item, flag, CASE WHEN value > 5 THEN value END AS value FROM obs) SELECT l_orderkey, l_linenumber, item, flag, CASE WHEN item = 'N' AND flag = 'no_rain' AND value IS NULL THEN 0.0 ELSE value END AS value FROM n")
def no_rain_zero(spark, d):
    return qc.no_rain_is_zero(_obs(spark, d).withColumn("value", F.when(F.col("value") > 5, F.col("value"))), "item", "value", "flag", ["N"])


@query(f"WITH {_OBS} SELECT l_orderkey, l_linenumber, item, value, CASE WHEN flag = 'valid' AND (item = 'A' AND (value < 5 OR value > 45) OR item = 'N' AND (value < 0 OR value > 40)) THEN 'out_of_range' ELSE flag END AS flag FROM obs")
def range_check(spark, d):
    return qc.ranges(_obs(spark, d), "item", "value", "flag", {"A": (5, 45), "N": (0, 40)})


@query(f"""WITH {_OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, item ORDER BY value, flag) AS nth FROM obs), c AS (SELECT l_orderkey, l_linenumber, item, CASE WHEN value > 5 THEN value END AS value, flag FROM o WHERE nth = 1),
 s AS (SELECT l_orderkey, l_linenumber, item, CASE WHEN flag = 'valid' AND item = 'R' AND value = 50 THEN NULL ELSE value END AS value, CASE WHEN flag = 'valid' AND item = 'R' AND value = 50 THEN 'overflow' ELSE flag END AS flag FROM c), z AS (SELECT l_orderkey, l_linenumber, item, CASE WHEN item = 'N' AND flag = 'no_rain' AND value IS NULL THEN 0.0 ELSE value END AS value, flag FROM s)
 SELECT l_orderkey, l_linenumber, item, value, CASE WHEN flag = 'valid' AND item = 'A' AND (value < 8 OR value > 45) THEN 'out_of_range' ELSE flag END AS flag FROM z""")
def quality_pass(spark, d):
    """All quality rules in their order over every row: duplicates collapsed, sentinels, no-rain zeros, ranges."""
    rows = qc.collapse_duplicates(_obs(spark, d), ["l_orderkey", "l_linenumber", "item"], [F.col("value"), F.col("flag")]).withColumn("value", F.when(F.col("value") > 5, F.col("value")))
    rows = qc.no_rain_is_zero(qc.sentinels(rows, "item", "value", "flag", {"R": {50: "overflow"}}), "item", "value", "flag", ["N"])
    return qc.ranges(rows, "item", "value", "flag", {"A": (8, 45)})


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) AS h, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS b, max(value) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1, 2)
 SELECT user_id, 'a_below_b' AS rule, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS checked, count(*) FILTER (a > b) AS violations, round(count(*) FILTER (a > b) / nullif(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), 0)::DOUBLE, 6) AS rate FROM w GROUP BY 1
 UNION ALL SELECT user_id, 'near', count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), count(*) FILTER (abs(a - c) > 0.1 * abs(c) + 1), round(count(*) FILTER (abs(a - c) > 0.1 * abs(c) + 1) / nullif(count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), 0)::DOUBLE, 6) FROM w GROUP BY 1""")
def consistency_rules(spark, d):
    from aerolith.functions.domain import hour_of

    wide = table(spark, d, "events").groupBy("user_id", hour_of(F.col("ts")).alias("h")).pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value")).withColumnsRenamed({"click": "a", "view": "b", "purchase": "c"})
    rules = {"a_below_b": (["a", "b"], F.col("a") <= F.col("b")), "near": (["a", "c"], F.abs(F.col("a") - F.col("c")) <= 0.1 * F.abs("c") + 1), "skipped": (["a", "x"], F.lit(True))}
    return qc.consistency(wide, ["user_id"], rules)


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT (l_quantity, l_returnflag)) AS versions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_quantity, l_returnflag)) > 1")
def duplicate_conflicts(spark, d):
    return qc.duplicate_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_returnflag"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def duplicate_collapse(spark, d):
    out = qc.collapse_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT event_id, CASE WHEN value > 400 THEN 'too_high' WHEN user_id % 10 = 0 THEN 'excluded_user' WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'too_low' END AS reason FROM events")
def reason_cascade(spark, d):
    reason = qc.cascade([(F.col("value") > 400, "too_high"), (F.col("user_id") % 10 == 0, "excluded_user"), (F.col("event_type") == "error", "error"), (F.col("value") < 5, "too_low")])
    return table(spark, d, "events").select("event_id", reason.alias("reason"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS members FROM customer GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) > 1 AS ambiguous, row_number() OVER (PARTITION BY c_nationkey ORDER BY members DESC, c_mktsegment) AS n FROM c)
 SELECT c_nationkey, c_mktsegment, members, ambiguous FROM r WHERE n = 1""")
def majority_label(spark, d):
    return qc.majority_label(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("""SELECT count(*) AS rows, count(*) FILTER (l_quantity > 49) AS too_many, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS odd_flag, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys FROM lineitem""")
def validation_report(spark, d):
    return qc.validation(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"too_many": F.col("l_quantity") > 49, "odd_flag": ~F.col("l_returnflag").isin("A", "N")})


@query(f"""WITH {GRID}, w AS (SELECT *, lag(value, 1) OVER o AS lag_2, lag(value, 2) OVER o AS lag_3, count(value) OVER r AS n, avg(value) OVER r AS m, max(value) OVER r AS x FROM grid WINDOW o AS (PARTITION BY entity ORDER BY ts), r AS (PARTITION BY entity ORDER BY ts ROWS 2 PRECEDING))
 SELECT entity, ts, value, value AS lag_1, lag_2, lag_3, round(CASE WHEN n = 3 THEN m END, 6) AS mean_3, CASE WHEN n = 3 THEN x END AS max_3, round(value - lag_2, 6) AS delta_1, round(value - lag_3, 6) AS delta_2 FROM w""")
def lag_features(spark, d):
    out = windows.lag_features(grid(spark, d), ["entity"], "ts", "value", [1, 2, 3], [3])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_3", "delta_1", "delta_2")})


@query(f"WITH {GRID} SELECT entity, ts, value, lead(value, 6) OVER (PARTITION BY entity ORDER BY ts) AS target FROM grid")
def lead_target(spark, d):
    return windows.target(grid(spark, d), ["entity"], "ts", "value", 6)


@query(f"""WITH {HOURS}, b AS (SELECT entity, ts, floor(value / 100) AS value, value % 7 < 1 AS rejected, day(ts) > 20 AS modern FROM hours), k AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt, count(*) OVER (PARTITION BY entity, value) / count(*) OVER (PARTITION BY entity)::DOUBLE AS share FROM b WINDOW w AS (PARTITION BY entity ORDER BY ts)),
 i AS (SELECT *, sum(CASE WHEN value = p AND ts - pt = INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM k),
 r AS (SELECT entity, min(ts) AS start, max(ts) AS "end", count(*) AS length, min(value) AS value, max(CASE WHEN ts = t0 THEN p END) AS entered_from, min(share) AS share, avg(rejected::INT) AS rejected, bool_and(modern) AS modern FROM (SELECT *, min(ts) OVER (PARTITION BY entity, run) AS t0 FROM i) GROUP BY entity, run HAVING count(*) >= 2)
 SELECT entity, start, "end", length, CAST(value AS DOUBLE) AS value, CAST(entered_from AS DOUBLE) AS entered_from, round(share, 6) AS value_share, round(CASE WHEN NOT modern THEN rejected END, 6) AS rejected_share, value = 0 AS at_zero, value < 0 AS negative, entered_from < value AS entered_from_below FROM r""")
def stuck_runs(spark, d):
    h = hours(spark, d).withColumn("rejected", F.col("value") % 7 < 1).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    out = windows.stuck_runs(h, ["entity"], "ts", "value", rejected=F.col("rejected"), blind=F.day("ts") > 20)
    return out.withColumns({c: F.round(c, 6) for c in ("value_share", "rejected_share")})


@query(f"""WITH {GRID}, g AS (SELECT *, value IS NULL AS z, lag(value IS NULL) OVER (PARTITION BY entity ORDER BY ts) AS p FROM grid), i AS (SELECT *, sum(CASE WHEN z = p THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT entity, min(ts) AS start, count(*) AS length FROM i WHERE z GROUP BY entity, run""")
def gap_runs(spark, d):
    return windows.null_runs(grid(spark, d), ["entity"], "ts", "value")


@query(f"WITH {_ISLANDS} SELECT entity, ts, round(z, 5) AS z, ex AS excursion, dir AS direction, round(avg(ex::INT) OVER (PARTITION BY entity, hour(ts)), 6) AS elevated_share FROM s4")
def robust_z(spark, d):
    return scored(spark, d).select("entity", "ts", F.round("z", 5).alias("z"), "excursion", "direction", F.round("elevated_share", 6).alias("elevated_share"))


@query(f"""WITH {_ISLANDS} SELECT entity, min(ts) AS start, max(ts) AS "end", count(*) AS length, min(dir) AS direction, round(arg_max(z, abs(z)), 5) AS peak_z FROM r GROUP BY entity, run""")
def excursion_runs(spark, d):
    return windows.excursion_runs(scored(spark, d), ["entity"], "ts").select("entity", "start", "end", "length", "direction", F.round("peak_z", 5).alias("peak_z"))


# Hours some of which were rejected or came without a value: these are not scored, but are there.
_PRESENT = "present AS (SELECT *, value % 13 >= 1 AND value % 17 >= 1 AS usable, value % 13 < 1 AS rejected FROM (SELECT event_type AS entity, date_trunc('hour', ts) AS ts, round(avg(value), 4) AS value FROM events GROUP BY 1, 2)), hours AS (SELECT entity, ts, value FROM present WHERE usable)"
_BOUNDED = f"""WITH {_PRESENT}{_ISLANDS[len(HOURS):]}, runs AS (SELECT entity, min(ts) AS start, max(ts) AS "end", count(*) AS length, min(dir) AS direction FROM r GROUP BY entity, run), e AS (SELECT entity, min(ts) AS a, max(ts) AS b FROM present GROUP BY 1),
 sides AS (SELECT *, 'left' AS side, start - INTERVAL 1 HOUR AS h FROM runs UNION ALL SELECT *, 'right', "end" + INTERVAL 1 HOUR FROM runs),
 why AS (SELECT s.entity, s.start, s.side, CASE WHEN h < TIMESTAMP '2024-01-03' OR h > TIMESTAMP '2024-01-28' THEN 'outside_requested_span' WHEN h < e.a OR h > e.b THEN 'series_edge' WHEN p.entity IS NULL THEN 'absent' WHEN NOT p.usable AND p.rejected THEN 'agency_rejected' WHEN NOT p.usable THEN 'value_null' WHEN q.z IS NULL THEN 'unscored' WHEN q.ex AND q.dir <> s.direction THEN 'direction_reversal' ELSE 'below_threshold' END AS reason
  FROM sides s JOIN e USING (entity) LEFT JOIN present p ON p.entity = s.entity AND p.ts = s.h LEFT JOIN s4 q ON q.entity = s.entity AND q.ts = s.h),
 bounded AS (SELECT runs.*, l.reason AS left_reason, g.reason AS right_reason, l.reason <> 'below_threshold' OR g.reason <> 'below_threshold' AS censored FROM runs JOIN why l ON l.entity = runs.entity AND l.start = runs.start AND l.side = 'left' JOIN why g ON g.entity = runs.entity AND g.start = runs.start AND g.side = 'right')"""


def _bounded(spark, d):
    from datetime import datetime

    present = hours(spark, d).withColumn("usable", (F.col("value") % 13 >= 1) & (F.col("value") % 17 >= 1)).withColumn("rejected", F.col("value") % 13 < 1)
    s = windows.robust_scores(present.where("usable").withColumn("hour", F.hour("ts")), ["entity", "hour"], "value", least=10, threshold=2.0)
    asked = (datetime(2024, 1, 3), datetime(2024, 1, 28))
    return s, windows.boundaries(windows.excursion_runs(s, ["entity"], "ts"), s, ["entity"], "ts", present, asked)


@query(_BOUNDED + """ SELECT entity, start, "end", left_reason, right_reason, censored FROM bounded""")
def run_boundaries(spark, d):
    return _bounded(spark, d)[1].select("entity", "start", "end", "left_reason", "right_reason", "censored")


@query(_BOUNDED + """, o AS (SELECT entity, start, direction, unnest(generate_series(start - INTERVAL 1 HOUR, "end" + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM bounded WHERE entity <> 'error'),
 m AS (SELECT o.entity, o.start, s.entity AS nb, s.ex AND s.dir = o.direction AS up FROM o JOIN s4 s ON s.ts = o.ts AND s.entity <> o.entity AND s.entity <> 'error' AND s.z IS NOT NULL),
 f AS (SELECT entity, start, count(DISTINCT nb) AS scoreable, count(DISTINCT nb) FILTER (up) AS elevated FROM m GROUP BY 1, 2),
 v AS (SELECT b.*, CASE WHEN b.entity <> 'error' THEN (SELECT count(DISTINCT entity) FROM present WHERE entity <> 'error') - 1 END AS placed, CASE WHEN b.entity <> 'error' THEN coalesce(f.scoreable, 0) END AS scoreable, CASE WHEN b.entity <> 'error' THEN coalesce(f.elevated, 0) END AS elevated FROM bounded b LEFT JOIN f USING (entity, start)),
 j AS (SELECT *, CASE WHEN entity = 'error' THEN 'no_coordinates' WHEN direction > 0 AND scoreable < 2 THEN 'too_few_scoreable_neighbours' WHEN direction < 0 AND scoreable = 0 THEN 'no_scoreable_neighbour' WHEN direction > 0 AND elevated + 1 >= 3 THEN 'synchronous_rise' WHEN censored THEN 'duration_censored' WHEN length <= 1 AND elevated < 1 THEN 'short_and_alone' ELSE 'sustained_and_alone' END AS reason FROM v)
 SELECT entity, start, direction, length, placed, scoreable, elevated, CASE reason WHEN 'synchronous_rise' THEN 'regional_episode' WHEN 'short_and_alone' THEN 'uncorroborated_short_rise' WHEN 'sustained_and_alone' THEN 'uncorroborated_sustained_rise' ELSE 'uncheckable' END AS verdict, reason FROM j""")
def excursion_verdicts(spark, d):
    """Event types as stations, all near each other but `error`, which has no coordinates."""
    from aerolith.operators import joins
    from aerolith.plans import jobs

    s, runs = _bounded(spark, d)
    points = s.select("entity").distinct().where("entity <> 'error'")
    edges = points.crossJoin(points.withColumnRenamed("entity", "neighbour")).where("entity <> neighbour")
    out = jobs.judged(joins.corroborate(runs, edges, s, "entity", "ts", 1, [-14, 14]), points, "entity", stations=3, longest=1)
    return out.select("entity", "start", "direction", "length", "placed", "scoreable", "elevated", "verdict", "reason")


@query("WITH v AS (" + ORACLE_SQL["excursion_verdicts"] + ") SELECT entity, verdict, direction, CAST(month(start) AS INTEGER) AS month, count(*) AS runs FROM v GROUP BY 1, 2, 3, 4")
def verdict_seasonality(spark, d):
    from aerolith.operators import reports

    return reports.verdict_seasonality(excursion_verdicts(spark, d), ["entity"])


@query(f"""WITH {_OBS}, f AS (SELECT o.*, year(o_orderdate) AS year FROM obs o JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT year, count(*) AS cells FROM f WHERE item <> 'N' GROUP BY 1) SELECT CAST(f.year AS INTEGER) AS year, item, flag, count(*) AS n, any_value(cells) AS cells, round(count(*) / any_value(cells)::DOUBLE, 6) AS rate FROM f LEFT JOIN c USING (year) WHERE flag IN ('no_rain', 'instrument_check_invalid') GROUP BY 1, 2, 3""")
def flag_rates(spark, d):
    from aerolith.operators import reports

    years = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    return reports.flag_rates(_obs(spark, d).join(years, "l_orderkey"), ["year"], ["item"], "flag", ["no_rain", "instrument_check_invalid"], F.col("item") != "N")

@query(f"""WITH {GRID}, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS n FROM grid), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN n END AS kn FROM i),
 f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(kn IGNORE NULLS) OVER b AS i0, first_value(value IGNORE NULLS) OVER a AS v1, first_value(kn IGNORE NULLS) OVER a AS i1 FROM k WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT entity, ts, round(CASE WHEN value IS NULL AND i1 - i0 - 1 <= 2 THEN v0 + (v1 - v0) * (n - i0) / (i1 - i0) ELSE value END, 5) AS value, coalesce(value IS NULL AND i1 - i0 - 1 <= 2, false) AS value_imputed FROM f""")
def interpolate_bounded(spark, d):
    return windows.interpolate(grid(spark, d), ["entity"], "ts", "value", 2).withColumn("value", F.round("value", 5))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity <= 1 THEN 0 WHEN l_quantity <= 6 THEN 1 WHEN l_quantity <= 24 THEN 2 ELSE 3 END AS INTEGER) AS bucket FROM lineitem")
def bucket_right_closed(spark, d):
    from aerolith.functions.maths import right_closed

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", right_closed(F.col("l_quantity"), [1, 6, 24]).cast("int").alias("bucket"))


@query(f"""WITH {GRID}, p AS (SELECT a.entity, b.entity AS nb, count(*) AS n, corr(a.value, b.value) AS r, regr_slope(a.value, b.value) AS s, regr_intercept(a.value, b.value) AS i FROM grid a JOIN grid b ON a.ts = b.ts AND a.entity <> b.entity WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY r DESC, nb) AS k FROM p WHERE n >= 24 AND r >= -1) WHERE k = 1)
 SELECT g.entity, g.ts, round(coalesce(g.value, best.i + best.s * o.value), 4) AS value, g.value IS NULL AND o.value IS NOT NULL AS value_imputed FROM grid g LEFT JOIN best ON best.entity = g.entity LEFT JOIN grid o ON o.entity = best.nb AND o.ts = g.ts""")
def donor_fill(spark, d):
    """Gaps of each event type from the type it follows best."""
    from aerolith.operators import gapfill

    g = grid(spark, d)
    names = g.select("entity").distinct()
    edges = names.crossJoin(names.withColumnRenamed("entity", "neighbour")).where("entity <> neighbour").withColumn("km", F.lit(1.0))
    best = gapfill.donors(g, edges, "entity", "ts", "value", overlaps=24, least_r=-1.0)
    return gapfill.fill_from_donors(g, best, "entity", "ts", "value").withColumn("value", F.round("value", 4))


@query(f"""WITH {GRID}, t AS (SELECT entity, ts, value AS truth, row_number() OVER (PARTITION BY entity ORDER BY ts) AS n FROM grid), h AS (SELECT *, truth IS NOT NULL AND {draw_sql('entity', 'n - 1', '1')} < 0.2 AS hidden FROM t), i AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS value FROM h), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN n END AS kn FROM i),
 f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(kn IGNORE NULLS) OVER b AS i0, first_value(value IGNORE NULLS) OVER a AS v1, first_value(kn IGNORE NULLS) OVER a AS i1 FROM k WINDOW b AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 g AS (SELECT entity, truth, CASE WHEN i1 - i0 - 1 <= 3 THEN v0 + (v1 - v0) * (n - i0) / (i1 - i0) END AS filled FROM f WHERE hidden)
 SELECT entity, count(*) AS hidden, round(avg((filled IS NOT NULL)::INT), 6) AS recovered, round(avg(abs(filled - truth)), 6) AS mae, round(sqrt(avg(pow(filled - truth, 2))), 6) AS rmse FROM g GROUP BY 1""")
def fill_scores(spark, d):
    """Errors of bounded interpolation on values hidden by a repeatable draw."""
    from aerolith.operators import gapfill

    hidden = gapfill.hide(grid(spark, d), "entity", "ts", "value", 0.2, 1)
    return gapfill.fill_errors(windows.interpolate(hidden, ["entity"], "ts", "value", 3), "truth", "value", ["entity"])
