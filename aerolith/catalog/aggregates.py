"""Coverage-gated aggregates, reports, reshaping, sorts, sets and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import GRID, HOURS, grid, hours
from aerolith.functions import domain, maths
from aerolith.operators import aggregate, panels, windows

NAIVE = "timestamp_ntz"


@query("""SELECT event_type, CAST(ts AS DATE) AS date, round(CASE WHEN count(value) >= 5 THEN avg(value) END, 6) AS mean, min(value) AS min, max(value) AS max,
 count(value) AS n_valid, count(value) / 24.0::DOUBLE AS coverage_ratio, count(value) >= 5 AS meets_threshold FROM events GROUP BY 1, 2""")
def daily_coverage(spark, d):
    days = aggregate.daily(table(spark, d, "events"), ["event_type"], "ts", "value", least=5)
    return days.select("event_type", "date", F.round("mean", 6).alias("mean"), "min", "max", "n_valid", "coverage_ratio", "meets_threshold")


@query("""WITH x AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS date, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2),
 y AS (SELECT k, CAST(date_trunc('month', date) AS DATE) AS month, avg(m) AS m, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_valid_hours FROM x WHERE n >= 1 GROUP BY 1, 2)
 SELECT k AS o_orderpriority, month, round(CASE WHEN n_days / day(last_day(month))::DOUBLE >= 0.75 THEN m END + 1e-7, 4) AS mean, n_days, n_valid_hours, CAST(day(last_day(month)) AS BIGINT) AS days_in_month,
 round(n_days / day(last_day(month))::DOUBLE, 6) AS coverage_ratio, n_days / day(last_day(month))::DOUBLE >= 0.75 AS meets_threshold FROM y""")
def monthly_coverage(spark, d):
    days = aggregate.daily(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", least=1)
    out = aggregate.monthly(days, ["o_orderpriority"])
    return out.withColumn("mean", F.round(F.col("mean") + 1e-7, 4)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("""SELECT event_type, round((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) + 360) % 360, 5) AS direction,
 round(sqrt(pow(avg(sin(radians(value))), 2) + pow(avg(cos(radians(value))), 2)), 6) AS resultant FROM events GROUP BY 1""")
def circular_direction(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(maths.circular_mean(v), 5).alias("direction"), F.round(maths.circular_resultant(v), 6).alias("resultant"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT o_custkey) AS entities, count(DISTINCT o_orderpriority) AS measures,
 count(*) FILTER (o_orderstatus = 'F') AS valid, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS valid_ratio FROM orders GROUP BY 1""")
def partition_summary(spark, d):
    return aggregate.partition_summary(table(spark, d, "orders"), F.year("o_orderdate"), "o_custkey", "o_orderpriority", F.col("o_orderstatus") == "F")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS hours, count(*) FILTER (o_totalprice > 100000) AS valid,
 round(count(*) FILTER (o_totalprice > 100000) / count(*)::DOUBLE, 4) AS ratio FROM orders GROUP BY 1, 2""")
def completeness_matrix(spark, d):
    return aggregate.completeness(table(spark, d, "orders"), [F.year("o_orderdate").alias("year"), F.col("o_orderpriority")], F.col("o_totalprice") > 100000)


@query("""SELECT o_custkey, CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, CAST(max(year(o_orderdate)) AS BIGINT) AS last_year, count(DISTINCT year(o_orderdate)) AS years_present,
 CAST(max(year(o_orderdate)) - min(year(o_orderdate)) + 1 AS BIGINT) AS span, count(DISTINCT year(o_orderdate)) < max(year(o_orderdate)) - min(year(o_orderdate)) + 1 AS has_gap FROM orders GROUP BY 1""")
def entity_lifecycle(spark, d):
    return aggregate.lifecycle(table(spark, d, "orders"), "o_custkey", F.year("o_orderdate"))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def flag_distribution(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) FILTER (l_quantity > 25) AS retained, round(count(*) FILTER (l_quantity > 25) / count(*)::DOUBLE, 6) AS retained_share FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2")
def retention_asymmetry(spark, d):
    return aggregate.share_of(table(spark, d, "lineitem").where("l_discount > 0"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 25, "retained")


_PAIRS = "p AS (SELECT date_trunc('hour', ts) AS h, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)"


def _pairs(spark, d):
    e = table(spark, d, "events").groupBy(domain.hour_of(F.col("ts")).alias("h"))
    return e.pivot("event_type", ["click", "view"]).agg(F.avg("value")).withColumnsRenamed({"click": "a", "view": "b"})


@query(f"""WITH {_PAIRS}, q AS (SELECT *, CASE WHEN b > 0 THEN a / b END AS ratio FROM p WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS k, count(*) OVER () AS c FROM q WHERE ratio IS NOT NULL)
 SELECT count(*) AS pairs, round(corr(a, b), 6) AS corr, count(*) FILTER (a > b) AS impossible, count(*) FILTER (a = b) AS identical, count(*) FILTER (b <= 0) AS zero, round(median(ratio), 6) AS median_ratio,
 (SELECT round(ratio, 6) FROM n WHERE k = floor(0.05 * (c - 1) + 0.5)) AS p05, (SELECT round(ratio, 6) FROM n WHERE k = floor(0.95 * (c - 1) + 0.5)) AS p95 FROM q""")
def pair_diagnostics(spark, d):
    return aggregate.pair_diagnostics(_pairs(spark, d), [], "a", "b")


@query("""WITH m(name, instant) AS (VALUES ('early', TIMESTAMP '2024-01-05'), ('late', TIMESTAMP '2024-01-20'))
 SELECT name, count(*) FILTER (ts < instant) AS n_before, count(*) FILTER (ts >= instant) AS n_after, min(value) FILTER (ts >= instant) AS min_after, max(value) FILTER (ts >= instant) AS max_after FROM events, m GROUP BY 1""")
def conditional_after_event(spark, d):
    m = spark.sql("SELECT * FROM VALUES ('early', timestamp_ntz'2024-01-05'), ('late', timestamp_ntz'2024-01-20') AS t(name, instant)")
    return aggregate.before_after(table(spark, d, "events"), m, "ts", "value")


@query("""SELECT 'l_extendedprice' AS variable, count(l_extendedprice) AS n, min(l_extendedprice) AS min, round(median(l_extendedprice), 6) AS median, round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS max, round(stddev_samp(l_extendedprice), 6) AS sd FROM lineitem
 UNION ALL SELECT 'l_quantity', count(l_quantity), min(l_quantity), round(median(l_quantity), 6), round(avg(l_quantity), 6), max(l_quantity), round(stddev_samp(l_quantity), 6) FROM lineitem""")
def descriptive(spark, d):
    return aggregate.descriptive(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_values(spark, d):
    return aggregate.top_values(table(spark, d, "lineitem"), "l_partkey", 20)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_row(spark, d):
    o = table(spark, d, "orders")
    return aggregate.last_of(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, value AS peak_value, event_id AS peak_event_id, event_type AS peak_event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def at_peak(spark, d):
    return aggregate.at_peak(table(spark, d, "events"), ["user_id"], F.col("value"), -F.col("event_id"), ["value", "event_id", "event_type"])


@query("""WITH b AS (SELECT CAST(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS INTEGER) AS bucket, l_quantity FROM lineitem)
 SELECT bucket, count(*) AS n, sum(l_quantity) AS total, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS n_share, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS total_share FROM b GROUP BY 1""")
def bucket_shares(spark, d):
    rows = table(spark, d, "lineitem").withColumn("bucket", maths.right_closed(F.col("l_quantity"), [10, 20, 40]).cast("int"))
    return aggregate.shares_of_total(rows, "bucket", F.col("l_quantity"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
 SELECT event_type, value AS p95 FROM r WHERE n = floor(0.95 * (c - 1) + 0.5) + 1""")
def nearest_quantile(spark, d):
    return aggregate.nearest_quantile(table(spark, d, "events"), ["event_type"], "value", 0.95, "p95")


@query("SELECT event_type, CAST(user_id % 7 AS BIGINT) AS slot, count(*) AS n, avg(value) IS NOT NULL AS any_value FROM events GROUP BY ALL")
def group_by_all(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_all")
    return spark.sql("SELECT event_type, user_id % 7 AS slot, count(*) AS n, avg(value) IS NOT NULL AS any_value FROM events_all GROUP BY ALL")


@query("""SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1""")
def diurnal_cycle(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("""SELECT CAST(floor((value % 360) / 30) * 30 AS BIGINT) AS sector, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1""")
def wind_sectors(spark, d):
    return table(spark, d, "events").groupBy(domain.wind_sector(F.col("value")).cast("long").alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


# --- reshape ---------------------------------------------------------------------------------


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'absent'), 4) AS absent FROM events GROUP BY 1""")
def pivot_fixed(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "absent"]).agg(F.round(F.sum("value"), 4))


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS item, l_discount AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def unpivot(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "item", "amount")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH days AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS days, CAST(sum(n) AS BIGINT) AS cells FROM days GROUP BY 1""")
def dense_rectangle(spark, d):
    """The JSON rectangle, read back: how many columns and what sum of cells each row has."""
    from aerolith.sources.stores import rectangle

    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    j = rectangle(days, "event_type", "day", F.col("n"), []).select(F.from_json("json", "rows array<string>, columns array<string>, values array<array<long>>").alias("j"))
    cells = j.select(F.explode(F.arrays_zip("j.rows", "j.values")).alias("x"))
    values = F.filter(F.col("x.values"), lambda v: v.isNotNull())
    return cells.select(F.col("x.rows").alias("event_type"), F.size(values).cast("long").alias("days"), F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v).alias("cells"))


# --- sorts, limits, sets ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice, o_orderkey")
def mixed_sort(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc_nulls_first("o_orderpriority"), "o_totalprice", "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders), t AS (SELECT count(*) AS c, CAST(floor(count(*) * 0.4) AS BIGINT) AS s FROM orders), u AS (SELECT *, greatest(1, (c - s) // 3) AS step FROM t), f(fold) AS (VALUES (1), (2), (3)),
 g AS (SELECT fold, s + (fold - 1) * step AS a, least(s + fold * step, c) AS b FROM u, f)
 SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN n < a THEN 'train' ELSE 'test' END AS role, count(*) AS rows, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM r, g WHERE n < b GROUP BY 1, 2""")
def rolling_origin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = windows.rolling_origin(o, ["o_orderdate", "o_orderkey"], 3)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersection(spark, d):
    o = table(spark, d, "orders")
    k = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return k("F").intersect(k("O"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT s_suppkey AS key, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, CAST(NULL AS DOUBLE), c_mktsegment FROM customer")
def diagonal_union(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


# --- scalar features -------------------------------------------------------------------------


@query("""SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) AS hour_cos, round(sin(dayofyear(ts) * 2 * pi() / 365.25), 6) AS year_sin, round(cos(dayofyear(ts) * 2 * pi() / 365.25), 6) AS year_cos,
 round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) AS week_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) AS week_cos, isodow(ts) >= 6 AS is_weekend, CAST(datediff('day', DATE '1982-01-01', CAST(ts AS DATE)) AS BIGINT) AS trend_days FROM events""")
def temporal_features(spark, d):
    out = table(spark, d, "events").select("event_id", *domain.temporal_features(F.col("ts")))
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in out.columns[1:7]), "is_weekend", "trend_days")


@query("""SELECT event_id, round(-value * sin(radians(user_id % 360)), 6) AS u, round(-value * cos(radians(user_id % 360)), 6) AS v FROM events""")
def wind_components(spark, d):
    out = table(spark, d, "events").select("event_id", *domain.wind_components(F.col("value"), F.col("user_id") % 360))
    return out.select("event_id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS ox, round(CASE WHEN abs(l_tax) > 0.001 THEN l_discount / l_tax END, 6) AS ratio FROM lineitem""")
def safe_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") + F.col("l_tax"), 6).alias("ox"), F.round(maths.safe_ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"))


@query("""WITH x AS (SELECT event_id, 273.15 + value / 20 AS t, 268.15 + value / 20 AS dew FROM events)
 SELECT event_id, round(least(100.0, 100 * exp(17.625 * (dew - 273.15) / (243.04 + dew - 273.15)) / exp(17.625 * (t - 273.15) / (243.04 + t - 273.15))), 5) AS rh FROM x""")
def magnus_humidity(spark, d):
    e = table(spark, d, "events").select("event_id", (273.15 + F.col("value") / 20).alias("t"), (268.15 + F.col("value") / 20).alias("dew"))
    z = F.lit(0.0)
    out = e.select("event_id", *domain.weather_features(z, z, F.col("t"), F.col("dew"), z))
    return out.select("event_id", F.round("rh", 5).alias("rh"))


@query("""SELECT event_id, round(CASE WHEN (CASE WHEN value > 100 THEN 1 ELSE 0 END) + (CASE WHEN user_id > 50 THEN 1 ELSE 0 END) > 0
 THEN (coalesce(CASE WHEN value > 100 THEN value END, 0) + coalesce(CASE WHEN user_id > 50 THEN user_id END, 0)) / ((CASE WHEN value > 100 THEN 1 ELSE 0 END) + (CASE WHEN user_id > 50 THEN 1 ELSE 0 END)) END, 6) AS mean, value > 100 OR user_id > 50 AS any_high, value > 100 AND user_id > 50 AS all_high FROM events""")
def across_columns(spark, d):
    v, u = F.col("value") > 100, F.col("user_id") > 50
    cols = [F.when(v, F.col("value")), F.when(u, F.col("user_id").cast("double"))]
    return table(spark, d, "events").select("event_id", F.round(maths.mean_across(cols), 6).alias("mean"), maths.any_across([v, u]).alias("any_high"), maths.all_across([v, u]).alias("all_high"))


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts FROM events")
def local_time(spark, d):
    return table(spark, d, "events").select("event_id", domain.local_time(F.col("ts")).alias("local_ts"))


@query("""SELECT doc_id, upper(lang) AS code, substr(text, 1, 10) AS head, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded, starts_with(source, 'src1') AS starts, contains(text, 'the') AS has_the FROM documents""")
def string_functions(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.upper("lang").alias("code"), F.substring("text", 1, 10).alias("head"), F.octet_length("text").cast("long").alias("bytes"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"), F.col("source").startswith("src1").alias("starts"), F.col("text").contains("the").alias("has_the")
    )


@query(f"""WITH {HOURS}, c AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM hours WHERE value > 300), s AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM c),
 n AS (SELECT CAST(ts AS DATE) AS date, count(*) AS rows FROM hours WHERE value > 300 GROUP BY 1) SELECT s.date, n.rows, CASE WHEN n.rows IS NULL THEN 'absent' ELSE 'observed' END AS state FROM s LEFT JOIN n USING (date)""")
def calendar_coverage(spark, d):
    h = hours(spark, d).where("value > 300").withColumn("date", F.to_date("ts"))
    return panels.calendar_coverage(h, "date")


@query(f"WITH {GRID} SELECT entity, ts, value FROM grid")
def hourly_grid(spark, d):
    return grid(spark, d)
