"""Frames that several queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.catalog import table
from aerolith.functions.domain import hour_of
from aerolith.operators.windows import hourly_grid

#: Hourly mean value of each event type.
HOURS = "hours AS (SELECT event_type AS entity, date_trunc('hour', ts) AS ts, round(avg(value), 4) AS value FROM events GROUP BY 1, 2)"
GRID = HOURS + """, spans AS (SELECT entity, min(ts) AS a, max(ts) AS b FROM hours GROUP BY 1),
 slots AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM spans),
 grid AS (SELECT s.entity, s.ts, h.value FROM slots s LEFT JOIN hours h USING (entity, ts))"""
#: Coordinates made from a key: the same expression on both sides.
LAT, LON = "(({k} * 37) % 1200) / 100.0 + 20.0", "(({k} * 91) % 1500) / 100.0 + 110.0"


def hours(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), hour_of(F.col("ts")).alias("ts")).agg(F.round(F.avg("value"), 4).alias("value"))


def grid(spark, sf_dir: str) -> DataFrame:
    return hourly_grid(hours(spark, sf_dir), ["entity"], "ts")


def placed(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    k = F.col(key)
    return df.withColumn(lat, (k * 37 % 1200).cast("double") / 100.0 + 20.0).withColumn(lon, (k * 91 % 1500).cast("double") / 100.0 + 110.0)


def placed_sql(source: str, key: str) -> str:
    return f"(SELECT *, CAST(({key} * 37) % 1200 AS DOUBLE) / 100.0 + 20.0 AS lat, CAST(({key} * 91) % 1500 AS DOUBLE) / 100.0 + 110.0 AS lon FROM {source})"


def haversine_sql(a: str, b: str) -> str:
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def draw_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def fit_sql(rows: str, k: int, name: str = "fit") -> str:
    """CTEs that fit y on x1..xk (k up to 3) by least squares for each g of `rows` (g, w, y, x1..): k0..kk, rss, yy, n and the inverse of the centred sums."""
    xs = range(1, k + 1)
    pairs = [(a, b) for a in xs for b in xs if a <= b]
    s = lambda a, b: f"s{min(a, b)}{max(a, b)}"
    if k == 1:
        det, inv = "s11", {(1, 1): "1"}
    elif k == 2:
        det, inv = "(s11 * s22 - s12 * s12)", {(1, 1): "s22", (1, 2): "-s12", (2, 2): "s11"}
    else:
        minor = lambda a, b: "({} * {} - {} * {})".format(*(s(r, c) for r, c in ((r1, c1) for r1, c1 in _minor(a, b))))
        inv = {(a, b): ("" if (a + b) % 2 == 0 else "-") + minor(a, b) for a, b in pairs}
        det = f"(s11 * {minor(1, 1)} - s12 * {minor(1, 2)} + s13 * {minor(1, 3)})"
    i = lambda a, b: f"i{min(a, b)}{max(a, b)}"
    means = ", ".join(f"sum(w * x{a}) / sum(w) AS m{a}" for a in xs)
    sums = ", ".join([*(f"sum(w * (x{a} - m{a}) * (x{b} - m{b})) AS s{a}{b}" for a, b in pairs), *(f"sum(w * (x{a} - m{a}) * (y - ym)) AS b{a}" for a in xs)])
    slopes = ", ".join(" + ".join(f"{i(a, b)} * b{b}" for b in xs) + f" AS k{a}" for a in xs)
    return f"""{name}_m AS (SELECT g, sum(w) AS n, sum(w * y) / sum(w) AS ym, {means} FROM {rows} GROUP BY g),
 {name}_s AS (SELECT g, {sums}, sum(w * (y - ym) * (y - ym)) AS yy FROM {rows} JOIN {name}_m USING (g) GROUP BY g),
 {name}_i AS (SELECT *, {', '.join(f'({v}) / {det} AS i{a}{b}' for (a, b), v in inv.items())} FROM {name}_s),
 {name}_b AS (SELECT *, {slopes} FROM {name}_i JOIN {name}_m USING (g)),
 {name} AS (SELECT *, ym - {' - '.join(f'k{a} * m{a}' for a in xs)} AS k0, yy - {' - '.join(f'k{a} * b{a}' for a in xs)} AS rss FROM {name}_b)"""


def _minor(a: int, b: int):
    """Cells of the 2 x 2 minor of a 3 x 3 matrix without row a and column b, as for its determinant."""
    r, c = [x for x in (1, 2, 3) if x != a], [x for x in (1, 2, 3) if x != b]
    return [(r[0], c[0]), (r[1], c[1]), (r[0], c[1]), (r[1], c[0])]


def ols_sql(rows: str, names: list[str]) -> str:
    """The table that `stats.ols` gives, rounded as `ols_rounded` does."""
    k = len(names)
    spread = " + ".join(f"m{a} * m{b} * i{min(a, b)}{max(a, b)}" for a in range(1, k + 1) for b in range(1, k + 1))
    terms = [("intercept", "k0", f"(1.0 / n + {spread})", "CAST(NULL AS DOUBLE)")]
    terms += [(x, f"k{a}", f"i{a}{a}", f"round(s{a}{a} * i{a}{a}, 5)") for a, x in enumerate(names, 1)]
    row = lambda t, c, v, f: f"SELECT '{t}' AS term, round({c}, 2) AS coef, round(sqrt(rss / (n - {k + 1}) * {v}), 3) AS se, round({c} / sqrt(rss / (n - {k + 1}) * {v}), 3) AS t, {f} AS vif, round(1 - rss / yy, 6) AS r2, CAST(n AS BIGINT) AS n FROM fit"
    return f"WITH {rows}, {fit_sql('base', k)} " + " UNION ALL ".join(row(*t) for t in terms)
