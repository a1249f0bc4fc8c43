"""Held-out interpolation, Moran's I of residuals, clustered covariances, regions and their agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.catalog.frames import fit_sql, haversine_sql, placed, placed_sql
from aerolith.catalog.statistics import _EDGES, _S
from aerolith.operators import kriging, regions, residuals
from aerolith.session import cut

BUFFERS, SEARCH = [0.0, 60.0, 120.0], 400.0


def _spots(spark, d):
    return placed(table(spark, d, "supplier"), "s_suppkey").select("s_suppkey", "lat", "lon", "s_acctbal")


@query(f"""WITH p AS (SELECT a.s_suppkey AS k, b.s_suppkey AS nb, b.s_acctbal AS z, {haversine_sql('a', 'b')} AS km FROM {_S} a, {_S} b WHERE a.s_suppkey <> b.s_suppkey), f AS (SELECT s_suppkey AS k, s_acctbal AS observed, buffer_km FROM supplier, (VALUES (0.0::DOUBLE), (60.0), (120.0)) v(buffer_km)),
 g AS (SELECT f.k, f.buffer_km, count(*) AS n, arg_min(z, row(km, nb)) AS nearest, sum(z / pow(greatest(km, 0.1), 2)) / sum(1 / pow(greatest(km, 0.1), 2)) AS idw2, avg(z) AS mean FROM f JOIN p ON p.k = f.k AND km > buffer_km AND km <= {SEARCH} GROUP BY 1, 2)
 SELECT f.k AS s_suppkey, f.buffer_km, observed, coalesce(n, 0) AS n_train, method, CASE WHEN n >= 8 THEN round(CASE method WHEN 'nearest' THEN nearest WHEN 'idw2' THEN idw2 ELSE mean END, 6) END AS predicted, CASE WHEN coalesce(n, 0) < 8 THEN 'too_few' END AS failed
 FROM f LEFT JOIN g ON g.k = f.k AND g.buffer_km = f.buffer_km, (VALUES ('nearest'), ('idw2'), ('mean')) m(method)""")
def buffered_interpolation(spark, d):
    """Suppliers' balances held out one by one, with all within 0, 60 and 120 km of them; three methods."""
    return kriging.interpolate_held_out(_spots(spark, d), [], "s_suppkey", "s_acctbal", BUFFERS, SEARCH).withColumn("predicted", F.round("predicted", 6))


@query()
def buffered_kriging(spark, d):
    """The same folds by ordinary kriging under two families of variograms, each fitted inside its fold; failed folds stay."""
    out = kriging.krige_held_out(_spots(spark, d), [], "s_suppkey", "s_acctbal", BUFFERS, SEARCH, ["exponential", "hole-effect"])
    return out.withColumns({"predicted": F.round("predicted", 3), "sd": F.round("sd", 3)})


_NORMAL = "sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)) * cos(2 * pi() * ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH {_EDGES}, b AS (SELECT 0 AS g, 1.0::DOUBLE AS w, s_suppkey AS k, s_acctbal AS y, lat AS x1 FROM {_S}), {fit_sql('b', 1)},
 r AS (SELECT k, y - k0 - k1 * x1 AS e, x1 - m1 AS x, n, s11 FROM b, fit), m AS (SELECT ew.k, ew.nb, ew.weight AS w, i.e, j.e AS f, i.x, j.x AS z FROM ew JOIN r i ON i.k = ew.k JOIN r j ON j.k = ew.nb),
 o AS (SELECT sum(w) AS s0, sum(w * w) AS wwt, sum(w * e * f) AS num, sum(w) AS b00, sum(w * z) AS b01, sum(w * x) AS b10, sum(w * x * z) AS b11 FROM m), ww AS (SELECT coalesce(sum(p.weight * q.weight), 0) AS ww FROM ew p JOIN ew q ON p.k = q.nb AND p.nb = q.k),
 l AS (SELECT k, sum(w) AS l0, sum(w * z) AS l1 FROM m GROUP BY 1), c AS (SELECT nb AS k, sum(w) AS c0, sum(w * x) AS c1 FROM m GROUP BY 1),
 q AS (SELECT sum(coalesce(l0, 0) ** 2) AS l00, sum(coalesce(l1, 0) ** 2) AS l11, sum(coalesce(c0, 0) ** 2) AS c00, sum(coalesce(c1, 0) ** 2) AS c11, sum(coalesce(l0, 0) * coalesce(c0, 0)) AS x00, sum(coalesce(l1, 0) * coalesce(c1, 0)) AS x11 FROM l FULL JOIN c USING (k)),
 d AS (SELECT max(n) AS n, max(s11) AS s, sum(e * e) AS den FROM r),
 t AS (SELECT *, -(b00 / n + b11 / s) AS mw, ww - 2 * (x00 / n + x11 / s) + (b00 / n) ** 2 + 2 * b01 * b10 / (n * s) + (b11 / s) ** 2 AS mwmw,
  wwt - (c00 / n + c11 / s) - (l00 / n + l11 / s) + (b00 / n) ** 2 + (b01 ** 2 + b10 ** 2) / (n * s) + (b11 / s) ** 2 AS mwmwt FROM o, ww, q, d),
 v AS (SELECT *, n / s0 * mw / (n - 2) AS expected, (n / s0) ** 2 * (mwmwt + mwmw + mw ** 2) / ((n - 2) * n) - (n / s0 * mw / (n - 2)) ** 2 AS variance, n / s0 * num / den AS i FROM t),
 h AS (SELECT k, x, n, s11, draw, md5(concat_ws('|', k, draw, 1)) AS h FROM r, range(1, 100) t(draw)), z AS (SELECT k, x, n, s11, draw, {_NORMAL} AS e FROM h),
 a AS (SELECT draw, sum(e) / max(n) AS a0, sum(e * x) / max(s11) AS a1 FROM z GROUP BY 1), u AS (SELECT k, draw, e - a0 - a1 * x AS r FROM z JOIN a USING (draw)),
 un AS (SELECT i.draw, sum(w.weight * i.r * j.r) AS num FROM ew w JOIN u i ON i.k = w.k JOIN u j ON j.k = w.nb AND j.draw = i.draw GROUP BY 1), ud AS (SELECT draw, sum(r * r) AS den FROM u GROUP BY 1),
 p AS (SELECT (count(*) FILTER (abs(n / s0 * un.num / ud.den - expected) >= abs(i - expected)) + 1) / (count(*) + 1)::DOUBLE AS p FROM un JOIN ud USING (draw), v)
 SELECT CAST(n AS BIGINT) AS n, 2 AS k, round(i, 6) AS moran_i, round(expected, 6) AS expected, round(variance, 6) AS variance, round((i - expected) / sqrt(variance), 4) AS z, round(p, 6) AS p FROM v, p""")
def residual_moran(spark, d):
    """Moran's I of what latitude leaves of the suppliers' balances, with the moments and the simulated null of residuals."""
    return residuals.residual_moran_within(_spots(spark, d), [], "s_suppkey", "s_acctbal", ["lat"], 250.0)


def _cluster_sql() -> str:
    infl = "e * (1.0 / n - m1 * p1 - m2 * p2) AS f0, e * p1 AS f1, e * p2 AS f2"
    sums = lambda keys: f"SELECT count(*) AS c, sum(f0 * f0) AS v0, sum(f1 * f1) AS v1, sum(f2 * f2) AS v2 FROM (SELECT sum(f0) AS f0, sum(f1) AS f1, sum(f2) AS f2 FROM i GROUP BY {keys})"
    spread = " + ".join(f"m{a} * m{b} * i{min(a, b)}{max(a, b)}" for a in (1, 2) for b in (1, 2))
    var = {
        "iid": [f"rss / (n - 3) * {v}" for v in (f"(1.0 / n + {spread})", "i11", "i22")],
        "month": [f"fa * a.v{j}" for j in range(3)],
        "l_suppkey": [f"fb * b.v{j}" for j in range(3)],
        "two_way": [f"(fa * a.v{j} + fb * b.v{j} - ab.v{j})" for j in range(3)],
    }
    rows = [f"SELECT '{kind}', '{term}', k{j}, {v[j]}, {var['iid'][j]} FROM j" for kind, v in var.items() for j, term in enumerate(("intercept", "l_quantity", "l_discount"))]
    cells = " UNION ALL ".join(rows).replace("ab.v", "abv").replace("a.v", "av").replace("b.v", "bv")
    return f"""WITH base AS (SELECT 0 AS g, 1.0::DOUBLE AS w, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS a, l_suppkey AS b FROM lineitem), {fit_sql('base', 2)},
 q AS (SELECT a, b, n, m1, m2, y - k0 - k1 * x1 - k2 * x2 AS e, i11 * (x1 - m1) + i12 * (x2 - m2) AS p1, i12 * (x1 - m1) + i22 * (x2 - m2) AS p2 FROM base, fit), i AS (SELECT a, b, {infl} FROM q),
 a AS ({sums('a')}), b AS ({sums('b')}), ab AS ({sums('a, b')}), j AS (SELECT * EXCLUDE (c, v0, v1, v2), a.c / (a.c - 1.0::DOUBLE) * (n - 1) / (n - 3) AS fa, b.c / (b.c - 1.0::DOUBLE) * (n - 1) / (n - 3) AS fb,
  {', '.join(f'{t}.v{j} AS {t}v{j}' for t in ('a', 'b', 'ab') for j in range(3))} FROM fit, a, b, ab), r(cov_type, term, coef, v, iid) AS ({cells})
 SELECT term, cov_type, round(coef, 2) AS coef, round(sqrt(v), 3) AS se, round(coef / sqrt(v), 3) AS t, round(sqrt(v / iid), 4) AS inflation FROM r"""


@query(_cluster_sql())
def two_way_clusters(spark, d):
    """Prices on quantity and discount: t under independent errors, errors clustered by month of shipping, by supplier, and both."""
    rows = table(spark, d, "lineitem").withColumn("month", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long"))
    out = residuals.covariances(rows, "l_extendedprice", ["l_quantity", "l_discount"], "month", "l_suppkey")
    return out.select("term", "cov_type", F.round("coef", 2).alias("coef"), F.round("se", 3).alias("se"), F.round("t", 3).alias("t"), F.round("inflation", 4).alias("inflation"))


_PAIRS = """s AS (SELECT c_nationkey AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS t, avg(o_totalprice) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
 p AS (SELECT a.k, b.k AS nb, 1 - corr(a.v, b.v) AS d FROM s a JOIN s b ON a.t = b.t AND a.k <> b.k GROUP BY 1, 2)"""


def _pairs(spark, d):
    """Dissimilarity (1 - r) of all nations' monthly means: k, nb, d; and the means."""
    from aerolith.functions.maths import correlation

    s = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    s = s.groupBy(F.col("c_nationkey").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("t")).agg(F.avg("o_totalprice").alias("v"))
    s = cut(s)  # a row for each nation and month, which all that follows starts from
    met = s.join(s.select(F.col("k").alias("nb"), "t", F.col("v").alias("w")), "t").where("k <> nb")
    return met.groupBy("k", "nb").agg((1 - correlation("v", "w")).alias("d")), s


@query()
def ward_regions(spark, d):
    """Nations in five regions of alike monthly means, with their silhouettes."""
    pairs, s = _pairs(spark, d)
    labels = regions.cut_tree(regions.ward(pairs, "k", "nb", "d"), s, "k", 5)
    return regions.silhouettes(pairs, labels, "k", "nb", "d")


@query(f"""WITH {_PAIRS}, m AS (SELECT k, ntile(5) OVER (ORDER BY avg(v), k) AS l FROM s GROUP BY 1), o AS (SELECT n_nationkey AS k, n_regionkey AS r, l FROM nation JOIN m ON k = n_nationkey),
 i AS (SELECT p.k, a.r AS own, b.r AS other, avg(d) AS m FROM p JOIN o a ON a.k = p.k JOIN o b ON b.k = p.nb GROUP BY 1, 2, 3), w AS (SELECT k, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM i GROUP BY 1),
 e AS (SELECT round(avg(d) FILTER (a.r <> b.r) - avg(d) FILTER (a.r = b.r), 6) AS separation FROM p JOIN o a ON a.k = p.k JOIN o b ON b.k = p.nb),
 c AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS p0, sum(n * ln(n)) AS l0 FROM (SELECT count(*) AS n FROM o GROUP BY r, l)), ca AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS p1, sum(n * ln(n)) AS l1 FROM (SELECT count(*) AS n FROM o GROUP BY r)),
 cb AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS p2, sum(n * ln(n)) AS l2 FROM (SELECT count(*) AS n FROM o GROUP BY l)), t AS (SELECT count(*) AS n FROM o)
 SELECT n, round((p0 - p1 * p2 / (n * (n - 1) / 2.0)) / ((p1 + p2) / 2 - p1 * p2 / (n * (n - 1) / 2.0)), 6) AS adjusted_rand, round((n * ln(n) - l1 - l2 + l0) / (n * ln(n) - (l1 + l2) / 2), 6) AS mutual_information, separation, (SELECT round(avg(round(coalesce((b - a) / greatest(a, b), 0), 6)), 5) FROM w) AS silhouette FROM c, ca, cb, t, e""")
def partition_agreement(spark, d):
    """The official regions of nations against their monthly means, and against fifths of nations by mean."""
    from pyspark.sql import Window

    pairs, s = _pairs(spark, d)
    fifths = s.groupBy("k").agg(F.avg("v").alias("m")).select("k", F.ntile(5).over(Window.orderBy("m", "k")).alias("fifth"))  # nations are a small dimension
    labels = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("label")).join(fifths, "k")
    near = regions.silhouettes(pairs, labels, "k", "nb", "d").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"))
    return regions.agreement(labels, "label", "fifth").crossJoin(regions.separation(pairs, labels, "k", "nb", "d")).crossJoin(near)
