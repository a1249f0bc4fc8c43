"""Regions of stations: Ward's clustering by reciprocal nearest neighbours, silhouettes, agreement of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.session import cut


def ward(pairs: DataFrame, key: str, neighbour: str, distance: str) -> DataFrame:
    """gone, into, height, size: Ward's tree from all directed pairs' distances; a cluster bears its smallest key.

    In each round every cluster finds its nearest, and all pairs that chose each other merge at
    once. Ward's distance is reducible (a merger comes no nearer to a third than the nearer of its
    two), so this gives the tree that merging the nearest pair of all, again and again, would
    give, in few rounds. Ties go to the pair of smaller keys. Distances to merged clusters follow
    from those before (Lance and Williams), first on one side of the pairs, then on the other.
    """
    spark = pairs.sparkSession
    now = pairs.select(F.col(key).alias("a"), F.col(neighbour).alias("b"), F.pow(F.col(distance).cast("double"), 2).alias("d2"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))
    now, tree = cut(now), None
    while now.limit(1).count():
        pair = F.struct("d2", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
        near = now.groupBy("a").agg(F.min(F.struct(pair.alias("pair"), "b", "na", "nb")).alias("m")).select("a", "m.pair.d2", "m.pair.p", "m.pair.q", "m.b", "m.na", "m.nb")
        mutual = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
        mutual = cut(mutual.select(F.col("a").alias("into"), F.col("b").alias("gone"), "d2", (F.col("na") + F.col("nb")).alias("size")))
        merged = mutual.select("gone", "into", F.sqrt("d2").alias("height"), "size")
        tree = merged if tree is None else cut(tree.unionByName(merged))
        new = mutual.select(F.col("into").alias("old"), F.col("gone").alias("twin"), "into", "d2", "size").unionByName(mutual.select(F.col("gone").alias("old"), F.col("into").alias("twin"), "into", "d2", "size"))
        for one, other in (("a", "b"), ("b", "a")):
            joined = new.select(F.col("old").alias(one), "twin", "into", F.col("d2").alias("inner"), "size")
            rows = now.join(joined, one, "left").where(f"twin IS NULL OR twin <> {other}")
            n, m = F.col(f"n{one}"), F.col(f"n{other}")
            rows = rows.groupBy(F.coalesce("into", one).alias("x"), F.col(other).alias("y")).agg(
                F.sum((n + m) * F.col("d2")).alias("s"), F.max("inner").alias("inner"), F.coalesce(F.max("size"), F.max(n)).alias("nx"), F.max(m).alias("ny"), F.max("d2").alias("d2")
            )
            d2 = F.when(F.col("inner").isNull(), F.col("d2")).otherwise((F.col("s") - F.col("ny") * F.col("inner")) / (F.col("nx") + F.col("ny")))
            now = rows.select(F.col("x").alias(one), F.col("y").alias(other), d2.alias("d2"), F.col("nx").alias(f"n{one}"), F.col("ny").alias(f"n{other}"))
        now = cut(now.select("a", "b", "d2", "na", "nb"))
    kind = dict(pairs.dtypes)[key]
    return tree if tree is not None else spark.createDataFrame([], f"gone {kind}, into {kind}, height double, size long")


def cut_tree(tree: DataFrame, keys: DataFrame, key: str, clusters: int) -> DataFrame:
    """key and label (its cluster's smallest key) with the lowest merges done, down to `clusters` of them. keys is a small dimension."""
    order = Window.orderBy("height", "gone")
    low = tree.withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()) + 1).where(F.col("__r") <= F.col("__n") - clusters)
    at = cut(keys.select(F.col(key).alias("k")).distinct().join(low.select(F.col("gone").alias("k"), "into"), "k", "left").select("k", F.coalesce("into", "k").alias("label")))
    while True:
        further = cut(at.join(at.select(F.col("k").alias("label"), F.col("label").alias("up")), "label").select("k", F.col("up").alias("label")))
        if not further.join(at.withColumnRenamed("label", "was"), "k").where("label <> was").limit(1).count():
            return further.select(F.col("k").alias(key), "label")
        at = further


def silhouettes(pairs: DataFrame, labels: DataFrame, key: str, neighbour: str, distance: str, label: str = "label") -> DataFrame:
    """key, label, silhouette of each: how much nearer its own cluster is than the next, -1 to 1; 0 for one alone."""
    mine = labels.select(key, F.col(label).alias("__own"))
    met = pairs.join(mine, key).join(labels.select(F.col(key).alias(neighbour), F.col(label).alias("__other")), neighbour)
    means = met.groupBy(key, "__own", "__other").agg(F.avg(distance).alias("m"))
    same = F.col("__own") == F.col("__other")
    told = means.groupBy(key).agg(F.max(F.when(same, F.col("m"))).alias("a"), F.min(F.when(~same, F.col("m"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return labels.select(key, label).join(told, key, "left").select(key, label, F.round(s, 6).alias("silhouette"))


def separation(pairs: DataFrame, labels: DataFrame, key: str, neighbour: str, distance: str, label: str = "label") -> DataFrame:
    """One row: mean distance between clusters less mean distance within."""
    met = pairs.join(labels.select(key, F.col(label).alias("__own")), key).join(labels.select(F.col(key).alias(neighbour), F.col(label).alias("__other")), neighbour)
    same = F.col("__own") == F.col("__other")
    return met.agg(F.round(F.avg(F.when(~same, F.col(distance))) - F.avg(F.when(same, F.col(distance))), 6).alias("separation"))


def agreement(df: DataFrame, one: str, other: str) -> DataFrame:
    """One row: n, adjusted Rand index and normalised mutual information (by the mean entropy) of two labels of the same rows; 1 where both are one cluster."""
    cells = df.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(one).alias("a"), F.col(other).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sets = cells.groupingSets([["a", "b"], ["a"], ["b"], []], "a", "b").agg(F.grouping_id().alias("which"), F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    sums = sets.groupBy("which").agg(F.sum(n * (n - 1) / 2).alias("pairs"), F.sum(n * F.log(n)).alias("nlogn"), F.sum("n").alias("total"))
    of = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    t = sums.agg(*(of(w, c).alias(f"{c}{w}") for w in (0, 1, 2, 3) for c in ("pairs", "nlogn")), of(3, "total").alias("n"))
    expected = F.try_divide(F.col("pairs1") * F.col("pairs2"), F.col("pairs3"))
    rand = F.try_divide(F.col("pairs0") - expected, (F.col("pairs1") + F.col("pairs2")) / 2 - expected)
    # n times the entropies: n log n less the sum of c log c
    mutual = F.col("nlogn3") - F.col("nlogn1") - F.col("nlogn2") + F.col("nlogn0")
    nmi = F.try_divide(mutual, F.col("nlogn3") - (F.col("nlogn1") + F.col("nlogn2")) / 2)
    return t.select("n", F.round(F.coalesce(rand, F.lit(1.0)), 6).alias("adjusted_rand"), F.round(F.coalesce(nmi, F.lit(1.0)), 6).alias("mutual_information"))
