"""Packing into optimal length buckets and token-budget batches.

Texts padded to their bucket's boundary waste boundary - length tokens each. Dynamic
programming over the global histogram of lengths finds the boundaries that waste least in
total (`boundaries`); the histogram has a bounded number of bins, as lengths beyond
EXACT_LENGTHS are rounded up to 1/1024 of their size for it (which only decides where a
boundary lies; every text still fits). Inside a bucket, batches are filled to the token
budget: rows alike in id and length are counted, in portions of SHARD_ROWS at most; portions
are dealt by hash to shards of about SHARD_ROWS rows, numbered in their shard, and shifted by
the counts of the shards before; then they become rows again. So neither a bucket nor an id that
many rows share gathers in one task, and only a bucket's last batch may be short. A text longer
than the budget is a batch of its own.

Nulls and empty texts have one token, their end. Rows may repeat; ids may be null. Only ids and
texts are read; an empty table has no batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import stored

BUCKETS = 8
BUDGET = 65_536
EXACT_LENGTHS = 65_536
SHARD_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str):
    """Words of a text and its end."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long") + 1


def binned(length):
    """The length itself up to EXACT_LENGTHS, else rounded up to a multiple of its power of two / 1024."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT_LENGTHS)))) - 10).cast("long")
    return F.when(length <= EXACT_LENGTHS, length).otherwise(((length + step - 1) / step).cast("long") * step)


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets over sorted distinct lengths with the least padded total; exact integers.

    best[k][j] = min over i < j of best[k-1][i] + length[j] * (count of lengths i+1..j): lines
    of falling slope queried at rising lengths, so one pass over a convex hull for each bucket.
    """
    n = len(lengths)
    if not n:
        return []
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    best = [0] + [None] * n
    picks = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, offset, i
        head, new, pick = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(n + 1):
            if j:
                x = lengths[j - 1]
                while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                    head += 1
                if head < len(hull):
                    m, c, i = hull[head]
                    new[j], pick[j] = m * x + c + x * before[j], i
            if best[j] is not None:
                line = (-before[j], best[j], j)
                while len(hull) - head >= 2:
                    (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                    if (line[1] - c1) * (m1 - m2) <= (c2 - c1) * (m1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
        picks.append((new[n], pick))
        best = new
    k = min(range(len(picks)), key=lambda k: (picks[k][0] is None, picks[k][0] or 0, k))
    out, j = [], n
    while k >= 0:
        out.append(lengths[j - 1])
        j, k = picks[k][1][j], k - 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row for each row of docs: id, n_tokens, bucket, bucket_length, batch_id, slot, padding."""
    rows = docs.select(F.col(id_col).alias("id"), n_tokens(text_col).alias("n_tokens"))
    rows = stored(rows.groupBy("id", "n_tokens").agg(F.count(F.lit(1)).alias("rows")), "lengths")
    histogram = sorted(map(tuple, rows.groupBy(binned(F.col("n_tokens")).alias("length")).agg(F.sum("rows")).collect()))
    bounds = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    sizes = [sum(c for x, c in histogram if a < x <= b) for a, b in zip([0, *bounds], bounds)]
    # a boundary for each bucket, rows in a batch, shards, and batches before it
    cap = [max(1, budget // b) for b in bounds]
    shards = [-(-s // SHARD_ROWS) for s in sizes]
    first = np.cumsum([0, *(-(-s // c) for s, c in zip(sizes, cap))]).tolist()
    of = lambda values, default=1: F.coalesce(F.element_at(F.array(*map(F.lit, values or [default])), F.col("bucket") + 1), F.lit(default))
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    portion = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SHARD_ROWS)))
    rows = rows.withColumn("portion", portion).withColumn("rows", F.least(F.lit(SHARD_ROWS), F.col("rows") - F.col("portion") * SHARD_ROWS))
    rows = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("id", "n_tokens", "portion"), of(shards).cast("long")))
    counts = rows.groupBy("bucket", "shard").agg(F.sum("rows").alias("count"))
    ahead = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("id"), "id", "n_tokens", "portion").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("inside", F.sum("rows").over(inside) - F.col("rows")).join(offsets, ["bucket", "shard"])
    numbered = numbered.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    place = F.col("ahead") + F.col("inside") + F.col("k")
    return numbered.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        of(bounds).cast("long").alias("bucket_length"),
        (of(first).cast("long") + F.floor(place / of(cap))).cast("long").alias("batch_id"),
        (place % of(cap)).cast("int").alias("slot"),
        (of(bounds) - F.col("n_tokens")).cast("long").alias("padding"),
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every row of `documents`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
