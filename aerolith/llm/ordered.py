"""Running sums over all rows of a table in order, without a task that holds more than its share.

Rows are dealt by ranges of their order, equal ones spread by their place in the input, and
written once, so that each row's part is settled. Sums run inside each part and are shifted by
the totals of the parts before: one row for each part and group of `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import stored


def ranged(df: DataFrame, order: list, what: str) -> DataFrame:
    """df as a stored table with `place` (its place in the input) and `part`: a part's rows come before the next part's."""
    df = df.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, "place")
    return stored(df.withColumn("part", F.spark_partition_id()), what)


def running(rows: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """rows of `ranged` by (*by, *order), and for each name in sums the sum of its column up to and with the row.

    by columns hold no nulls. With an empty `by` the totals are one row for each part, and go to all tasks.
    """
    inside = Window.partitionBy("part", *by).orderBy(*order, "place").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part", *by).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    carry = totals.select("part", *by, *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums))
    carry = carry if by else F.broadcast(carry)
    local = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    return local.join(carry, ["part", *by]).select(*rows.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))
