"""Steps whose rows must not grow faster than their input: what meets before sums, which pairs are made, how bins are cut."""

import pytest

from aerolith.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


def _joined_below_sums(plan) -> bool:
    def holds(node) -> bool:
        return node.nodeName() == "Join" or any(holds(node.children().apply(i)) for i in range(node.children().size()))

    children = [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.nodeName() == "Aggregate" and any(map(holds, children))) or any(map(_joined_below_sums, children))


@pytest.mark.parametrize("name", ["agreement_days", "sensor_pairs"])
def test_readings_are_summed_before_stations_are_named(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed()
    assert not _joined_below_sums(plan)


def test_radius_pairs_are_dealt_by_work_not_by_bytes(spark):
    from pyspark.sql import functions as F

    from aerolith.operators import joins

    df = spark.range(0, 2500, 1, 1).select("id", F.lit(25.0).alias("lat"), F.lit(121.0).alias("lon"))
    met = joins.within_radius(df, df.withColumnRenamed("id", "other"), ("id", "lat", "lon"), ("other", "lat", "lon"), 5.0)
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert sum(tasks) == 2500**2 and max(tasks) < 0.7 * sum(tasks)
