"""The observation store and exports: strict schema, partition-wise replacement, JSON rectangles, sorted station-days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.FloatType()),
        T.StructField("flag", T.StringType()),
        T.StructField("value_retained", T.BooleanType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """df in the store's columns, order and types; year and month come from ts."""
    made = df.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    lacking = [f.name for f in OBSERVATION if f.name not in made.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION))


def problems(df: DataFrame, flags: list[str]) -> dict[str, int]:
    """How many rows break each rule of the store; one aggregate."""
    from aerolith.operators.qc import validation

    rules = {"null_ts": F.col("ts").isNull(), "null_flag": F.col("flag").isNull(), "unknown_flag": ~F.col("flag").isin(*flags), "valid_without_value": (F.col("flag") == "valid") & F.col("value").isNull()}
    row = validation(df, ["station", "item", "ts"], rules).first().asDict()
    row.pop("rows")
    return {k: v for k, v in row.items() if v}


def write_observations(df: DataFrame, root: str, flags: list[str]) -> None:
    """Replaces the (year, month) partitions that df has, whole; others stay. Refuses rows that break a rule."""
    rows = conform(df)
    if bad := problems(rows, flags):
        raise ValueError(f"not written: {bad}")
    rows.repartition("year", "month").sortWithinPartitions("station", "item", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(root)


def scan_observations(spark: SparkSession, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The store, between two dates if given (until is left out): months are pruned by partition, the rest filtered by ts."""
    df = spark.read.parquet(root)
    month = F.col("year") * 12 + F.col("month")
    if since:
        df = df.where((month >= int(since[:4]) * 12 + int(since[5:7] or 1)) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    if until:
        df = df.where((month <= int(until[:4]) * 12 + int(until[5:7] or 12)) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return df


def repair(spark: SparkSession, root: str, staging: str, qc) -> int:
    """Applies qc to the store, writes the changed partitions to staging and then replaces them; returns how many rows changed."""
    old = scan_observations(spark, root)
    new = conform(qc(old))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    both = old.select("station", "item", "ts", F.col("value").isNull().alias("v0"), F.col("flag").alias("f0")).join(new.select("station", "item", "ts", "year", "month", F.col("value").isNull().alias("v1"), F.col("flag").alias("f1")), ["station", "item", "ts"])
    changed = both.where(~same("v0", "v1") | ~same("f0", "f1"))
    parts = changed.groupBy("year", "month").count().collect()  # one row for each changed month
    if parts:
        touched = new.join(F.broadcast(changed.select("year", "month").distinct()), ["year", "month"], "left_semi")
        touched.write.mode("overwrite").partitionBy("year", "month").parquet(staging)
        fresh = spark.read.schema(OBSERVATION).parquet(staging)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(root)
    return sum(r["count"] for r in parts)


def rectangle(df: DataFrame, row: str, column: str, value: Column, by: list[str]) -> DataFrame:
    """Per group JSON of rows, columns and the matrix of values in their order; absent cells are null. Axes are small."""
    cells = df.groupBy(*by, row, column).agg(F.first(value).alias("__v"))
    rows, columns = cells.select(*by, row).distinct(), cells.select(*by, column).distinct()
    full = rows.join(columns, by) if by else rows.crossJoin(columns)
    full = full.join(cells, [*by, row, column], "left")
    lines = full.groupBy(*by, row).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.col("__v").alias("v")))).alias("cells"))
    out = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "cells"))).alias("lines"))
    keep = {"ignoreNullFields": "false"}
    body = F.struct(F.transform("lines", lambda x: x.r).alias("rows"), F.transform(F.col("lines")[0].cells, lambda x: x.c).alias("columns"), F.transform("lines", lambda x: F.transform(x.cells, lambda y: y.v)).alias("values"))
    return out.select(*by, F.to_json(body, keep).alias("json"))


def write_station_days(df: DataFrame, path: str, item: str, station: str, date: str) -> None:
    """One folder for each item, sorted by station and date, in row groups small enough to skip."""
    df.repartition(item).sortWithinPartitions(station, date).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy(item).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is an empty field."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """One Parquet folder for each named table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root.rstrip('/')}/{name}")


def sql(spark: SparkSession, text: str, limit: int = 500) -> tuple[list, int, bool]:
    """Up to `limit` rows of a query, its true number of rows, and whether rows were left out; counted in a second run only where they were."""
    df = spark.sql(text)
    rows = df.limit(limit + 1).collect()
    total = df.count() if len(rows) > limit else len(rows)
    rows = rows[:limit]
    return rows, total, total > len(rows)
