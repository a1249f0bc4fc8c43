"""Event-time windows with watermarks over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def gated_windows(stream: DataFrame, keys: list[str], ts: str, value: str, width: str = "1 day", late: str = "2 hours", least: int = 16) -> DataFrame:
    """Mean, min, max and count per key and window; the mean is null under `least` readings. Works in batch as well."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("__mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_valid"))
    return out.select(*keys, F.col("w.start").alias("start"), F.when(F.col("n_valid") >= least, F.col("__mean")).alias("mean"), "min", "max", "n_valid", (F.col("n_valid") >= least).alias("meets_threshold"))


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs of readings with less than `gap` between them."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    s = F.session_window(ts, gap)
    return rows.groupBy(*keys, s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def replace_partitions(stream: DataFrame, root: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """Writes each micro-batch by replacing the partitions it holds whole, so a batch that is retried changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def freshness(df: DataFrame, ts: str, now: str) -> DataFrame:
    """Latest reading and the whole hours from it to `now`."""
    latest = F.max(ts)
    hours = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(latest.cast("timestamp"))) / 3600)
    return df.agg(latest.alias("latest"), hours.cast("long").alias("lag_hours"))
