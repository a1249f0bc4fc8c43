"""SparkSession settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "aerolith", **more: str) -> SparkSession:
    """A session with SETTINGS; cluster size, memory and shuffle partitions are left to the deployment."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the session names (spark.checkpoint.dir), so that rounds don't grow one plan.

    Where it names none, a local master takes a new local folder, as in tests; a cluster is refused.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        context.setCheckpointDir(named)
    return df.checkpoint()
