"""Runs over a stream in ten micro-batches, rows out of order, against the same rows in batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aerolith.operators import windows
from aerolith.streaming import runs

KEY = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "entity string, ts timestamp, value double, z double, excursion boolean, direction int"


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, runs.ROCKSDB)
    yield
    spark.conf.set(KEY, before)


def rows_of(seed):
    rng, rows = random.Random(seed), []
    for e in ("a", "b", "c"):
        value, z = 1.0, 0.0
        for h in range(240):
            value = value if rng.random() < 0.6 else float(rng.randint(1, 4))
            z = z if rng.random() < 0.5 else rng.choice([-3.5, 0.5, 3.25, 4.0])
            if rng.random() > 0.05:
                rows.append((e, datetime(2024, 1, 1) + timedelta(hours=h), value, z, abs(z) >= 3, (z > 0) - (z < 0)))
    return rows


def streamed(spark, tmp_path, make, rows, parts=10):
    rng = random.Random(9)
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    end = [("end", datetime(2024, 3, 1) + timedelta(hours=k), 0.0, 9.0, True, 1) for k in (0, 50)]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/99"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = make(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(240)
    assert query.exception() is None and len([p for p in query.recentProgress if p.numInputRows]) > parts
    return spark.read.parquet(str(tmp_path / "out")).where("entity <> 'end'")


def test_stuck_runs(spark, rocksdb, tmp_path):
    rows = rows_of(1)
    got = streamed(spark, tmp_path, lambda s: runs.stuck_runs(s, ["entity"], "ts", "value", least=2, late="30 hours"), rows)
    batch = windows.plateaus(spark.createDataFrame(rows, SCHEMA), ["entity"], "ts", "value").where("length >= 2")
    key = lambda f: sorted((r["entity"], r["start"], r["end"], r["length"], r["value"]) for r in f.collect())
    assert key(got) == key(batch) and got.count() > 50


def test_excursion_runs(spark, rocksdb, tmp_path):
    rows = rows_of(2)
    got = streamed(spark, tmp_path, lambda s: runs.excursion_runs(s, ["entity"], "ts", late="30 hours"), rows)
    batch = windows.excursion_runs(spark.createDataFrame(rows, SCHEMA), ["entity"], "ts")
    key = lambda f: sorted((r["entity"], r["start"], r["end"], r["length"], r["direction"], r["peak_z"], r["peak_at"]) for r in f.collect())
    assert key(got) == key(batch) and got.count() > 50


def test_the_state_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        runs.stuck_runs(spark.createDataFrame([], SCHEMA).select("entity", "ts", F.col("value")), ["entity"], "ts", "value")
