"""Runs of one label at hourly steps, kept up over a stream with late rows: plateaus of a sensor, excursions of one direction.

Rows wait, in state, until the watermark has passed them, so that they are taken in order of time
however they arrived; a run is given out once the watermark has passed the hour in which it could
have gone on. What a stream gives is then what `operators.windows` gives for the same rows in batch,
but for runs that the watermark has not closed yet. State is one open run and the rows not yet
passed, for each entity. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Runs(StatefulProcessor):
    """Keys are entities; rows have run_micros, run_label and run_measure (names that begin with an underscore don't reach Python)."""

    def __init__(self, entity: list[str], least: int):
        self.entity, self.least = entity, least
        self.columns = [*entity, "label", "start", "end", "length", "peak", "peak_at"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "label double, measure double")
        self.run = handle.getValueState("run", "label double, start long, end long, length long, peak double, peak_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for at, label, measure in zip(*(b[c].tolist() for c in ("run_micros", "run_label", "run_measure"))):
                self.waiting.updateValue((at,), (label, measure))
                # the row can be taken once its time has passed, and a run that it ends an hour later
                for due in (at, at + HOUR):
                    self.handle.registerTimer(due // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(at for (at,) in self.waiting.keys() if at < passed)
        run, done = self.run.get(), []
        before = run
        for at in due:
            label, measure = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            if run is not None and label == run[0] and at - run[2] == HOUR:
                higher = abs(measure) > abs(run[4])
                run = (run[0], run[1], at, run[3] + 1, measure if higher else run[4], at if higher else run[5])
            else:
                done.append(run)
                run = (label, at, at, 1, measure, at)
        if run is not None and run[2] + HOUR < passed:
            done.append(run)
            run = None
        if run is None:
            if before is not None:
                self.run.clear()
        elif run != before:
            self.run.update(tuple(run))
        out = [(*key, r[0], *(pd.Timestamp(t, unit="us") for t in (r[1], r[2])), r[3], r[4], pd.Timestamp(r[5], unit="us")) for r in done if r is not None and r[3] >= self.least]
        return iter([pd.DataFrame(out, columns=self.columns)] if out else [])

    def close(self) -> None:
        pass


def label_runs(stream: DataFrame, entity: list[str], ts: str, label: Column, measure: Column, least: int = 1, late: str = "2 hours") -> DataFrame:
    """entity, label, start, end, length, peak, peak_at of each closed run of an equal label at exact hourly steps; peak is the measure of the largest size, the first of equal ones.

    Rows without a label break runs by their absence. The session needs the RocksDB state store.
    """
    session = stream.sparkSession
    if session.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    kinds = dict(stream.dtypes)
    at = F.col(ts).cast("timestamp")
    rows = stream.select(*entity, at.alias("run_ts"), F.unix_micros(at).alias("run_micros"), label.cast("double").alias("run_label"), measure.cast("double").alias("run_measure")).where("run_label IS NOT NULL").withWatermark("run_ts", late)
    head = ", ".join(f"{e} {kinds[e]}" for e in entity)
    schema = f"{head}, label double, start timestamp, end timestamp, length long, peak double, peak_at timestamp"
    return rows.groupBy(*entity).transformWithStateInPandas(statefulProcessor=_Runs(entity, least), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stuck_runs(stream: DataFrame, entity: list[str], ts: str, value: str, least: int = 2, late: str = "2 hours") -> DataFrame:
    """Plateaus, as `operators.windows.plateaus` gives them: entity, value, start, end, length."""
    out = label_runs(stream, entity, ts, F.col(value), F.col(value), least, late)
    return out.select(*entity, F.col("label").alias(value), "start", "end", "length")


def excursion_runs(scored: DataFrame, entity: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Excursions of one direction, as `operators.windows.excursion_runs` gives them, from a stream of rows with z, excursion and direction."""
    out = label_runs(scored.where("excursion"), entity, ts, F.col("direction"), F.col("z"), 1, late)
    return out.select(*entity, "start", "end", "length", F.col("label").cast("int").alias("direction"), F.col("peak").alias("peak_z"), "peak_at")
