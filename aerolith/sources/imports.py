"""Validated imports: expected keys against found ones, archive listings, manifests."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_ledger(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side with its rows and state: present, missing, unexpected or repeated."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    both = expected.select(*keys, F.lit(True).alias("__e")).distinct().join(n, keys, "full")
    state = F.when(F.col("__e").isNull(), "unexpected").when(F.col("rows").isNull(), "missing").when(F.col("rows") > 1, "repeated").otherwise("present")
    return both.select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state"))


def complete(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """found, if its keys are exactly the expected ones, once each; else an error with the counts of each state."""
    bad = {r["state"]: r["count"] for r in key_ledger(found, expected, keys).groupBy("state").count().collect() if r["state"] != "present"}
    if bad:
        raise ValueError(f"keys are not complete: {bad}")
    return found


def describe_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of the zip archives under path: name, sizes, and whether the name is safe to unpack."""

    def look(batches):
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield pd.DataFrame([(where, i.filename, i.file_size, i.compress_size, not (i.filename.startswith("/") or ".." in i.filename.split("/"))) for i in z.infolist()], columns=["path", "member", "bytes", "packed", "safe"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(look, "path string, member string, bytes long, packed long, safe boolean")


def manifest(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Rows and an order-free checksum of each table; one aggregate each."""
    out = {}
    for name, df in tables.items():
        h = F.xxhash64(*(F.col(c) for c in sorted(df.columns)))
        n, low, total = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        out[name] = {"rows": n, "checksum": f"{(low or 0) & (2**64 - 1):016x}-{total or 0}", "columns": sorted(df.columns)}
    return out


def upsert_csv(spark: SparkSession, new: DataFrame, path: str, keys: list[str], out: str) -> DataFrame:
    """A CSV summary with new rows in place of old ones of the same key, written to `out` in key order."""
    from aerolith.operators.joins import upsert
    from aerolith.sources.stores import write_csv

    old = spark.read.option("header", True).schema(new.schema).csv(path)
    rows = upsert(old, new, keys).orderBy(*keys)
    write_csv(rows, out)
    return rows
