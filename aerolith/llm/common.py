"""Helpers shared by the corpus operators: shared storage, bucketed text, byte arrays.

The operators that compare texts with each other follow one pattern. Texts are dealt once
into *groups* of a few megabytes (`grouped_texts`), stored as a table bucketed by group, so
that later passes find each group without another shuffle of text. Each pass over a group
condenses what others must know into sorted numpy arrays, one packed row for each reducer
(`packed`), which act like a map-side combine: a value held by a third of all rows costs one
entry for each group, never one for each row.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a group: what one Python call holds at a time.
GROUP_BYTES = 8 << 20
#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 1000
#: Buckets of a stored table; groups beyond it share buckets.
MAX_BUCKETS = 20_000

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, spark.checkpoint.dir.

    Where that is unset, a new local folder is set on a local master, as in tests; on a cluster,
    whose executors could not read each other's, it is an error. All that the operators keep lies
    in this one folder, which can be deleted once the application's results are written.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/aerolith-{spark.sparkContext.applicationId}"


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Arrow batches of at most `rows` rows in this session: texts are long, and a batch is held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_groups(docs: DataFrame, text: str, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups of about group_bytes the texts make; enough for a few to each core."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = 4 * docs.sparkSession.sparkContext.defaultParallelism
    return int(max(1, -(-size // group_bytes), min(least, -(-size // (1 << 18)))))


def grouped_texts(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES, more: dict | None = None) -> tuple[DataFrame, int]:
    """Table (id, text binary, g int, and the columns in more), bucketed by g, and the number of groups.

    Rows are dealt by the hash of id and text and a salt that changes every 64 rows of a task, so
    copies of one text, and rows alike in id and text too, spread over all groups. The table is
    written once and only read from then on, so a row's group is settled; docs should come from files,
    as rows that change places when a task runs anew could change groups. Null texts count as empty.
    """
    n = n_groups(docs, text_col, group_bytes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.shiftright(F.monotonically_increasing_id(), 6)
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(id_col), text, salt), F.lit(n)).cast("int").alias("g"), *(c.alias(k) for k, c in (more or {}).items()))
    return bucketed(rows, "g", n), n


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by a key of n values, so that passes by key need no shuffle.

    Its name leaves the catalogue at once: the frame knows files and buckets, nobody else needs it.
    """
    spark = df.sparkSession
    name = f"aerolith_{uuid.uuid4().hex}"
    (
        df.repartition(min(n, MAX_BUCKETS), key)
        .write.option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{name}")
        .bucketBy(min(n, MAX_BUCKETS), key)
        .sortBy(key)
        .saveAsTable(name)
    )
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def route(hashes: np.ndarray, n: int) -> np.ndarray:
    """Reducer 0..n-1 of 64-bit hashes; it grows with the hash, so sorted hashes give runs."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def slices(sorted_hashes: np.ndarray, n: int):
    """(reducer, start, end) of each run in sorted hashes."""
    to = route(sorted_hashes, n)
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(to)]):
        if b > a:
            yield int(to[a]), int(a), int(b)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got) <= n:
        size = max(n + 1, 1 << 16)
        x = np.full(size, base, dtype=U64)
        x[0] = 1
        np.cumprod(x, out=x)
        if size > 1 << 22:
            return x
        got = _POWERS[base] = x
    return got


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hashes of data[start:end] (uint8) that depend on the bytes and the length alone."""
    pw = powers(base, len(data))
    inverse = powers(pow(base, -1, 1 << 64), len(data))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * pw[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def squeeze(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def unsqueeze(data: bytes) -> bytes:
    return zlib.decompress(data)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start..start+length-1 of each, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc_rest(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))
