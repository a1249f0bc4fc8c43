"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

All rows stand in the order of their id (nulls first, then by checksum, size and place in the
input). Bytes run up inside each range partition and are shifted by the totals of the partitions
before (`ordered.running`); a row goes to the shard in whose equal share of all bytes its middle
lies. So every shard is a range of ids, and its bytes miss an equal share by half a row at each
end at most. Equal texts go where their ids go: a group of copies may hold a third of all bytes,
which no shard of equal bytes could take whole.

A null text has no bytes, an empty one none either: both have size 8. Rows alike in all are
numbered by their place, which doesn't show in the result. An empty table has no shards; with
fewer rows than shards some shards stay empty. Only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.ordered import ranged, running

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot (from 0 in each shard), grown_shard (null, as bytes decide)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["id", "text_crc32", "size"]
    rows = ranged(rows, order, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    rows = running(rows, [], order, {"end": F.col("size"), "nth": F.lit(1)})
    rows = rows.withColumn("shard", F.expr(f"cast(((2 * end - size) * {shards}) div (2 * {total}) as int)"))
    first = rows.groupBy("shard").agg(F.min("nth").alias("first"))
    return rows.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard, slot, size and checksum of every row of `documents`; nulls, ties and empty tables as in the module's text."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 (reflected polynomial 0xEDB88320) as DuckDB can say it: a table by its rule, folded over the bytes in hexadecimal.
CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"

ORACLE_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, n, list_transform(range(n), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS bytes FROM d),
s AS (SELECT doc_id, CAST(n + {ROW_BYTES} AS BIGINT) AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc),
r AS (SELECT *, sum(size) OVER o AS e, row_number() OVER o AS nth, sum(size) OVER () AS total FROM s WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CAST(((2 * e - size) * {SHARDS}) // (2 * total) AS INT) AS shard FROM r)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
