"""op13 against its definition: sizes, cuts at equal targets, slots."""

import zlib
from collections import defaultdict

from aerolith.llm import sharding


def check(docs, rows, shards):
    got = sharding.shard(docs, shards).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for members in by.values():
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
    total, before = sum(r["size"] for r in got), 0
    for r in got:
        assert r["shard"] == (2 * before + r["size"]) * shards // (2 * total)
        before += r["size"]
    return by, total


def test_cuts_at_equal_targets(spark):
    rows = [(i * 7 % 4001, "é" * (i * i % 97) + "x" * (i % 13)) for i in range(4001)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    by, total = check(docs, rows, 24)
    assert len(by) == 24 and all(abs(sum(m["size"] for m in x) - total / 24) <= 97 * 2 + 21 for x in by.values())


def test_a_third_alike_nulls_and_ties(spark):
    rows = [(None, None)] * 700 + [(None, f"t{i}") for i in range(300)] + [(5, "same")] * 900 + [(i, "") for i in range(800)] + [(9, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(docs, rows, 24)
    check(docs, rows, 3)


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    check(docs, [(1, "a"), (2, None)], 24)
    assert sharding.shard(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
