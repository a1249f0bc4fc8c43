"""op7: boundaries against brute force, batches against their definition."""

import itertools
import random
from collections import Counter, defaultdict

from aerolith.llm import packing


def waste(bounds, lengths, counts):
    return sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.choice([1, 2, 3, 500]) for _ in lengths]
        for k in (1, 2, 3, 5, 20):
            got = packing.boundaries(lengths, counts, k)
            assert len(got) <= k and got[-1] == lengths[-1] and got == sorted(set(got))
            best = min(waste([*c, lengths[-1]], lengths, counts) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
            assert waste(got, lengths, counts) == best


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 5, 5, 40, rng.randint(1, 300)]), 7) for i in range(3000)]
    rows += [(None, None, 1), (None, None, 1), (5, rows[5][1], 7), (9001, "w\t" * 900, 1), (9002, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    got = packing.pack(docs, buckets=4, budget=600).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len((t or "").split()) + 1) for i, t, _ in rows)
    batches = defaultdict(list)
    for r in got:
        assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        batches[r["batch_id"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    last = {}
    for b, members in sorted(batches.items()):
        assert len({m["bucket"] for m in members}) == 1
        cap = max(1, 600 // members[0]["bucket_length"])
        assert sorted(m["slot"] for m in members) == list(range(len(members))) and len(members) <= cap
        last.setdefault(members[0]["bucket"], []).append(len(members) == cap)
    assert all(all(full[:-1]) for full in last.values())


def test_nothing_and_one_row(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert packing.pack(docs.limit(0)).collect() == []
    assert [tuple(r) for r in packing.pack(docs).collect()] == [(1, 3, 0, 3, 0, 0, 0)]


def test_long_lengths_stay_within_their_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1, 65536, 65537, 70001, 131072, 131073, 10**7, 10**9 + 1)], "n long")
    for r in df.select("n", packing.binned(df.n).alias("b")).collect():
        assert r["n"] <= r["b"] <= r["n"] * (1 + 1 / 1000)


def test_alike_rows_fill_batches_like_others(spark):
    rows = [(None, "a b", 1)] * 9000 + [(7, "a b", 1)] * 50 + [(i, "c", 2) for i in range(100)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket int"), buckets=2, budget=30).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(i), len(t.split()) + 1) for i, t, _ in rows)
    assert len({(r["batch_id"], r["slot"]) for r in out}) == len(out)
    sizes = Counter((r["bucket"], r["batch_id"]) for r in out)
    for bucket in {b for b, _ in sizes}:
        per = 30 // next(r["bucket_length"] for r in out if r["bucket"] == bucket)
        assert sum(n < per for (b, _), n in sizes.items() if b == bucket) <= 1 and all(n <= per for (b, _), n in sizes.items() if b == bucket)
