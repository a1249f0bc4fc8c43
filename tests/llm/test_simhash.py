"""op10 against brute force: fingerprints, links within 3 bits and components."""

import re

import numpy as np
import pandas as pd
import xxhash

from aerolith.llm.simhash import _FLIPS, _unpack, _variants, fingerprint, links, near_duplicates

SCHEMA = "doc_id long, text string, fingerprint int"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    """{fingerprint: least fingerprint of its component}."""
    u = np.unique(np.array(prints, dtype=np.uint64))
    near = np.bitwise_count(u[:, None] ^ u) <= 3
    label = np.arange(len(u))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return dict(zip(u.tolist(), u[label].tolist()))
        label = new


def test_fingerprint_matches_its_definition():
    for t in ["", None, " \t ", "One", "One TWO", "a b c", "a  b\nc d", "ÀB çd é f g h", "x " * 5000]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_links_connect_exactly_what_is_within_three_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    f = [base]
    for d in range(1, 6):  # partners at 1 to 5 bits
        x = base[:60].copy()
        for i in range(60):
            for b in rng.choice(64, d, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(b)
        f.append(x)
    dense = np.full(400, base[0])  # a dense group, all within a few bits
    for i in range(400):
        for b in rng.choice(20, rng.integers(0, 4), replace=False):
            dense[i] ^= np.uint64(1) << np.uint64(b)
    far = np.array([1 << 10, (1 << 10) ^ (1 | 1 << 21 | 1 << 42), (1 << 10) ^ (1 << 5 | 1 << 26 | 1 << 47)], dtype=np.uint64)
    f = np.concatenate([*f, dense, far, np.zeros(1, dtype=np.uint64)])
    frame = spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "f long")
    got = {}

    def root(x):
        while got.get(x, x) != x:
            x = got[x]
        return x

    for a, b in links(frame).collect():
        a, b = root(a % 2**64), root(b % 2**64)
        got[max(a, b)] = min(a, b)
    want = slow_components(f)
    assert {v: root(v) for v in want} == want


def test_near_duplicates_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (3, text.upper(), 2), (9, text + " end", 3), (None, text, 4), (7, None, 5), (6, "", 6), (7, None, 5), (8, "other words here entirely", 7)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert len(got) == len(rows)
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    label = slow_components(list(prints.values()))
    for i, f, c in got:
        assert int(f, 16) == prints[i]
        assert c == min(j for j in prints if j is not None and label[prints[j]] == label[prints[i]])


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bytes_sent_for_each_fingerprint_stay_bounded():
    rng = np.random.default_rng(4)
    f = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    frame = pd.DataFrame({"g": 0, "f": f.view(np.int64)})
    variants = int(np.where(np.bitwise_count(f) & 1, 1057, 65).sum())
    for n in (1, 100, 10_000, 1_000_000):  # reducers of 1e4 to 1e10 fingerprints
        sent = _variants(n)(frame)
        assert sum(map(len, sent["payload"])) <= 12 * variants + 4 * len(sent)
        if n == 100:
            back = [_unpack(p) for p in sent["payload"]]
            assert sum(len(x) for x, _ in back) == variants


def test_every_three_bits_hold_a_flipped_pair():
    pairs = set(_FLIPS[65:].tolist())
    assert all({1 << i | 1 << j, 1 << i | 1 << k, 1 << j | 1 << k} & pairs for i in range(64) for j in range(i) for k in range(j))
