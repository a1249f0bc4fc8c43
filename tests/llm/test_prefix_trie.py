"""op12 against rebuilt conversations as tuples of turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from aerolith.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part string"


def slow(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100 * (1 if c >= 0 else -1))
        built[c] = tuple(seqs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if built[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def fast(spark, rows, **how):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()
    return sorted(tuple(-(10**9) if v is None else v for v in r) for r in got)


def some(rng, convs, words):
    rows = []
    for c in convs:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(words)) for _ in range(rng.randint(1, 9))]
        rows += [(c, k if k else rng.choice([0, None]), role, text, 1, "x") for k, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_tuples(spark, seed):
    rng = random.Random(seed)
    ids = [*range(0, 260, 3), *range(-150, 0, 7), 100_000, 100_003, 700, 701]
    rows = some(rng, ids, ["a", "é", "", None, "long " * 20])
    rng.shuffle(rows)
    assert fast(spark, rows) == slow(rows)


def test_a_long_conversation_and_many_copies(spark):
    long = [(200, k, "u", f"t{k % 7}", 0, "") for k in range(700)]
    twin = [(300, k, "u", f"t{k % 7}", 0, "") for k in range(650)]
    copies = [(c, k, "u", "same", 0, "") for c in range(1000, 1400) for k in range(3)]
    # each leaves the one before a turn later: paths hang off paths
    stairs = [(5000 + 100 * k, j, "u", "s" if j < k else f"own{k}", 0, "") for k in range(20) for j in range(k + 1)]
    rows = long + twin + copies + stairs
    assert fast(spark, rows) == slow(rows)


def test_turnless_conversations_nulls_and_nothing(spark):
    rows = [(1, None, None, None, 1, ""), (2, 0, "u", "x", 1, ""), (None, 0, "u", "x", 1, ""), (101, 0, "u", "y", 1, ""), (7, 3, "u", "b", 1, ""), (7, 3, "u", "b", 1, "")]
    assert fast(spark, rows) == slow(rows)
    assert fast(spark, [(None, 1, "u", "x", 1, "")]) == []
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_failed_check_takes_other_multipliers(spark, monkeypatch):
    real = prefix_trie.Multipliers

    class Weak(real):
        def __init__(self, seed):
            super().__init__(seed)
            if seed == 1:
                self.base = [1] * prefix_trie.LANES  # a product without order: swapped turns collide

    monkeypatch.setattr(prefix_trie, "Multipliers", Weak)
    # conversations without a head
    free = [c for c in range(4000) if zlib.crc32(str(c).encode()) % 6 == 0][:2]
    rows = [(free[0], 0, "u", "a", 0, ""), (free[0], 1, "u", "b", 0, ""), (free[1], 0, "u", "b", 0, ""), (free[1], 1, "u", "a", 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert not prefix_trie._nodes(prefix_trie.prefixes(prefix_trie.turns(frame, Weak(1)), Weak(1)), Weak(1))[1]
    assert fast(spark, rows) == slow(rows)
