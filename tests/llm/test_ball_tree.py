"""op11 against brute force over whole integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from aerolith.llm import ball_tree

DOCS, ITEMS = "doc_id long, text string, score int", "item_id long, text string, rank int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    bags = [(i, Counter(words(t))) for i, t, _ in docs if words(t)]
    n_docs, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    texts = {}
    for i, t, _ in items:
        texts.setdefault(i, set()).add(t or "")
    for item, ts in texts.items():
        scored = []
        query = Counter(w for t in ts for w in words(t))
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, k in query.items() if bag[t])
            if s > 0:
                scored.append((-s, i is not None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:20])]
    return sorted(out, key=str)


def some(seed, n, vocabulary):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(vocabulary) if rng.random() < 0.5 else vocabulary[int(rng.random() ** 4 * len(vocabulary))] for _ in range(k))
    docs = [(i * 3, text(rng.randint(0, 60)), 1) for i in range(n)]
    docs += [(10**6 + i, docs[5][1], 1) for i in range(n // 3)] + [(None, docs[7][1], 1), (None, None, 1), (2, "", 1), (3, "...", 1), (3, docs[9][1], 1)]
    items = [(i, text(rng.randint(1, 30)), 0) for i in range(25)] + [(None, "Alpha beta", 0), (90, None, 0), (91, "zzzz", 0), (0, "alpha", 0), (0, "alpha", 0)]
    return docs, items


VOCABULARY = ["alpha", "Beta", "gamma9", "été", "ÉTÉ", "x_y", "42"] + [f"w{k}" for k in range(400)]


@pytest.mark.parametrize("block_terms", [1 << 20, 150])
def test_best_documents(spark, monkeypatch, block_terms):
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    docs, items = some(3, 900, VOCABULARY)
    got = ball_tree.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_terms=block_terms).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(docs, items)


def test_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a", 0)], DOCS), spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert ball_tree.search(docs.limit(0), items).collect() == []
    assert ball_tree.search(docs, items.limit(0)).collect() == []
    assert ball_tree.search(spark.createDataFrame([(1, None, 0)], DOCS), items).collect() == []
    two = [(1, "a", 0), (2, "b", 0)]
    assert [tuple(r) for r in ball_tree.search(spark.createDataFrame(two, DOCS), items).collect()] == slow(two, [(1, "a", 0)])


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ball_tree, "PIECE", 7)
    text = "Ab cdefghijklém n,o;pq " * 50 + "x" * 90
    assert ball_tree.terms_of(text) == Counter(w.encode() for w in words(text))


def test_bounds_hold_and_subtrees_are_left_out():
    rng = np.random.default_rng(1)
    # near copies of forty documents, each with words of its own
    lengths = np.full(2000, 12)
    subject = rng.integers(0, 40, 2000)
    terms = (subject[:, None] * 50 + np.arange(12)).ravel()
    g, weights = 500_000 + rng.integers(0, 9000, len(terms)), rng.integers(1, 9000, 2000)
    scale = np.sqrt(weights.astype(float))
    tree = ball_tree.Tree(lengths, terms, g, scale)
    query = np.arange(12) + 50 * 7
    exact = np.bincount(np.repeat(np.arange(2000), lengths), np.where(np.isin(terms, query), g * weights[terms], 0)).astype(np.int64)
    best, seen = ball_tree.Best(), 0
    for docs, scores in tree.search(query, weights[query], scale, best.floor):
        assert (scores == exact[docs]).all()
        best.add(scores, np.ones(len(docs), dtype=bool), docs)
        seen += 1
    assert [-s for s, _, _ in best.found] == sorted(exact.tolist(), reverse=True)[:20]
    assert seen < len(tree.leaves) / 2
    # every node's bound covers every document below it
    local = np.searchsorted(tree.terms, query)
    bound = tree.bounds(local, weights[query] / scale[query])

    def below(node):
        return tree.leaves[node][0] if tree.children[node] is None else np.concatenate([below(c) for c in tree.children[node]])

    assert all((exact[below(k)] <= bound[k]).all() for k in range(len(bound)))


def test_scores_beyond_doubles(monkeypatch):
    weights = np.array([1 << 34, (1 << 34) + 1], dtype=np.int64)
    tree = ball_tree.Tree(np.array([2, 1]), np.array([0, 1, 1]), np.array([999_999, 999_998, 7]), np.ones(2))
    (found,) = tree.search(np.array([0, 1]), weights, np.ones(2), lambda: 1)
    assert dict(zip(found[0].tolist(), found[1].tolist())) == {0: 999_999 * (1 << 34) + 999_998 * ((1 << 34) + 1), 1: 7 * ((1 << 34) + 1)}
