"""op9: the base score by brute force, CTW against a direct sequential computation."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm import lm_score


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_base_score_and_edge_rows(spark):
    texts = ["The cat sat", "the CAT\tsat on\n the mat", "", None, "new words only", "x" * 3000 + " the", "the cat sat", "été Été"]
    rows = [(i, t, i % 3 != 0, 9) for i, t in enumerate(texts)] + [(None, "the mat", True, 1), (1, texts[1], True, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score int")
    got = lm_score.score(docs, F.col("learn")).collect()
    assert len(got) == len(rows)
    c = Counter(w for _, t, y, _ in rows if y for w in words(t))
    ends = sum(y for _, _, y, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in got:
        options = [t for i, t, y, _ in rows if i == r["doc_id"] and y != r["held_out"]]
        w = words(options[0])
        want = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[x] for x in w), ends])
        assert r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(c[x] > 0 for x in w) + 1
        assert abs(r["base_score"] - want) < 1e-9
        assert r["score"] < 0


def test_nothing_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_score.score(docs.limit(0), F.lit(True)).collect() == []
    r = lm_score.score(docs, F.lit(False)).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9
    assert abs(r["score"] - 4 * 8 * math.log10(0.5)) < 1e-4  # three bytes and the end, nothing known


def grams_of(text):
    codes = np.concatenate([c for c, _ in lm_score._grams([text])])
    c, n = np.unique(codes, return_counts=True)
    every = [(lm_score._tagged(c, lm_score.DEPTH), n), *(lm_score._summed(lm_score._tagged(c, d), n) for d in range(2, lm_score.DEPTH))]
    c, n = (np.concatenate(x) for x in zip(*every))
    order = np.argsort(c)
    return c[order], n[order]


def code_of(context, byte):
    return np.array([int.from_bytes(context + byte, "big")], dtype=np.uint64)


def test_table_is_context_tree_weighting():
    depth = lm_score.DEPTH
    text = b"abracadabra abracad abra"
    data = b"\0" * depth + text + b"\0"
    table = lm_score.Table(*grams_of(text))

    def counts(context, prefix, k):  # of the bit after prefix (k bits) in a context of bytes, newest last
        out = [0, 0]
        for i in range(depth, len(data)):
            if data[:i].endswith(context) and data[i] >> (8 - k) == prefix:
                out[data[i] >> (7 - k) & 1] += 1
        return out

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def weighted(context, prefix, k):
        own = kt(*counts(context, prefix, k))
        if len(context) == depth or not sum(counts(context, prefix, k)):
            return own
        below = sum(weighted(bytes([c]) + context, prefix, k) for c in sorted(set(data)))
        return math.log(0.5) + np.logaddexp(own, below)

    def chance(context, prefix, k):
        here = max(d for d in range(depth + 1) if any(data[:i].endswith(context[depth - d :]) for i in range(depth, len(data))))
        out = None
        for d in range(here, -1, -1):
            ctx = context[depth - d :]
            a, b = counts(ctx, prefix, k)
            p = (b + 0.5) / (a + b + 1)
            if out is None:
                out = p
            else:
                stop = math.exp(math.log(0.5) + kt(a, b) - weighted(ctx, prefix, k)) if a + b else 0.5
                out = stop * p + (1 - stop) * out
        return out

    for context, byte in [(b"abrac", b"a"), (b"cadab", b"r"), (b"zzzra", b" "), (b"zzzzz", b"q"), (b"abra ", b"x")]:
        want = 0.0
        for k in range(8):
            p = chance(context, byte[0] >> (8 - k), k)
            want += math.log10(p if byte[0] >> (7 - k) & 1 else 1 - p)
        assert abs(table.of(code_of(context, byte))[0] - want) < 1e-4, (context, byte)
    for context in (b"cadab", b"zzabr", b"zzzzz"):
        every = np.concatenate([table.of(code_of(context, bytes([b]))) for b in range(256)])
        assert abs((10.0**every).sum() - 1) < 1e-3


def test_contexts_that_are_no_nodes_predict_as_their_parents():
    c, n = grams_of(b"the cat sat on the mat and the hat " * 20)
    whole = lm_score.Table(c, n)
    some = lm_score.Table(*(x[(c >> np.uint64(56)) < 4] for x in (c, n)))
    assert len(some.seen) == 0
    every = np.concatenate([some.of(code_of(b"the c", bytes([b]))) for b in range(256)])
    assert abs((10.0**every).sum() - 1) < 1e-3
    assert whole.of(code_of(b"the c", b"a"))[0] > -0.2


def test_bounded_tables_and_pieces(spark, monkeypatch):
    texts = ["the cat sat on the mat " * 30, "a dog ran " * 50, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r["doc_id"]: r["score"] for r in lm_score.score(docs, F.lit(True)).collect()}
    bounded = {r["doc_id"]: r["score"] for r in lm_score.score(docs, F.lit(True), max_contexts=5).collect()}
    assert set(bounded) == set(full) and all(v < 0 for v in bounded.values()) and bounded[0] < full[0]
    codes = [np.concatenate([c for c, _ in lm_score._grams([t.encode()])]) for t in texts]
    monkeypatch.setattr(lm_score, "CHUNK", 100)
    assert all((np.concatenate([c for c, _ in lm_score._grams([t.encode()])]) == k).all() for t, k in zip(texts, codes))


def test_every_context_is_a_node(spark):
    import random

    rng = random.Random(4)
    # more contexts of five bytes than any table of 65,536
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12_000)]
    texts = [" ".join(rng.sample(vocabulary, len(vocabulary))) for _ in range(4)]
    texts.append(texts[0][:500] + "held out " + texts[1][700:900])
    rows = spark.createDataFrame([(i, t, i < 4) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(rows, F.col("learn")).collect()}
    pieces = [np.concatenate([c for c, _ in lm_score._grams([t.encode()])]) for t in texts]
    c, n = np.unique(np.concatenate(pieces[:4]), return_counts=True)
    assert len(np.unique(c >> np.uint64(8))) > 1 << 16
    every = [(lm_score._tagged(c, lm_score.DEPTH), n), *(lm_score._summed(lm_score._tagged(c, d), n) for d in range(2, lm_score.DEPTH))]
    c, n = (np.concatenate(x) for x in zip(*every))
    order = np.argsort(c)
    table = lm_score.Table(c[order], n[order])
    for i, code in enumerate(pieces):
        assert abs(table.of(code).sum() / got[i] - 1) < 1e-5
