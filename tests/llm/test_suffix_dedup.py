"""op1 against brute force over every 200-byte string; deep-shallow order; edge rows."""

import hashlib
import random
from collections import Counter

from aerolith.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, kept int"


def brute(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, n=70):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choice("ab cdé\n") for _ in range(k))
    shared = [fresh(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [fresh(rng.randint(0, 120)) + rng.choice([*shared, ""]) for _ in range(rng.randint(1, 5))]
        texts.append("".join(parts) + fresh(rng.randint(0, 60)))
    base = fresh(900)
    for _ in range(12):  # near copies
        k = rng.randint(0, 899)
        texts.append(base[:k] + fresh(3) + base[k:])
    return texts + [texts[0], texts[1], "x" * 199, "y" * 200, "z" * 201, "pq" * 300, "", fresh(5)]


def test_against_brute_force(spark):
    for seed, hot in ((1, 4096), (2, 2), (3, 6)):
        texts = corpus(seed)
        rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (None, texts[3], 1), (4, texts[4], 1)]
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = sorted(((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.dedup(frame, hot_anchor=hot).collect()), key=str)
        want = sorted(((str(i), *w) for (i, _, _), w in zip(rows, brute([(t or "").encode() for _, t, _ in rows]))), key=str)
        assert got == want


def test_kept_bytes_and_spans(spark):
    a = "é" * 150
    rows = [(1, "start " + a + " end", 0), (2, a + "tail", 0)]
    frame = sd.dedup(spark.createDataFrame([(*r[:2], "en") for r in rows], "doc_id long, text string, lang string"), carry=("lang",))
    assert frame.columns[:3] == ["doc_id", "lang", "n_bytes"] and {r["lang"] for r in frame.collect()} == {"en"}
    text = {r[0]: r[1] for r in frame.select("doc_id", sd.readable("kept")).collect()}
    assert text == {1: "start  end", 2: "tail"}


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(sd, "PIECE", 1000)
    texts = ["".join(rng.choice("abc ") for _ in range(9000)).encode() for _ in range(3)]
    texts[1] = texts[1][:4000] + texts[0][500:4500] + texts[1][4000:]
    h = [sd._all_segments([t], 200) for t in texts]
    for t, (_, _, at, first, last) in zip(texts, h):
        assert sorted(s for a, b in zip(first, last) for s in range(a, b + 1)) == list(range(len(t) - 199))
        assert all(a <= p <= b + 200 - sd.ANCHOR for p, a, b in zip(at, first, last))
    assert len(set(h[0][0].tolist()) & set(h[1][0].tolist())) > 30


def test_deep_shallow_sorts():
    rng = random.Random(4)
    for _ in range(200):
        stem = bytes(rng.choice(b"ab") for _ in range(30))
        strings = [stem[: rng.randint(0, 30)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 40))]
        got = sd.deep_shallow(strings, list(range(len(strings))))
        assert sorted(got) == list(range(len(strings)))
        assert [strings[i] for i in got] == sorted(strings)


def test_nothing(spark):
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
