"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is its words' character n-grams (1 to 4 characters, words framed by blanks), hashed
into BUCKETS rows of an embedding table; their average feeds a linear softmax. Both are
trained with stochastic gradient descent in numpy on a bounded sample of labelled texts
(`sample_rows`, spread over the languages; copies count once). The grams of whole sampled
texts, and of a short window of each, are counted in tasks; only these counts, of at most
BUCKETS numbers each, reach the driver. Prediction runs over every whole text inside tasks; as
everything after the average is linear, the two tables are folded into one, which is small
(BUCKETS x languages) and bounded, so each task receives it with the function.

A part of the sample kept aside calibrates the softmax's temperature and two rejections: a
text goes if it is too unsure, or too strange: if its grams are less likely in the predicted
language, by more than texts of that length ever are there (`_strangeness`). How much is read
off the texts kept aside, and off texts that must be turned away: those of each language under
a model of the others, and the texts kept aside with the letters of their words shuffled.

Null texts and texts without a letter are `und`, with score 0. Repeated rows get equal
results; very long texts are counted piece by piece; equal chances go to the smaller name.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import crc_rest, text_batches

BUCKETS = 1 << 12
DIMENSIONS = 24
GRAMS = 4
#: Labelled texts that a model is fitted on, about, and at least of each language.
SAMPLE_ROWS = 2000
LANGUAGE_ROWS = 100
#: Characters of the window that is learned beside each whole text, so that short texts are known.
SHORT = 200
#: Rows of a training step.
STEP = 4
#: Share of the kept-aside rows that the threshold of unsureness may turn away.
REJECTED = 0.0005
#: That threshold, at most.
CEILING = 0.4
#: Share of the texts kept aside that may be odd in themselves.
ODD = 0.005
#: What a language's own texts may be stranger than those kept aside, as a factor.
MARGIN = 1.6
CHUNK = 1 << 17
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embedding times weights, divided by the temperature
    bias: np.ndarray
    threshold: float
    habits: np.ndarray  # (BUCKETS, languages): log of each gram's share in the language
    usual: np.ndarray  # what habits amount to in texts of the language
    strange: tuple[float, float]  # what may lack to that: a constant, and what goes with 1 / sqrt(grams)


_FOLD = np.zeros(1, dtype=np.uint32)


def _fold() -> np.ndarray:
    """Lower case of each codepoint, and 32 for all that is no letter."""
    global _FOLD
    if len(_FOLD) == 1:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def _buckets(points: np.ndarray):
    """For each n: (positions, buckets) of the n-grams of folded codepoints that lie in one word, framing blanks included."""
    blank = points == 32
    h = np.full(len(points), 0x811C9DC5, dtype=np.uint32)
    for n in range(1, min(GRAMS, len(points)) + 1):
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x01000193)
        if n < 3:
            use = ~blank[: len(h)] | ~blank[n - 1 :]
        else:
            inside = blank[1 : len(h) + 1] if n == 3 else inside | blank[n - 2 : len(h) + n - 2]
            use = ~inside[: len(h)]
        if n == 3:
            inside = blank[1 : len(h) + 1].copy()
        at = np.flatnonzero(use)
        x = h[at]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x &= np.uint32(BUCKETS - 1)
        yield at, x
        if n == 3:
            inside = inside[:-1]


def counts(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in each whole text; texts without a letter have no grams."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    pieces = [(k, t[a : a + CHUNK]) for k, t in enumerate(texts) for a in range(0, len(t), CHUNK)]
    held, size = [], 0
    for i, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece[1])
        if size >= CHUNK or i == len(pieces) - 1:
            joined = " " + " ".join(t for _, t in held) + " "
            points = _fold()[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
            lengths = np.array([len(t) + 1 for _, t in held], dtype=np.int64)
            lengths[0] += 1
            owner = np.repeat(np.arange(len(held)), lengths)
            blank = points == 32
            keep = np.append(True, ~(blank[1:] & blank[:-1]))
            points, owner = points[keep], owner[keep]
            c = np.zeros(len(held) * BUCKETS, dtype=np.int64)
            for at, x in _buckets(points):
                c += np.bincount(owner[at] * BUCKETS + x, minlength=len(c))
            np.add.at(out, [k for k, _ in held], c.reshape(len(held), BUCKETS))
            held, size = [], 0
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _sgd(x: list, y: np.ndarray, rows: np.ndarray, n_languages: int, rng, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(folded table, bias) by stochastic gradient descent in steps of STEP rows."""
    emb = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, n_languages), dtype=np.float32), np.zeros(n_languages, dtype=np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(rows)
        for a in range(0, len(order), STEP):
            some = order[a : a + STEP]
            used = np.unique(np.concatenate([x[i][0] for i in some]))
            part = np.zeros((len(some), len(used)), dtype=np.float32)
            for k, i in enumerate(some):
                part[k, np.searchsorted(used, x[i][0])] = x[i][1]
            mean = part @ emb[used]
            p = _softmax(mean @ w + b)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ w.T
            w -= step * mean.T @ p
            b -= step * p.sum(axis=0)
            emb[used] -= step * np.float32(20) * (part.T @ back)
    return (emb @ w).astype(np.float64), b.astype(np.float64)


def _dot(x: list, which: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.array([x[i][1] @ table[x[i][0]] for i in which]).reshape(len(which), table.shape[1])


def _habits(x: list, y: np.ndarray, rows: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(log share of each gram in each language, what that amounts to on average in a text of it)."""
    share = np.full((BUCKETS, n_languages), 1e-6)
    for i in rows:
        share[x[i][0], y[i]] += x[i][1]
    share /= share.sum(axis=0)
    logs = np.log(share)
    got = _dot(x, rows, logs)[np.arange(len(rows)), y[rows]]
    n = np.maximum(np.bincount(y[rows], minlength=n_languages), 1)
    return logs, np.bincount(y[rows], weights=got, minlength=n_languages) / n


def _strangeness(lack: np.ndarray, size: np.ndarray, foreign: np.ndarray, foreign_size: np.ndarray, spread: float) -> tuple[float, float]:
    """(a, b): texts of `size` grams that lack more than a + b / sqrt(size) are strange.

    lack: of whole texts kept aside; a few of them may be odd in themselves (a licence line and
    little else). a covers all but ODD of the longer ones, MARGIN beyond, and grows up to half the
    way to nineteen of twenty foreign texts, to its double at most. b is what chance makes of a
    few grams: three deviations of a gram, `spread`, or six, if texts kept aside ask for it.
    """
    long = size >= np.median(size)
    a = max(1e-3, float(np.quantile(lack[long], 1 - ODD)) * MARGIN)
    far = foreign[foreign_size >= np.median(size)] if len(foreign) else foreign
    if len(far):
        a = max(a, min(2 * a, (a + float(np.quantile(far, 0.05))) / 2))
    return a, min(6 * spread, max(3 * spread, float(((lack - a) * np.sqrt(size)).max()) * MARGIN))


def train(grams: list[tuple[np.ndarray, np.ndarray]], labels: list[str], shuffled: list[tuple[np.ndarray, np.ndarray]] = (), whole: int | None = None, seed: int = 7, epochs: int = 6, rate: float = 0.5) -> Model:
    """A calibrated model of the labels of texts, given as (buckets, counts); a fifth of each language is kept aside. shuffled: what must be turned away; whole: so many of the first are whole texts."""
    languages = sorted(set(labels))
    known = [k for k, (used, _) in enumerate(grams) if len(used)]
    if not known:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0, np.zeros((BUCKETS, 0)), np.zeros(0), (0.0, 0.0))
    rng = np.random.default_rng(seed)
    size = np.array([grams[k][1].sum() for k in known], dtype=np.float64)
    x = [(grams[k][0], (grams[k][1] / n).astype(np.float32)) for k, n in zip(known, size)]
    y = np.array([languages.index(labels[k]) for k in known], dtype=np.int64)
    aside = np.zeros(len(x), dtype=bool)
    for k in range(len(languages)):
        mine = rng.permutation(np.flatnonzero(y == k))
        aside[mine[: len(mine) // 5]] = True
    rows = np.flatnonzero(~aside)
    table, b = _sgd(x, y, rows, len(languages), rng, epochs, rate)
    tested = np.flatnonzero(aside) if aside.any() else rows
    z = _dot(x, tested, table) + b
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(tested)), y[tested]] + 1e-12).mean()
    temperature = min(np.geomspace(0.25, 8, 26), key=loss)
    sure = _softmax(z / temperature).max(axis=1)
    threshold = min(float(np.quantile(sure, REJECTED)), CEILING) if len(languages) > 1 else 0.0
    # how far texts of a language are from its habits, and how far those that must go
    habits, usual = _habits(x, y, rows, len(languages))
    fit = _dot(x, tested, habits)
    lack = usual[y[tested]] - fit[np.arange(len(tested)), y[tested]]
    spread = float(np.sqrt((np.exp(habits) * (habits - usual) ** 2).sum(axis=0)).mean())
    entire = np.array(known)[tested] < (len(grams) if whole is None else whole)
    entire = entire if entire.any() else ~entire
    others = [np.delete(np.arange(len(languages)), k) for k in range(len(languages))]
    foreign = [float((usual[o] - f[o]).min()) for f, k in zip(fit, y[tested]) for o in [others[k]] if len(o)]
    foreign_size = list(size[tested][: len(foreign)])
    odd = [(used, (c / c.sum()).astype(np.float32)) for used, c in shuffled if len(used)]
    foreign += (usual - _dot(odd, np.arange(len(odd)), habits)).min(axis=1).tolist()
    foreign_size += [float(c.sum()) for used, c in shuffled if len(used)]
    return Model(languages, table / temperature, b / temperature, threshold, habits, usual, _strangeness(lack[entire], size[tested][entire], np.array(foreign), np.array(foreign_size), spread))


def _shuffled(text: str, rng) -> str:
    """The text with the letters of each word in another order."""
    words = text.split()
    return " ".join("".join(w[i] for i in rng.permutation(len(w))) for w in words)


def _sparse(c: np.ndarray) -> bytes:
    used = np.flatnonzero(c)
    return used.astype(np.uint16).tobytes() + c[used].astype(np.uint32).tobytes()


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(data) // 6
    return np.frombuffer(data, dtype=np.uint16, count=k), np.frombuffer(data, dtype=np.uint32, offset=2 * k)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def gram_counts(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """Column function: (text, number) -> sparse counts of the whole text, of a short window, and of that window with shuffled letters."""
    out = []
    for t, seed in zip(texts, seeds):
        rng = np.random.default_rng(seed & 0xFFFFFFFF)
        a = int(rng.integers(0, max(1, len(t) - SHORT)))
        window = t[a : a + SHORT]
        out.append([_sparse(c) for c in counts([t, window, _shuffled(window, rng)])])
    return pd.Series(out)


def sampled(rows: DataFrame, columns: list[str], limit: int) -> list:
    """At most about `limit` distinct rows, chosen by the hash of their columns, so alike on every run; few columns without long texts."""
    distinct = rows.select(*columns).distinct()
    total = distinct.count()
    if not total:
        return []
    h = F.xxhash64(*columns)
    picked = distinct.where(F.pmod(h, F.lit(1 << 30)) < int(min(1.0, limit / total) * (1 << 30))).orderBy(h, *columns).limit(int(1.2 * limit) + 20).collect()
    return sorted(picked, key=lambda r: tuple(str(v) for v in r))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the non-null languages of docs.

    It learns from about sample_rows distinct texts in all, dealt evenly over the languages, but
    LANGUAGE_ROWS of each language at least, or all it has.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(text_col).alias("h"))
    sizes = dict(map(tuple, rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02)).collect()))
    if not sizes:
        return train([], [])
    each = max(LANGUAGE_ROWS, sample_rows // len(sizes))
    share = F.create_map(*(F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, int(min(1.0, each / max(n, 1)) * (1 << 30)))))
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("l")]).dropDuplicates(["l", "h"])
    got = picked.select("l", "h", gram_counts("t", "h").alias("c")).toArrow().sort_by([("l", "ascending"), ("h", "ascending")]).to_pylist()
    grams = [_opened(r["c"][k]) for k in (0, 1) for r in got]
    return train(grams, [r["l"] for r in got] * 2, [_opened(r["c"][2]) for r in got], whole=len(got))


def predictor(model: Model):
    """Column function: text -> struct(lang_pred, score, rejected)."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    n_languages = len(model.languages)
    both = np.concatenate([model.table, model.habits], axis=1).astype(np.float32)
    base, slope = model.strange

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for a in range(0, len(texts), 64):
            part = list(texts.iloc[a : a + 64])
            c = counts([t or "" for t in part]).astype(np.float32)
            n = c.sum(axis=1)
            z = (c @ both).astype(np.float64) / np.maximum(n, 1)[:, None]
            if not n_languages:
                out += [(UNKNOWN, 0.0, True)] * len(part)
                continue
            p, fit = _softmax(z[:, :n_languages] + model.bias), z[:, n_languages:]
            best = p.argmax(axis=1)
            at = np.arange(len(part))
            strange = model.usual[best] - fit[at, best] > base + slope / np.sqrt(np.maximum(n, 1))
            rejected = strange | (p[at, best] < model.threshold)
            out += [(model.languages[k], float(q), bool(r)) if size else (UNKNOWN, 0.0, True) for k, q, r, size in zip(best, p[at, best], rejected, n)]
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return run


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of `documents`; null and letterless texts are und."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_rest("doc_id", 4) == 2
    model = fit(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), predictor(model)("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
