"""Language-model scores by context-tree weighting, beside a unigram base score.

The model predicts a lower-cased text byte by byte, each byte as eight binary decisions,
each decision in the context of the bits of this byte so far and of the 0 to DEPTH bytes
before. Every context holds a Krichevsky-Trofimov estimate; context-tree weighting mixes
the estimates of all depths: a node's weighted probability is half its own estimate's and
half the product of its children's, and the mixing weights on a path follow from these.

All contexts of all training bytes are counted on Spark and all are nodes of the tree; no table
of them reaches the driver. Groups of texts send their distinct codes (a context and its byte) to
reducers, which sum them and pass the distinct ones on by their newest ROOT bytes. So the whole
subtree of a context of ROOT bytes meets in one task, which weighs it from below, and passes its
roots' probabilities up. What lies above (contexts of fewer than ROOT bytes) is bounded by the
bytes that can follow each other, whatever the corpus, and is all that is broadcast. Each
subtree then answers its codes, and the reducers return each group the answers to what it sent.

Words are counted exactly: groups of texts send their distinct words as packed arrays of
64-bit hashes and counts to reducers, which return each group the totals of its words, so
a frequent word costs one entry for each group. Nulls count as empty texts; a text's end
is a token and a symbol (byte 0) of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import U64, bucketed, crc_rest, grouped_texts, mix, route, slices, span_hashes, squeeze, stored, unsqueeze

CHUNK = 1 << 20
#: Bytes of the longest context; a context and its byte fill DEPTH + 1 of a code's 7 low bytes.
DEPTH = 5
#: Newest bytes of a context that name its subtree.
ROOT = 3
#: Codes weighed at a time, about.
TREE_CODES = 1 << 17
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_PACKED = "r int, g int, kind int, n long, v long, payload binary"
_COLUMNS = ["r", "g", "kind", "n", "v", "payload"]


# --- reading texts -----------------------------------------------------------------------


def _distinct(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct texts, lower-cased; how many training rows each has; each row's text."""
    lowered = [t.lower() for t in pdf["text"]]
    texts = sorted(set(lowered))
    number = {t: i for i, t in enumerate(texts)}
    which = np.fromiter((number[t] for t in lowered), dtype=np.int64, count=len(lowered))
    return texts, np.bincount(which, weights=pdf["train"].to_numpy(dtype=np.float64), minlength=len(texts)).astype(np.int64), which


def _pieces(texts: list[bytes]):
    """Lists of (text, start, end) of about CHUNK bytes; long texts are cut after white space."""
    held, size = [], 0
    for k, t in enumerate(texts):
        a = 0
        while True:
            b = min(len(t), a + CHUNK)
            while b < len(t) and not _SPACE[t[b - 1]]:
                b += 1
            held.append((k, a, b))
            size += b - a
            if size >= CHUNK:
                yield held
                held, size = [], 0
            a = b
            if a >= len(t):
                break
    if held:
        yield held


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word."""
    hashes, owners = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
    for held in _pieces(texts):
        data = np.frombuffer(b" ".join(texts[k][a:b] for k, a, b in held), dtype=np.uint8)
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        begins = np.cumsum([0, *(b - a + 1 for _, a, b in held)])
        piece = np.searchsorted(begins, starts, side="right") - 1
        hashes.append(span_hashes(data, starts, ends))
        owners.append(np.array([k for k, _, _ in held])[piece])
    return np.concatenate(hashes), np.concatenate(owners)


def _grams(texts: list[bytes]):
    """Pieces of (context << 8 | byte, text) for every byte and end; contexts of DEPTH bytes, the newest lowest."""
    for held in _pieces(texts):
        parts, sizes = [], []
        for k, a, b in held:
            t = texts[k]
            part = b"\0" * max(0, DEPTH - a) + t[max(0, a - DEPTH) : b] + (b"\0" if b == len(t) else b"")
            parts.append(part)
            sizes.append(len(part) - DEPTH)
        data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(U64)
        n = len(data) - DEPTH
        code = data[:n].copy()
        for k in range(1, DEPTH + 1):
            code = (code << U64(8)) | data[k : n + k]
        keep = np.ones(n, dtype=bool)
        at = np.cumsum([len(p) for p in parts])[:-1]
        for k in range(1, DEPTH + 1):
            keep[at - k] = False
        yield code[keep], np.repeat([k for k, _, _ in held], sizes)


def _tagged(code: np.ndarray, depth: int) -> np.ndarray:
    """Codes of a depth: its low bytes, and the depth above them."""
    return (code & U64((1 << 8 * (depth + 1)) - 1)) | U64(depth << 56)


def _summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(code, return_inverse=True)
    return distinct, np.bincount(where, weights=count, minlength=len(distinct)).astype(np.int64)


# --- counting ----------------------------------------------------------------------------


def _condense(n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        texts, train, _ = _distinct(pdf)
        h, owner = _words(texts)
        distinct, where = np.unique(h, return_inverse=True)
        count = np.bincount(where, weights=train[owner], minlength=len(distinct)).astype(np.int64)
        rows = [(r, g, 0, 0, 0, distinct[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes()) for r, a, b in slices(distinct, n)]
        codes, counts = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
        for code, text in _grams(texts):
            weight = train[text]
            c, m = np.unique(np.repeat(code, weight) if (weight > 1).any() else code[weight > 0], return_counts=True)
            asked = np.unique(code[weight == 0])  # not counted, but to be answered
            codes += [c, asked]
            counts += [m, np.zeros(len(asked), dtype=np.int64)]
        c, m = _summed(np.concatenate(codes), np.concatenate(counts))
        rows += [(n + r, g, 1, 0, 0, _packed(c[at], m[at].astype(np.uint32))) for r, at in _dealt(c >> U64(8), n)]
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _dealt(key: np.ndarray, n: int):
    """(reducer, places of its keys, in order) of the reducers that have any."""
    to = route(mix(key), n)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n + 1))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, order[cuts[r] : cuts[r + 1]]


def _packed(code: np.ndarray, value: np.ndarray) -> bytes:
    return len(code).to_bytes(8, "little") + squeeze(code.tobytes() + value.tobytes())


def _opened(payload: bytes, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    k, raw = int.from_bytes(payload[:8], "little"), unsqueeze(payload[8:])
    return np.frombuffer(raw, dtype=U64, count=k), np.frombuffer(raw, dtype=kind, offset=8 * k)


def _bin(count: np.ndarray) -> np.ndarray:
    """Bin of a count: eighths of its binary logarithm."""
    return np.floor(8 * np.log2(np.maximum(count, 1))).astype(np.int64)


def _per_context(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of its context's count, whether it is its context's first) of each of sorted codes."""
    context = code >> U64(8)
    first = np.append(True, context[1:] != context[:-1])
    run = np.cumsum(first) - 1
    return _bin(np.bincount(run, weights=count))[run], first


def _total(n_trees: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Totals of a reducer's words, returned to each group in its order; or of its codes, once, dealt by their subtrees (g: this reducer)."""
        r, kind = int(pdf["r"].iloc[0]), int(pdf["kind"].iloc[0])
        if kind:
            c, m = _summed(*(np.concatenate(x) for x in zip(*(_opened(p, np.uint32) for p in pdf["payload"]))))
            rows = [(t, r, 1, 0, 0, _packed(c[at], m[at])) for t, at in _dealt(_root(c), n_trees)]
            return pd.DataFrame(rows, columns=_COLUMNS)
        sizes = [len(p) // 12 for p in pdf["payload"]]
        h = np.concatenate([np.frombuffer(p, dtype=U64, count=k) for p, k in zip(pdf["payload"], sizes)])
        m = np.concatenate([np.frombuffer(p, dtype=np.uint32, offset=8 * k) for p, k in zip(pdf["payload"], sizes)])
        _, where = np.unique(h, return_inverse=True)
        total = np.bincount(where, weights=m).astype(np.int64)
        back, at, rows = total[where], 0, [(r, -1, 2, int(total.sum()), int((total > 0).sum()), b"")]
        for g, k in zip(pdf["g"], sizes):
            rows.append((r, int(g), 0, 0, 0, back[at : at + k].tobytes()))
            at += k
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


# --- context-tree weighting --------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series, eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return np.where(zeros + ones > 0, _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi), 0.0)


def _root(code: np.ndarray) -> np.ndarray:
    """The context of ROOT bytes that names a code's subtree."""
    return (code >> U64(8)) & U64((1 << 8 * ROOT) - 1)


def _shortened(code: np.ndarray, depth: int) -> np.ndarray:
    """Codes or node keys with contexts of depth bytes."""
    return code & U64((1 << 8 * (depth + 1)) - 1)


def _weighed(grams: dict, below: tuple | None = None) -> tuple[dict, tuple]:
    """Levels (keys, chances of a one, stop weights) of the depths in grams, from the deepest up; and the uppermost's keys, zeros, ones, log weighted probability.

    below: the same of the nodes one deeper, where grams don't reach them.
    """
    levels = {}
    for d in sorted(grams, reverse=True):
        keys, zeros, ones = Table._nodes(*grams[d])
        weighted = own = _kt(zeros, ones)
        stop = np.ones(len(keys), dtype=np.float32)
        if below is not None:
            at = np.searchsorted(keys, _shortened(below[0], d))
            product, z, o = (np.bincount(at, weights=x, minlength=len(keys)).astype(np.float64) for x in (below[3], below[1], below[2]))
            product += _kt(np.maximum(zeros - z, 0), np.maximum(ones - o, 0))  # contexts that are no nodes
            weighted = np.logaddexp(np.log(0.5) + own, np.log(0.5) + product)
            stop = np.exp(np.log(0.5) + own - weighted).astype(np.float32)
        levels[d] = (keys, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32), stop)
        below = (keys, zeros, ones, weighted)
    return levels, below


class Table:
    """A weighted tree: for each depth its nodes (context << 8 | bits so far, a one ahead), with counts and stop weights.

    Built from tagged codes of depths 2 to DEPTH with their counts, depths 0 and 1 being sums of
    depth 2; or from levels that are weighed already.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray):
        grams = {d: (code[code >> U64(56) == d] & U64((1 << 56) - 1), count[code >> U64(56) == d]) for d in range(2, DEPTH + 1)}
        for d in (1, 0):
            grams[d] = _summed(_shortened(grams[2][0], d), grams[2][1])
        self.levels = _weighed(grams)[0]
        self.seen = grams[DEPTH][0]

    @classmethod
    def joined(cls, *parts: dict) -> "Table":
        table = cls.__new__(cls)
        table.levels = {d: level for part in parts for d, level in part.items()}
        return table

    @staticmethod
    def _nodes(c: np.ndarray, m: np.ndarray):
        """(keys, zeros, ones), sorted, of the binary decisions that lead to the bytes of sorted codes."""
        keys, zeros, ones = [np.zeros(0, dtype=U64)], [np.zeros(0)], [np.zeros(0)]
        byte = c & U64(255)
        for k in range(8):
            key = (c & ~U64(255)) | U64(1 << k) | (byte >> U64(8 - k))
            first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
            if len(first):
                bit = ((byte >> U64(7 - k)) & U64(1)).astype(np.int64)
                keys.append(key[first])
                zeros.append(np.add.reduceat(m * (1 - bit), first).astype(np.float64))
                ones.append(np.add.reduceat(m * bit, first).astype(np.float64))
        keys, zeros, ones = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
        order = np.argsort(keys)
        return keys[order], zeros[order], ones[order]

    def _walk(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each code's byte in its context, from the tree."""
        total = np.zeros(len(code))
        byte = code & U64(255)
        # the depth of the deepest node above each code; its root decision exists for every node
        deepest = np.zeros(len(code), dtype=np.int64)
        for d in range(1, DEPTH + 1):
            context = (code & U64((1 << 8 * (d + 1)) - 1) & ~U64(255)) | U64(1)
            deepest += self._at(d, context)[1] & (deepest == d - 1)
        for k in range(8):
            node = U64(1 << k) | (byte >> U64(8 - k))
            p = np.full(len(code), 0.5)
            for d in range(DEPTH, -1, -1):
                at, there = self._at(d, (code & U64((1 << 8 * (d + 1)) - 1) & ~U64(255)) | node)
                _, ones, stops = self.levels[d]
                kt = np.where(there, ones[at], 0.5) if len(ones) else np.full(len(code), 0.5)
                stop = np.where(there, stops[at], 0.5) if len(ones) else np.full(len(code), 0.5)
                p = np.where(deepest == d, kt, np.where(deepest > d, stop * kt + (1 - stop) * p, p))
            one = (byte >> U64(7 - k)) & U64(1) == 1
            total += np.log10(np.where(one, p, 1 - p))
        return total

    def _at(self, d: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = self.levels[d][0]
        if not len(have):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return at, have[at] == keys

    def of(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities of codes, each distinct one looked up once."""
        distinct, where = np.unique(code, return_inverse=True)
        return np.concatenate([np.zeros(0), *(self._walk(distinct[a : a + (1 << 16)]) for a in range(0, len(distinct), 1 << 16))])[where]


def _subtrees(pdf: pd.DataFrame):
    """(codes, counts) of a task's subtrees, about TREE_CODES at a time, each subtree whole."""
    c, m = (np.concatenate(x) for x in zip(*map(_opened, pdf["payload"])))
    order = np.lexsort((c, _root(c)))
    c, m = c[order], m[order]
    new = np.append(np.flatnonzero(np.append(True, _root(c[1:]) != _root(c[:-1]))), len(c))
    a = 0
    while a < len(c):
        b = int(new[max(np.searchsorted(new, a + TREE_CODES, side="right") - 1, np.searchsorted(new, a, side="right"))])
        yield c[a:b], m[a:b]
        a = b


def _grown(c: np.ndarray, m: np.ndarray, least: dict[int, int]) -> dict:
    """Codes and counts of the depths from ROOT: those of all contexts, or of those whose bin reaches their depth's least."""
    grams = {}
    for d in range(ROOT, DEPTH + 1):
        x, k = _summed(_shortened(c[m > 0], d), m[m > 0])
        keep = _per_context(x, k)[0] >= least[d] if least and len(x) else np.ones(len(x), dtype=bool)
        grams[d] = (x[keep], k[keep])
    return grams


def _roots(n: int, least: dict[int, int]):
    """For the tasks of contexts of ROOT - 1 bytes: their codes (kind 4), and what their children's nodes amount to (kind 5)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c, m in _subtrees(pdf):
            x, k = _summed(_shortened(c[m > 0], ROOT - 1), m[m > 0])
            keys, *values = _added(*_weighed(_grown(c, m, least))[1])
            for kind, key, value in ((4, x, [k]), (5, keys, values)):
                rows += [(r, -1, kind, 0, 0, _packed(key[at], np.concatenate([v[at] for v in value]))) for r, at in _dealt(key >> U64(8), n)]
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _added(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Node keys cut to contexts of ROOT - 1 bytes, each once, and the sums of their values."""
    distinct, where = np.unique(_shortened(keys, ROOT - 1), return_inverse=True)
    return [distinct, *(np.bincount(where, weights=v, minlength=len(distinct)).astype(np.float64) for v in values)]


def _together(payloads, kind: int) -> list[np.ndarray]:
    """Sums of what _roots sent of a kind."""
    found = [_opened(p, np.int64 if kind == 4 else np.float64) for p in payloads]
    keys = np.concatenate([np.zeros(0, dtype=U64), *(k for k, _ in found)])
    if kind == 4:
        return list(_summed(keys, np.concatenate([np.zeros(0, dtype=np.int64), *(v for _, v in found)])))
    return _added(keys, *(np.concatenate([np.zeros(0), *(v.reshape(3, -1)[i] for _, v in found)]) for i in range(3)))


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for kind, part in pdf.groupby("kind"):
        key, *values = _together(part["payload"], kind)
        rows.append((int(pdf["r"].iloc[0]), -1, int(kind), 0, 0, _packed(key, np.concatenate(values))))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _above(trees: DataFrame, n: int, least: dict[int, int]) -> dict:
    """Levels of the contexts of fewer than ROOT bytes."""
    got = trees.groupBy("r").applyInPandas(_roots(n, least), _PACKED).groupBy("r").applyInPandas(_merged, _PACKED).select("kind", "payload").collect()
    code, count = _together([bytes(r[1]) for r in got if r[0] == 4], 4)
    below = _together([bytes(r[1]) for r in got if r[0] == 5], 5)
    return _weighed({d: _summed(_shortened(code, d), count) for d in range(ROOT)}, tuple(below))[0]


def _least(trees: DataFrame, limit: int) -> dict[int, int]:
    """The least bin of each depth from ROOT whose contexts, with all of greater counts, are at most limit."""

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = [np.zeros(0, dtype=np.int64)]
        for c, m in _subtrees(pdf):
            for d, (x, k) in _grown(c, m, {}).items():
                if len(x):
                    found, first = _per_context(x, k)
                    slots.append(d * 1000 + found[first])
        slot, contexts = np.unique(np.concatenate(slots), return_counts=True)
        return pd.DataFrame({"slot": slot, "n": contexts})

    histogram = trees.groupBy("r").applyInPandas(bins, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # some hundred bins
    least: dict[int, int] = {}
    for d in range(ROOT, DEPTH + 1):
        left = limit
        for b, k in sorted(((r["slot"] % 1000, r["n"]) for r in histogram if r["slot"] // 1000 == d), reverse=True):
            left -= k
            if left < 0:
                break
            least[d] = b
        least[d] = max(least.get(d, 1000), least.get(d - 1, 0))  # so that every node's parent is a node
    return least


def _answers(above, least: dict[int, int]):
    """log10 probabilities of a task's codes, for the reducers that passed them on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, logs = [np.zeros(0, dtype=U64)], [np.zeros(0)]
        for c, m in _subtrees(pdf):
            codes.append(c)
            logs.append(Table.joined(above.value, _weighed(_grown(c, m, least))[0]).of(c))
        c, x = np.concatenate(codes), np.concatenate(logs)
        order = np.argsort(c)
        c, x = c[order], x[order].astype(np.float32)
        rows = []
        for g, payload in zip(pdf["g"], pdf["payload"]):
            asked, _ = _opened(payload)
            rows.append((int(g), -1, 1, 0, 0, _packed(asked, x[np.searchsorted(c, asked)])))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _returned(sent: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to each group's codes."""
    c, x = (np.concatenate(v) for v in zip(*(_opened(p, np.float32) for p in answers["payload"])))
    order = np.argsort(c)
    c, x = c[order], x[order]
    rows = []
    for r, g, payload in zip(sent["r"], sent["g"], sent["payload"]):
        asked, _ = _opened(payload, np.uint32)
        rows.append((int(r), int(g), 1, 0, 0, _packed(asked, x[np.searchsorted(c, asked)])))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _score(n: int):
    def run(texts_pdf: pd.DataFrame, totals_pdf: pd.DataFrame) -> pd.DataFrame:
        texts, _, which = _distinct(texts_pdf)
        h, owner = _words(texts)
        distinct, where = np.unique(h, return_inverse=True)
        is_word = totals_pdf["kind"] == 0
        got = dict(zip(totals_pdf["r"][is_word], totals_pdf["payload"][is_word]))
        total = np.zeros(len(distinct), dtype=np.int64)
        for r, a, b in slices(distinct, n):
            total[a:b] = np.frombuffer(got[r], dtype=np.int64)
        c = total[where]
        words = np.bincount(owner, minlength=len(texts))
        known = np.bincount(owner, weights=c > 0, minlength=len(texts)).astype(np.int64)
        logs = np.bincount(owner, weights=np.log10(c + 0.1), minlength=len(texts))
        codes, chances = (np.concatenate(v) for v in zip(*(_opened(p, np.float32) for p in totals_pdf["payload"][~is_word])))
        order = np.argsort(codes)
        codes, chances = codes[order], chances[order].astype(np.float64)
        score = np.zeros(len(texts))
        for code, text in _grams(texts):
            asked, at = np.unique(code, return_inverse=True)
            score += np.bincount(text, weights=chances[np.searchsorted(codes, asked)][at], minlength=len(texts))
        return pd.DataFrame({"id": texts_pdf["id"], "train": texts_pdf["train"], "words": words[which], "known": known[which], "logs": logs[which], "score": score[which]})

    return run


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", max_contexts: int | None = None) -> DataFrame:
    """For each row: id, held_out (not train), n_tokens, n_known, train_tokens, base_score and score.

    train is a boolean column of docs: the rows to learn from (null: not). Ids may be null
    or repeated. Without training rows the base score of every token is log10 of 1. All
    contexts are nodes, unless max_contexts bounds those of each depth from ROOT.
    """
    spark = docs.sparkSession
    texts, n = grouped_texts(docs, id_col, text_col, more={"train": F.coalesce(train, F.lit(False))})
    n_trees = max(min(n, 24), -(-n // 8))  # distinct codes are far fewer than those sent
    sent = bucketed(texts.groupBy("g").applyInPandas(_condense(n), _PACKED), "r", 2 * n)
    totals = stored(sent.groupBy("r").applyInPandas(_total(n_trees), _PACKED), "totals")
    counts = totals.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = texts.where("train").count()
    n_tokens, n_distinct = counts[0] + ends, counts[1] + (ends > 0)
    trees = totals.where("kind = 1")
    least = {} if max_contexts is None else _least(trees, max_contexts)
    above = spark.sparkContext.broadcast(_above(trees, n_trees, least))
    answers = trees.groupBy("r").applyInPandas(_answers(above, least), _PACKED)
    returned = sent.where("kind = 1").groupBy("r").cogroup(answers.groupBy("r")).applyInPandas(_returned, _PACKED)
    kind = dict(docs.dtypes)[id_col]
    back = totals.where("kind = 0").unionByName(returned)
    rows = texts.groupBy("g").cogroup(back.groupBy("g")).applyInPandas(_score(n), f"id {kind}, train boolean, words long, known long, logs double, score double")
    log_all = float(np.log10(n_tokens + 0.1 * (n_distinct + 1)))
    tokens = F.col("words") + 1
    return rows.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 0.1)) - tokens * F.lit(log_all)).alias("base_score"),
        "score",
    )


def op9_ctw_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every row of `documents` by a model of nine tenths of them; null and empty texts are their end alone, repeated rows score alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, crc_rest("doc_id", 10) != 0)
