"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of codepoints and those arrays of classes (letter, number, white space,
other, and the few characters that contractions are made of). Where a contraction begins
depends on what the tokens before it took, so a small automaton reads the classes; each
class is a function from state to state, functions compose associatively, and a two-level
scan (blocks in parallel, block results in turn, blocks again) finds every state without
a loop over characters. Token boundaries follow from states and neighbouring classes.

The slices between boundaries are merged by the vocabulary's ranks and cached; offsets of
the tokens stay, and decoding gathers token bytes by offset.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import ranges, text_batches

# classes of codepoints
LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, S_T_M_D, R_, V_, L_, E_ = range(11)
#: White space of the pattern: Unicode's White_Space.
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Slices kept merged; beyond it the cache starts anew.
CACHE = 400_000
#: Characters scanned at a time.
CHUNK = 1 << 18
BLOCK = 64

# states: after what ends a token's claim on a quote; in a run of others; after one blank;
# after a quote that begins a token; after that and r, v or l; after a whole contraction
_FREE, _RUN, _AFTER_SPACE, _QUOTED, _QR, _QV, _QL, _DONE = range(8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every codepoint."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[list(_WHITE)] = BLANK
    table[0x20] = SPACE
    for chars, c in (("'", QUOTE), ("stmd", S_T_M_D), ("r", R_), ("v", V_), ("l", L_), ("e", E_)):
        table[[ord(x) for x in chars]] = c
    return table


def _transitions() -> np.ndarray:
    """State after each class (row) from each state (column)."""
    t = np.full((11, 8), _FREE, dtype=np.uint8)
    t[OTHER] = _RUN
    t[SPACE] = _AFTER_SPACE
    t[QUOTE] = _QUOTED
    t[QUOTE, [_RUN, _AFTER_SPACE, _QUOTED]] = _RUN
    t[S_T_M_D, _QUOTED] = _DONE
    t[R_, _QUOTED], t[V_, _QUOTED], t[L_, _QUOTED] = _QR, _QV, _QL
    t[E_, [_QR, _QV]] = _DONE
    t[L_, _QL] = _DONE
    return t


_NEXT = _transitions()
_IS_WORD = np.isin(np.arange(11), [LETTER, S_T_M_D, R_, V_, L_, E_])
_KIND = np.where(_IS_WORD, 0, np.array([0, 1, 2, 2, 3, 3, 0, 0, 0, 0, 0])).astype(np.uint8)  # letters, numbers, white, others


def states(c: np.ndarray) -> np.ndarray:
    """State after each character, from classes, by a scan over compositions of transition functions."""
    n = len(c)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, dtype=np.uint8)
    padded[:n] = c
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    # a function is eight states; composing a block's functions takes BLOCK steps over all blocks at once
    flat = _NEXT.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for step in grid:
        whole = flat[(step[:, None].astype(np.uint16) << np.uint16(3)) + whole]
    entry = np.fromiter(accumulate(whole[:-1].tolist(), lambda s, f: f[s], initial=_FREE), dtype=np.uint8, count=rows)
    out = np.empty_like(grid)
    now = entry
    for k, step in enumerate(grid):
        now = flat[(step.astype(np.uint16) << np.uint16(3)) + now]
        out[k] = now
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in codepoints of whole texts, laid end to end; first: where texts start."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    c = classes()[points]
    kind = _KIND[c]
    # a text's end breaks every run: states start afresh where a text starts
    lone = np.zeros(len(c) + len(first), dtype=np.uint8)  # a NUMBER before each text resets the automaton
    where = np.arange(len(c)) + np.searchsorted(first, np.arange(len(c)), side="right")
    lone[:] = NUMBER
    lone[where] = c
    state = states(lone)[where]
    start = np.empty(len(c), dtype=bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start[first] = True
    last = np.append(first[1:] - 1, len(c) - 1)
    is_last = np.zeros(len(c), dtype=bool)
    is_last[last] = True
    white = kind == 2
    follows = np.zeros(len(c), dtype=bool)  # not white, after white of the same text
    follows[1:] = ~white[1:] & white[:-1]
    follows[first] = False
    at = np.flatnonzero(follows)
    start[at - 1] = True  # the last white character stands alone or joins the token
    joined = at[c[at - 1] == SPACE]
    start[joined] = False
    done = np.flatnonzero(state == _DONE)
    if len(done):
        size = np.where(c[done] == S_T_M_D, 1, 2)
        for k in (1, 2):
            inside = done[size >= k] - (k - 1)
            start[inside] = False
        start[done - size] = True
        nxt = done + 1
        start[nxt[nxt < len(c)]] = True
    return np.flatnonzero(start)


class Vocabulary(NamedTuple):
    """Ranks of token bytes, merges {left id << 32 | right id: id}, and token bytes end to end."""

    ranks: dict
    merges: dict
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    """A rank file of the public tokenizers' package, by its name, or any other file's path."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, file)))}
    merges = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                merges[a << 32 | b] = rank
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    tokens = [b""] * len(sizes)
    for token, rank in ranks.items():
        tokens[rank], sizes[rank] = token, len(token)
    return Vocabulary(ranks, merges, np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)


class Merger(dict):
    """{slice: its ids as little-endian 32-bit integers}, filled as asked for."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ranks, merges = self.vocab.ranks, self.vocab.merges
        one = ranks.get(data)
        if one is not None:
            ids = [one]
        elif len(data) > 400:
            ids = self._long(data)
        else:
            ids = [ranks[data[i : i + 1]] for i in range(len(data))]
            pairs = [merges.get(a << 32 | b, 1 << 60) for a, b in zip(ids, ids[1:])]
            while pairs:
                best = min(pairs)
                if best == 1 << 60:
                    break
                i = pairs.index(best)
                ids[i : i + 2] = [best]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = merges.get(best << 32 | ids[i + 1], 1 << 60)
                if i:
                    pairs[i - 1] = merges.get(ids[i - 1] << 32 | best, 1 << 60)
        found = np.array(ids, dtype="<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(data) <= 64:
            self[piece] = found
        return found

    def _long(self, data: bytes) -> list[int]:
        """The same merges for a long slice, by a heap over a linked list."""
        import heapq

        ranks, merges = self.vocab.ranks, self.vocab.merges
        ids = [ranks[data[i : i + 1]] for i in range(len(data))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merges.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


_MERGERS: dict[str, Merger] = {}


def merger(name: str) -> Merger:
    if name not in _MERGERS:
        _MERGERS[name] = Merger(vocabulary(name))
    return _MERGERS[name]


def encode(texts: list[str], name: str) -> list[np.ndarray]:
    """Ids of each text."""
    found, out = merger(name), [None] * len(texts)
    held, size = [], 0
    for i, t in enumerate([*texts, None]):
        if t is not None:
            held.append((i, t))
            size += len(t)
        if held and (t is None or size >= CHUNK):
            some = [(k, x) for k, x in held if x]
            for k, x in held:
                if not x:
                    out[k] = np.zeros(0, dtype="<u4")
            if some:
                joined = "".join(x for _, x in some)
                points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
                ends = np.cumsum([len(x) for _, x in some])
                first = ends - np.array([len(x) for _, x in some])
                starts = boundaries(points, first)
                which = np.searchsorted(starts, np.append(first, len(points))).tolist()
                cuts = [*starts.tolist(), len(joined)]
                pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
                for (k, _), a, b in zip(some, which, which[1:]):
                    out[k] = np.frombuffer(b"".join(map(found.__getitem__, pieces[a:b])), dtype="<u4")
            held, size = [], 0
    return out


def decode(ids: np.ndarray, name: str) -> tuple[bytes, np.ndarray]:
    """A text's bytes, and the offset of each token in them."""
    v = vocabulary(name)
    sizes = v.sizes[ids]
    return v.data[ranges(v.starts[ids], sizes)].tobytes(), np.cumsum(sizes) - sizes


def encoded(name: str):
    """Column function: text -> struct(ids array<int>); null counts as empty."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int32) for x in encode([t or "" for t in texts], name)])

    return run


def decoded(name: str):
    """Column function: ids -> struct(bytes, offsets of the tokens)."""
    kind = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def run(ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(np.asarray(x if x is not None else [], dtype=np.int64), name) for x in ids], columns=["bytes", "offsets"])

    return run


def digests(name: str):
    """Column function: text -> struct of the ids' number and hash and the hash of what they decode to."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for a in range(0, len(texts), 256):
            for ids in encode([t or "" for t in texts.iloc[a : a + 256]], name):
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(ids, name)[0]).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op3_byte_bpe(spark, sf_dir: str, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Digests of every row of `documents` encoded and decoded; null and empty texts have no tokens, repeated rows equal digests, very long texts go in pieces cut at token boundaries."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", digests(name)("text").alias("d")).select("doc_id", "d.*")
