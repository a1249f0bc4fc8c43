"""Exact removal of repeated passages with a sparse suffix array (deep-shallow sorting).

A byte goes if a 200-byte string over it also starts anywhere else in the corpus. Sorting
every suffix of the corpus would shuffle 200 bytes for each byte, so the suffix array is
sparse: each 200-byte window elects one *anchor*, the 48-byte string in it with the least
hash. Equal windows elect the same anchor at the same offset, so only windows around equal
anchors can be equal, and one suffix for each anchor is enough, sorted once to the right
and once (reversed) to the left. A window at offset o before its anchor is repeated iff
another text agrees for 200-o bytes to the right and o bytes to the left.

1. groups of texts condense their anchors' hashes; reducers count them (`_anchors`, `_count`);
2. groups cut the stretches around repeated anchors (`_stretches`), alike ones once;
3. reducers sort what follows an anchor, and what precedes it, by deep-shallow sorting and find
   the repeated windows (`_sort`); an anchor with more than HOT_ANCHOR occurrences is split
   before: its windows go by bands of BAND offsets, and the bytes that all windows of a band
   share (196 of the 200) are its longer anchor, so that no anchor gathers in one task;
4. groups join the windows to spans and remove them (`_remove`).

Hashes only decide what meets where; windows are told equal by their bytes. Nulls count as empty
texts; texts under 200 bytes are never changed; rows may repeat.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import U64, grouped_texts, mix, ranges, slices, span_hashes, squeeze, unsqueeze

LENGTH = 200
ANCHOR = 48
#: Depth to which multikey quicksort goes before the blind tries.
SHALLOW = 8
#: Occurrences (counted up to 255 for each group) from which an anchor is split into longer ones, of bands of so many offsets.
HOT_ANCHOR = 4096
BAND = 5
#: Bytes hashed at a time.
PIECE = 1 << 19
_LOW = U64((1 << 24) - 1)
_PACKED = "r int, g int, kind int, payload binary"


# --- anchors -----------------------------------------------------------------------------


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of data[i:i+48] for each i, by doubling."""
    h = (data.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    width, half = 1, None
    while width < 32:
        left, right = h[:-width], h[width:]
        h = (left ^ (left >> U64(29))) * U64(0xBF58476D1CE4E5B9) + (right ^ (right >> U64(31)))
        width *= 2
        if width == 16:
            half = h
    n = len(data) - ANCHOR + 1
    return mix(h[:n] * U64(0x94D049BB133111EB) + half[32 : 32 + n])


def segments(data: np.ndarray, cuts: np.ndarray, length: int = LENGTH):
    """(anchor's hash, anchor, first and last window start) for runs of windows with one anchor.

    data holds whole texts one after another, cuts their ends; no window crosses a cut.
    """
    if len(data) < length:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(U64), z, z, z
    h = _anchor_hashes(data)
    least = (h & ~_LOW) | np.arange(len(h), dtype=U64)
    span, width = 1, length - ANCHOR + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & _LOW).astype(np.int64)
    ok = np.ones(len(anchor), dtype=bool)
    for c in cuts[:-1]:
        ok[max(0, c - length + 1) : c] = False
    edge = np.empty(len(anchor), dtype=bool)
    edge[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=edge[1:])
    edge[1:] |= ok[1:] != ok[:-1]
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(anchor)) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    at = anchor[first]
    # anchors have small hashes, as they won their windows; mixed again they spread evenly
    return mix(h[at] ^ U64(0xA0761D6478BD642F)), at, first, last


def _pieces(texts: list[bytes], length: int):
    """(data, cuts, number of each text, its offset in the text) of about PIECE bytes; long texts in overlapping pieces."""
    held, size = [], 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, PIECE):
            part = t if len(t) <= PIECE + length else t[a : a + PIECE + length - 1]
            held.append((part, k, a))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
            if part is t:
                break
    if held:
        yield held


def _all_segments(texts: list[bytes], length: int):
    """(hash, text, anchor, first, last) arrays over all texts, positions in their text."""
    out = []
    for held in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for p, _, _ in held), dtype=np.uint8)
        ends = np.cumsum([len(p) for p, _, _ in held])
        h, at, first, last = segments(data, ends, length)
        which = np.searchsorted(ends, first, side="right")
        shift = np.array([a for _, _, a in held], dtype=np.int64) - np.append(0, ends[:-1])
        out.append((h, np.array([k for _, k, _ in held], dtype=np.int64)[which], at + shift[which], first + shift[which], last + shift[which]))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(U64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _distinct(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Sorted distinct texts of a group, how often each occurs, and each row's text."""
    texts = sorted(set(pdf["text"]))
    number = {t: i for i, t in enumerate(texts)}
    which = np.fromiter((number[t] for t in pdf["text"]), dtype=np.int64, count=len(pdf))
    return texts, np.bincount(which, minlength=len(texts)), which


def _anchor_counts(texts: list[bytes], copies: np.ndarray, length: int):
    seg = _all_segments(texts, length)
    distinct, where = np.unique(seg[0], return_inverse=True)
    return seg, distinct, where, np.bincount(where, weights=copies[seg[1]], minlength=len(distinct)).astype(np.int64)


def _anchors(length: int, n: int):
    def condense(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, copies, _ = _distinct(pdf)
        _, h, _, count = _anchor_counts(texts, copies, length)
        small = np.minimum(count, 255).astype(np.uint8)
        g = int(pdf["g"].iloc[0])
        return pd.DataFrame([(r, g, 0, h[a:b].tobytes() + small[a:b].tobytes()) for r, a, b in slices(h, n)], columns=["r", "g", "kind", "payload"])

    return condense


def _count(hot: int):
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each group, two bits for each of its hashes, in their order: repeated; hot."""
        hs, cs = [], []
        for p in pdf["payload"]:
            k = len(p) // 9
            hs.append(np.frombuffer(p, dtype=U64, count=k))
            cs.append(np.frombuffer(p, dtype=np.uint8, offset=8 * k))
        _, where = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(cs))[where]
        flags, at, out = np.stack([total >= 2, total >= hot], axis=1), 0, []
        for g, h in zip(pdf["g"], hs):
            out.append((int(pdf["r"].iloc[0]), int(g), 0, np.packbits(flags[at : at + len(h)].ravel()).tobytes()))
            at += len(h)
        return pd.DataFrame(out, columns=["r", "g", "kind", "payload"])

    return reduce


# --- stretches ---------------------------------------------------------------------------

_STRETCH = np.dtype([("h", "<u8"), ("text", "<u4"), ("first", "<u4"), ("left", "<u2"), ("size", "<u2"), ("many", "u1")])
_FOUND = np.dtype([("text", "<u4"), ("first", "<u4"), ("last", "<u4")])


def _bands(data: np.ndarray, k: int, h: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """(hash, text, anchor, first and last window start) of a text's stretches cut at bands of offsets; the hash is of the bytes that all windows of the band share."""
    low, high = (at - last) // BAND, (at - first) // BAND
    which = np.repeat(np.arange(len(at)), high - low + 1)
    band = ranges(low, high - low + 1)
    here = at[which]
    start, end = np.maximum(first[which], here - band * BAND - BAND + 1), np.minimum(last[which], here - band * BAND)
    core = here - band * BAND
    key = mix(h[which] ^ span_hashes(data, core, core + length - BAND + 1) ^ (band.astype(U64) * U64(0x9E3779B97F4A7C15)))
    return key, np.full(len(which), k, dtype=np.int64), here, start, end


def _stretches(length: int, n: int):
    def cut(texts_pdf: pd.DataFrame, flags_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(texts_pdf) or not len(flags_pdf):
            return pd.DataFrame(columns=["r", "g", "kind", "payload"])
        g = int(texts_pdf["g"].iloc[0])
        texts, copies, _ = _distinct(texts_pdf)
        (h, text, at, first, last), distinct, where, _ = _anchor_counts(texts, copies, length)
        got = dict(zip(flags_pdf["r"], flags_pdf["payload"]))
        flags = np.zeros((len(distinct), 2), dtype=bool)
        for r, a, b in slices(distinct, n):
            flags[a:b] = np.unpackbits(np.frombuffer(got[r], dtype=np.uint8), count=2 * (b - a)).reshape(-1, 2)
        found, rows = [], []
        picked = np.flatnonzero(flags[where, 0])
        hot = flags[where[picked], 1]
        cool, hot = picked[~hot], picked[hot]
        parts = [(h[cool], text[cool], at[cool], first[cool], last[cool])]
        for k in np.unique(text[hot]):
            mine = hot[text[hot] == k]
            parts.append(_bands(np.frombuffer(texts[k], dtype=np.uint8), int(k), h[mine], at[mine], first[mine], last[mine], length))
        h, text, at, first, last = (np.concatenate(x) for x in zip(*parts))
        # alike stretches of this group go once
        alike: dict[tuple[bytes, int, int], list[int]] = {}
        for i, (key, k, here, a, b) in enumerate(zip(h.tolist(), text.tolist(), at.tolist(), first.tolist(), (last + length).tolist())):
            alike.setdefault((texts[k][a:b], here - a, key), []).append(i)
        heads, blobs = [], []
        for (blob, left, key), ids in alike.items():
            i = ids[0]
            many = len(ids) > 1 or copies[text[i]] > 1
            if many:
                found += [(text[j], first[j], last[j]) for j in ids]
            heads.append((key, text[i], first[i], left, len(blob), many))
            blobs.append(blob)
        if heads:
            head = np.array(heads, dtype=_STRETCH)
            order = np.argsort(head["h"], kind="stable")
            head = head[order]
            for r, a, b in slices(head["h"], n):
                rows.append((r, g, 1, squeeze(int(b - a).to_bytes(4, "little") + head[a:b].tobytes() + b"".join(blobs[j] for j in order[a:b]))))
        if found:
            rows.append((g % n, g, 3, np.array(found, dtype=_FOUND).tobytes()))
        return pd.DataFrame(rows, columns=["r", "g", "kind", "payload"])

    return cut


# --- deep-shallow sorting ----------------------------------------------------------------


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - (((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) >> 3)


def _blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """ids in the order of their strings: a trie of branching depths alone, checked by one comparison for each string."""
    root = None  # a leaf is [id, ...] of equal strings under key None; a node is [depth, {byte or -1: child}]
    for i in ids:
        s = strings[i]
        if root is None:
            root = (None, [i])
            continue
        node, path = root, []
        while node[0] is not None:
            path.append(node)
            key = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        t = strings[node[1][0]]
        depth = _lcp(s, t)
        if depth == len(s) == len(t):
            node[1].append(i)
            continue
        above, below = None, root
        for p in path:
            if p[0] >= depth:
                below = p
                break
            key = s[p[0]] if p[0] < len(s) else -1
            above, below = p, p[1].get(key)
        key = s[depth] if depth < len(s) else -1
        if below is not None and below[0] == depth:
            below[1][key] = (None, [i])
            continue
        old = t[depth] if depth < len(t) else -1
        node = (depth, {old: below, key: (None, [i])})
        if above is None:
            root = node
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = node
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[0] is None:
            out += node[1]
        else:
            todo += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes], ids: list[int], shallow: int = SHALLOW) -> list[int]:
    """ids in the order of their strings: multikey quicksort to the shallow depth, blind tries below it."""
    out, todo = [], [(ids, 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) < 2:
            out += part
        elif len(part) == 2:
            a, b = part
            out += part if strings[a] <= strings[b] else [b, a]
        elif depth >= shallow:
            out += _blind_trie(strings, part)
        else:
            keys = [strings[i][depth] if depth < len(strings[i]) else -1 for i in part]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            more = [i for i, k in zip(part, keys) if k > pivot]
            same = [i for i, k in zip(part, keys) if k == pivot]
            less = [i for i, k in zip(part, keys) if k < pivot]
            if more:
                todo.append((more, depth))
            if pivot < 0:
                todo.append((same, shallow))
            else:
                todo.append((same, depth + 1))
            if less:
                todo.append((less, depth))
    return out


def _ranked(strings: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, common prefix of each rank with the one before; -1 between groups)."""
    order, lcp = [], []
    for ids in groups:
        got = deep_shallow(strings, ids)
        order += got
        lcp.append(-1)
        lcp += [_lcp(strings[a], strings[b]) for a, b in zip(got, got[1:])]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array(lcp, dtype=np.int64)


def _repeated_windows(stretches: list[tuple[int, bytes, int]], length: int) -> list[np.ndarray]:
    """For stretches (anchor's hash, bytes, bytes before the anchor), all different: the repeated window starts of each.

    Stretches meet by their hash and the anchor's own bytes; what is sorted begins behind the anchor.
    """
    by_anchor = defaultdict(list)
    for i, (h, blob, left) in enumerate(stretches):
        by_anchor[h, blob[left : left + ANCHOR]].append(i)
    groups = [ids for ids in by_anchor.values() if len(ids) > 1]
    out = [np.zeros(0, dtype=np.int64)] * len(stretches)
    members = [i for ids in groups for i in ids]
    if not members:
        return out
    local = {i: k for k, i in enumerate(members)}
    groups = [[local[i] for i in ids] for ids in groups]
    blobs = [stretches[i][1] for i in members]
    left = np.array([stretches[i][2] for i in members], dtype=np.int64)
    size = np.array([len(b) for b in blobs], dtype=np.int64)
    low = left - (size - length)  # offsets of the windows: low..left before the anchor
    right_rank, right_lcp = _ranked([b[k + ANCHOR :] for b, k in zip(blobs, left.tolist())], groups)
    left_rank, left_lcp = _ranked([b[:k][::-1] for b, k in zip(blobs, left.tolist())], groups)
    right_lcp = np.where(right_lcp < 0, -1, right_lcp + ANCHOR)
    hits = [[] for _ in members]
    m = len(members)
    for o in range(int(low.min()), int(left.max()) + 1):
        at = np.flatnonzero((low <= o) & (o <= left))
        if not len(at):
            continue
        key = np.cumsum(right_lcp < length - o)[right_rank[at]] * (m + 1) + np.cumsum(left_lcp < o)[left_rank[at]]
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.append(same, False) | np.append(False, same)
        for k in at[order[twice]].tolist():
            hits[k].append(o)
    for k, i in enumerate(members):
        if hits[k]:
            out[i] = left[k] - np.array(hits[k][::-1], dtype=np.int64)
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of consecutive numbers in sorted starts."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def _sort(length: int):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        found = defaultdict(list)
        index: dict[tuple[int, bytes, int], int] = {}
        owners: list[list] = []
        for g, kind, payload in zip(pdf["g"], pdf["kind"], pdf["payload"]):
            if kind == 3:
                found[g].append(np.frombuffer(payload, dtype=_FOUND))
            else:
                raw = unsqueeze(payload)
                k = int.from_bytes(raw[:4], "little")
                head = np.frombuffer(raw, dtype=_STRETCH, count=k, offset=4)
                at = 4 + head.nbytes
                for h, text, first, left, size, many in head.tolist():
                    key = (h, raw[at : at + size], left)
                    at += size
                    i = index.setdefault(key, len(owners))
                    if i == len(owners):
                        owners.append([])
                    owners[i].append((g, text, first, many))
        stretches = list(index)
        for key, mine, starts in zip(stretches, owners, _repeated_windows(stretches, length)):
            if len(mine) > 1:
                for g, text, first, many in mine:
                    if not many:
                        found[g].append(np.array([(text, first, first + len(key[1]) - length)], dtype=_FOUND))
            elif len(starts) and not mine[0][3]:
                g, text, first, _ = mine[0]
                found[g].append(np.array([(text, first + a, first + b) for a, b in _runs(starts)], dtype=_FOUND))
        r = int(pdf["r"].iloc[0])
        return pd.DataFrame([(r, int(g), 0, np.concatenate(x).tobytes()) for g, x in found.items()], columns=["r", "g", "kind", "payload"])

    return find


# --- removal -----------------------------------------------------------------------------


def spans_of(found: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
    """Maximal removed spans (start, end) of each text from its repeated window starts."""
    out: dict[int, list[tuple[int, int]]] = {}
    f = np.sort(found, order=["text", "first"])
    for text, first, last in f.tolist():
        mine = out.setdefault(text, [])
        if mine and first <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(mine[-1][1], last + length))
        else:
            mine.append((first, last + length))
    return out


def _remove(length: int, keep_text: bool, carried: list[str]):
    def apply(texts_pdf: pd.DataFrame, found_pdf: pd.DataFrame) -> pd.DataFrame:
        texts, _, which = _distinct(texts_pdf)
        parts = [np.frombuffer(p, dtype=_FOUND) for p in found_pdf["payload"]]
        spans = spans_of(np.concatenate(parts), length) if parts else {}
        done = []
        for k, t in enumerate(texts):
            mine, kept, at = spans.get(k, []), [], 0
            for a, b in mine:
                kept.append(t[at:a])
                at = b
            kept.append(t[at:])
            rest = b"".join(kept)
            done.append((len(t), len(t) - len(rest), len(mine), hashlib.sha256(rest).hexdigest(), rest if keep_text else None, [list(x) for x in mine]))
        out = pd.DataFrame([done[k] for k in which], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
        return pd.concat([texts_pdf[["id", *carried]].reset_index(drop=True), out], axis=1)

    return apply


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True, hot_anchor: int = HOT_ANCHOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, columns to carry, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans (start, end).

    Removes every byte under a `length`-byte string that starts more than once in docs,
    copies in one text and overlapping ones included. Null texts count as empty; ids may be
    null or repeated; other columns are not read.
    """
    if length < ANCHOR + 16:
        raise ValueError(f"length must be at least {ANCHOR + 16}")
    kinds = dict(docs.dtypes)
    carried = {f"carried_{k}": F.col(c) for k, c in enumerate(carry)}
    texts, n = grouped_texts(docs, id_col, text_col, more=carried)
    flags = texts.groupBy("g").applyInPandas(_anchors(length, n), _PACKED).groupBy("r").applyInPandas(_count(hot_anchor), _PACKED)
    cut = texts.groupBy("g").cogroup(flags.groupBy("g")).applyInPandas(_stretches(length, n), _PACKED)
    found = cut.groupBy("r").applyInPandas(_sort(length), _PACKED)
    extra = "".join(f"{k} {kinds[c]}, " for k, c in zip(carried, carry))
    schema = f"id {kinds[id_col]}, {extra}n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>"
    out = texts.groupBy("g").cogroup(found.groupBy("g")).applyInPandas(_remove(length, keep_text, list(carried)), schema)
    return out.select(F.col("id").alias(id_col), *(F.col(k).alias(c) for k, c in zip(carried, carry)), *out.columns[1 + len(carry) :])


@F.pandas_udf(T.StringType())
def readable(kept: pd.Series) -> pd.Series:
    """Column function: the remaining bytes as text, without the parts of characters that were cut in two."""
    return pd.Series([b.decode("utf-8", "ignore") if b is not None else None for b in kept])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digests of every row of `documents` without its repeated 200-byte passages; null texts count as empty, copies of a text lose all they share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
