"""SimHash near-duplicates: meet-in-the-middle ball hashing over 64-bit fingerprints.

Two fingerprints within 3 bits meet at a middle fingerprint that is at most 1 bit from one
and 2 from the other. So every distinct fingerprint emits the variants within half the
radius: all within 1 bit (rounded down), and, as the radius is odd, half of the fingerprints
also variants at 2 bits (rounded up). Two facts keep these few, and exact:

* fingerprints 3 bits apart differ in parity, so only odd ones need variants at 2 bits;
* of three bits, some two lie in the same half of the 64, so only such pairs are flipped (992
  of 2,016, the fewest that hit every three), and the other side flips the third bit.

Groups of fingerprints deal their variants to reducers by a hash of the variant. A packed row
names each fingerprint that owns a variant there once, with the numbers of its flips: at most
12 bytes a variant whatever the number of reducers, and never the group's other fingerprints.
At most 1,057 distinct fingerprints can share a variant, so no reducer gets hot. The reducer
rebuilds the variants and links every owner of one to an owner at 1 bit or less, never all
pairs; that is within the radius by construction, and checked. Links go back to the groups,
which drop repeats, and then to connected components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import mix, route, stored, text_batches, U64
from aerolith.llm.components import components

RADIUS = 3
SEED = 42
WORDS = 3
#: Fingerprints in a group.
GROUP = 2048
#: Variants for a reducer, about.
REDUCER_VARIANTS = 1_500_000
_PACKED = "r int, g int, payload binary"
#: What a variant flips: nothing, each bit, each pair of bits in one half.
_FLIPS = np.array([0, *(1 << i for i in range(64)), *((1 << half + i) | (1 << half + j) for half in (0, 32) for j in range(32) for i in range(j))], dtype=U64)
#: Of these, the first that flip one bit at most.
_SINGLE = 65
#: Variants of a fingerprint on average, half of them being odd.
_EACH = (_SINGLE + len(_FLIPS)) // 2


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's lower-cased word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    last = ends[len(tokens) - n :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[a:b].tolist(), last[a:b].tolist())])
        ones += np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=U64).view(np.int64))


# --- variants ----------------------------------------------------------------------------


def _pack(f: np.ndarray, owner: np.ndarray, flip: np.ndarray) -> bytes:
    """Variants f[owner] ^ flip, owners in order: each owner once, its number of variants, and their flips."""
    own = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes = np.diff(np.append(own, len(owner))).astype(np.uint16)
    return len(own).to_bytes(4, "little") + f[owner[own]].tobytes() + sizes.tobytes() + flip.astype(np.uint16).tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, flip) of each variant."""
    k = int.from_bytes(payload[:4], "little")
    f = np.frombuffer(payload, dtype=U64, count=k, offset=4)
    sizes = np.frombuffer(payload, dtype=np.uint16, count=k, offset=4 + 8 * k)
    return np.repeat(f, sizes), np.frombuffer(payload, dtype=np.uint16, offset=4 + 10 * k)


def _variants(n: int):
    """For a group (g, f): a packed row for each reducer that gets variants."""

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        g, rows = int(pdf["g"].iloc[0]), []
        every = np.sort(pdf["f"].to_numpy().view(U64))
        for part in range(0, len(every), GROUP):
            f = every[part : part + GROUP]
            number = np.arange(len(f), dtype=np.int32)
            odd = np.flatnonzero(np.bitwise_count(f) & 1)
            to = np.concatenate([route(mix((f[:, None] ^ _FLIPS[:_SINGLE]).ravel()), n), route(mix((f[odd][:, None] ^ _FLIPS[_SINGLE:]).ravel()), n)]).astype(np.int32)
            owner = np.concatenate([np.repeat(number, _SINGLE), np.repeat(number[odd], len(_FLIPS) - _SINGLE)])
            flip = np.concatenate([np.tile(np.arange(_SINGLE, dtype=np.uint16), len(f)), np.tile(np.arange(_SINGLE, len(_FLIPS), dtype=np.uint16), len(odd))])
            order = np.argsort(to.astype(np.int64) * len(f) + owner, kind="stable")
            to, owner, flip = to[order], owner[order], flip[order]
            cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
            rows += [(r, g, _pack(f, owner[a:b], flip[a:b])) for r, a, b in zip(to[cuts[:-1]].tolist(), cuts.tolist(), cuts[1:].tolist())]
        return pd.DataFrame(rows, columns=["r", "g", "payload"])

    return emit


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is connected to) of the links, without nodes that are the least."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links_of_runs(f: np.ndarray, flip: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) of owners of one variant: of each to one that flips one bit at most, if there is one."""
    z = f ^ _FLIPS[flip]
    order = np.argsort(z)
    z = z[order]
    new = np.append(True, z[1:] != z[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(z)))
    several = np.repeat(size > 1, size)
    order, size = order[several], size[size > 1]
    if not len(size):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
    f, single = f[order], flip[order] < _SINGLE
    begin = np.cumsum(size) - size
    run = np.repeat(np.arange(len(size)), size)
    # the least fingerprint of a run among those that flip one bit at most
    head = np.minimum.reduceat(np.where(single, f, U64(0xFFFFFFFFFFFFFFFF)), begin)[run]
    use = np.logical_or.reduceat(single, begin)[run] & (f != head) & (np.bitwise_count(f ^ head) <= radius)
    return f[use], head[use]


def _meet(radius: int, n_groups: int):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        f, flip = (np.concatenate(x) for x in zip(*map(_unpack, pdf["payload"])))
        a, b = _links_of_runs(f, flip, radius)
        if not len(a):
            return pd.DataFrame(columns=["r", "g", "payload"])
        a, b = _forest(a, b)
        to = route(mix(a), n_groups)
        order = np.argsort(to, kind="stable")
        to, a, b = to[order], a[order], b[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        rows = [(0, g, a[i:j].tobytes() + b[i:j].tobytes()) for g, i, j in zip(to[cuts[:-1]].tolist(), cuts.tolist(), cuts[1:].tolist())]
        return pd.DataFrame(rows, columns=["r", "g", "payload"])

    return find


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a group without repeats, as few as connect the same."""
    a = np.concatenate([np.frombuffer(p, dtype=U64, count=len(p) // 16) for p in pdf["payload"]])
    b = np.concatenate([np.frombuffer(p, dtype=U64, offset=len(p) // 2) for p in pdf["payload"]])
    a, b = _forest(a, b)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within the radius; prints has one long column f."""
    if radius != RADIUS:
        raise ValueError("the variants are those for radius 3")
    distinct = stored(prints.select("f").distinct(), "fingerprints")
    total = distinct.count()
    n_groups = max(1, -(-total // GROUP))
    n = max(1, -(-total * _EACH // REDUCER_VARIANTS), min(n_groups, 24))
    groups = distinct.withColumn("g", F.pmod(F.xxhash64("f"), F.lit(n_groups)).cast("int"))
    return groups.groupBy("g").applyInPandas(_variants(n), _PACKED).groupBy("r").applyInPandas(_meet(radius, n_groups), _PACKED).groupBy("g").applyInPandas(_gather, "a long, b long")


def _components_of(prints: DataFrame) -> DataFrame:
    """(f, component, component_id) of each distinct fingerprint: the least linked fingerprint and the least linked id."""
    roots = components(links(prints)).select(F.col("a").alias("f"), F.col("b").alias("root"))
    per_print = prints.groupBy("f").agg(F.min("id").alias("least")).join(roots, "f", "left").withColumn("component", F.coalesce("root", "f"))
    named = per_print.groupBy("component").agg(F.min("least").alias("component_id"))
    return per_print.join(named, "component").select("f", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row: component_id is the least id reachable over links, its own included.

    Null and empty texts have fingerprint zero and link like others. Null ids get a
    component but name none; a component of null ids alone has a null component_id.
    """
    prints = stored(docs.select(F.col(id_col).alias("id"), fingerprints(F.coalesce(F.col(text_col), F.lit(""))).alias("f")), "prints")
    return prints.join(_components_of(prints), "f").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (nulls last; ties by the text's hash).

    Winners are found on ids and hashes alone, so texts are shuffled only once they may stay.
    Of rows alike in id and text one stays, with partial aggregation before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), fingerprints(text).alias("f")), "prints")
    key = F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))
    winners = prints.join(_components_of(prints), "f").groupBy("component").agg(F.min(key).alias("k")).select(F.col("k.id").alias("won_id"), F.col("k.h").alias("won_h"))
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.struct(*docs.columns).alias("row"))
    kept = hashed.join(winners, F.col("id").eqNullSafe(F.col("won_id")) & (F.col("h") == F.col("won_h")), "left_semi")
    alike = prints.groupBy("id", "h").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["id", "h"]) if alike else kept).select("row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `documents`; null and empty texts have fingerprint zero and link like others."""
    text_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
