"""The trie of conversations that share their first turns, from composable fingerprints of prefixes.

A conversation c is rebuilt from the head of a base conversation (its first h turns) and its own
turns after the h-th. Nothing is rebuilt as text: a turn is the pair (B, t), t being a hash of
role and text, and pairs multiply by (B^m, s)(B^n, u) = (B^(m+n), s + B^m u) modulo a prime, in
LANES independent lanes. That product is associative, so each part of a long conversation is
multiplied up by itself and shifted by the product of the parts before; and a prefix of a rebuilt
conversation is the base's product at h, times what follows h in its own product.

Equal sequences have equal products. The converse is checked, not hoped for: turns of one hash
are compared as texts (role and text of every stored turn, distinct ones only), and members of one node
as references: one turn hash and one parent for all. By induction over the depth equal fingerprints then mean
equal sequences. Should a check ever fail, all is done anew with other multipliers.

Nodes are rows keyed by depth and fingerprint. Each is named by its smallest member, and the nodes
of one name form a path: a member that is smallest stays so further down. Sums over subtrees
are taken over paths, whose number is that of distinct conversations: parents of paths are
reached by pointer jumping in log2 of the nesting, and then running sums go up each path.

Defined results: rows without conv_id belong to no conversation; turns order by number, nulls
first, ties by their hashes; a null role or text is empty, so is a conversation whose base has no
turns and that has no own after its h-th (it ends at the root). Without rows there is no root.
Repeated rows are turns of their own. Only the four columns are read.

SHA-256 has to read a node's ids in order, so these are joined in chunks by ranges of ids and one
task hashes a node's chunks as they stream by; no list of ids is held.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import stored, text_batches
from aerolith.llm.ordered import ranged, running
from aerolith.llm.sharding import CRC_TABLE

#: Conversations of one base: c and c - c % BASE.
BASE = 100
#: The head's turns are crc32 of the decimal conv_id modulo HEADS.
HEADS = 6
LANES = 4
PRIME = (1 << 31) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

TURN = [f"t{k}" for k in range(LANES)]
PRINT = [f"f{k}" for k in range(LANES)]
ABOVE = [f"a{k}" for k in range(LANES)]
SUM = [f"s{k}" for k in range(LANES)]


class Multipliers:
    """One multiplier for each lane; a seed that also salts the turns' hashes."""

    def __init__(self, seed: int):
        rng = random.Random(seed)
        self.seed, self.base = seed, [rng.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]

    def power(self, lane: int, n: Column) -> Column:
        """base ** n modulo PRIME, for n >= 0, by the bits of n."""
        squares = F.array(*(F.lit(pow(self.base[lane], 1 << k, PRIME)) for k in range(48)))
        bits = F.sequence(F.lit(0), F.length(F.bin(n)) - 1)
        step = lambda acc, k: F.when(F.getbit(n, k) == 1, F.pmod(acc * F.get(squares, k), F.lit(PRIME))).otherwise(acc)
        return F.aggregate(bits, F.lit(1).cast("long"), step)

    def turn(self, lane: int, role: Column, text: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed * LANES + lane), role, text), F.lit(PRIME))


def _head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def _base(conv: Column) -> Column:
    return conv - conv % BASE


def turns(conversations: DataFrame, by: Multipliers) -> DataFrame:
    """Stored turns: conv, i (from 0), turn hash t*, chars, and s*: the product of turns 0 to i, all in one pass over ordered parts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", *(by.turn(k, role, text).alias(t) for k, t in enumerate(TURN)), F.char_length(text).cast("long").alias("chars")
    )
    order = ["turn", *TURN]
    rows = ranged(rows, ["conv", *order], "turns")
    # inside a part each conversation's product starts anew ...
    inside = Window.partitionBy("part", "conv").orderBy(*order, "place")
    rows = rows.withColumn("j", (F.row_number().over(inside) - 1).cast("long"))
    for k, (t, s) in enumerate(zip(TURN, SUM)):
        rows = rows.withColumn(s, F.pmod(F.col(t) * by.power(k, F.col("j")), F.lit(PRIME)))
    segments = rows.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"), *(F.pmod(F.sum(s), F.lit(PRIME)).alias(s) for s in SUM))
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({s: F.pmod(F.sum(s).over(sofar), F.lit(PRIME)) for s in SUM})
    # ... and is shifted by the product of its segments in the parts before
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifted = {s: F.pmod(by.power(k, F.col("n0")) * F.col(s), F.lit(PRIME)) for k, s in enumerate(SUM)}
    segments = segments.withColumns(shifted)
    segments = segments.select("part", "conv", "n0", *(F.pmod(F.coalesce(F.sum(s).over(before), F.lit(0)), F.lit(PRIME)).alias(f"{s}_0") for s in SUM))
    rows = rows.join(segments, ["part", "conv"])
    products = [F.pmod(F.col(f"{s}_0") + by.power(k, F.col("n0")) * F.col(s), F.lit(PRIME)).alias(s) for k, s in enumerate(SUM)]
    return stored(rows.select("conv", (F.col("n0") + F.col("j")).alias("i"), *TURN, "chars", *products), "products")


def hashes_differ(conversations: DataFrame, by: Multipliers) -> bool:
    """Whether two different turns share their hash: distinct turns only are moved, copies combine before the shuffle."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    distinct = conversations.where("conv_id IS NOT NULL").select(role.alias("role"), text.alias("text")).distinct()
    hashed = distinct.select(*(by.turn(k, F.col("role"), F.col("text")).alias(t) for k, t in enumerate(TURN)))
    return bool(hashed.groupBy(*TURN).count().where("count > 1").limit(1).collect())


def prefixes(rows: DataFrame, by: Multipliers) -> DataFrame:
    """(conv, d, f*, t*, chars, ends): a row for each prefix of each rebuilt conversation, d from 0; t* is its last turn's hash."""
    conv = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("i") == _head(F.col("conv")) - 1, F.col(s))).alias(f"cut_{s}") for s in SUM))
    conv = conv.withColumn("h", _head(F.col("conv"))).withColumn("base", _base(F.col("conv")))
    heads = rows.where(F.col("conv") == _base(F.col("conv"))).where(F.col("i") < HEADS - 1).select(F.col("conv").alias("base"), "i", *TURN, "chars", *SUM)
    from_base = conv.select("conv", "base", "h").join(heads, "base").where("i < h").drop("base", "h")
    from_base = stored(from_base, "heads")
    last = from_base.groupBy("conv").agg((F.max("i") + 1).alias("m"), *(F.max_by(s, "i").alias(f"head_{s}") for s in SUM))
    conv = conv.join(last, "conv", "left").withColumn("m", F.coalesce("m", F.lit(0).cast("long")))
    conv = conv.select("conv", "n", "h", "m", *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for s in SUM for c in (f"cut_{s}", f"head_{s}")))
    conv = stored(conv.withColumn("depth", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = rows.join(conv.where("n > h"), "conv").where("i >= h")
    # the suffix's product, divided by B^h and shifted behind the head: B^(m-h) has few values, as m <= h < HEADS
    grown = []
    for k, s in enumerate(SUM):
        inverse = pow(by.base[k], -1, PRIME)
        shift = F.get(F.array(*(F.lit(pow(inverse, x, PRIME)) for x in range(HEADS))), (F.col("h") - F.col("m")).cast("int"))
        grown.append(F.pmod(F.col(f"head_{s}") + shift * F.pmod(F.col(s) - F.col(f"cut_{s}"), F.lit(PRIME)), F.lit(PRIME)).alias(PRINT[k]))
    own = own.select("conv", "depth", (F.col("i") - F.col("h") + F.col("m") + 1).alias("d"), *grown, *TURN, "chars")
    head = from_base.join(conv.select("conv", "depth"), "conv")
    head = head.select("conv", "depth", (F.col("i") + 1).alias("d"), *(F.col(s).alias(f) for s, f in zip(SUM, PRINT)), *TURN, "chars")
    zero = F.lit(0).cast("long")
    root = conv.select("conv", "depth", zero.alias("d"), *(zero.alias(c) for c in (*PRINT, *TURN, "chars")))
    return head.unionByName(own).unionByName(root).withColumn("ends", F.col("d") == F.col("depth")).drop("depth")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and conversation -> runs of ids of one node, joined."""
    for rows in batches:
        if len(rows):
            found = rows.groupby(["d", *PRINT], sort=False)["conv"]
            yield found.agg(first="min", ids=lambda x: ",".join(map(str, x))).reset_index()


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks sorted by node and first id -> the SHA-256 of each node's ids."""
    key, sha = None, None
    done: list[tuple] = []
    for rows in batches:
        for *found, ids in zip(rows["d"], *(rows[f] for f in PRINT), rows["ids"]):
            if found != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = found, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["d", *PRINT, "ends_sha256"])
        done = []
    if key is not None:
        yield pd.DataFrame([(*key, sha.hexdigest())], columns=["d", *PRINT, "ends_sha256"])


def end_digests(found: DataFrame) -> DataFrame:
    """(d, f*, ends_sha256) of nodes at which a conversation ends."""
    key = ", ".join(f"{c} long" for c in ("d", *PRINT))
    ends = found.where("ends").select("d", *PRINT, "conv")
    ends = ends.repartitionByRange("d", *PRINT, "conv").sortWithinPartitions("d", *PRINT, "conv")
    chunks = ends.mapInPandas(_chunks, f"{key}, first long, ids string")
    return chunks.repartition("d", *PRINT).sortWithinPartitions("d", *PRINT, "first").mapInPandas(_digests, f"{key}, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes (conv, d, parent, leaf, saves) -> (conv, d, n_leaves, saved_tokens), sums over the subtree of each.

    A path (nodes of one conv) hangs off node (parent, top - 1) of another. First each path's
    total with all that hangs off it: totals of paths up to 2^k steps below are added in round k.
    """
    paths = nodes.groupBy(F.col("conv").alias("path")).agg(F.min("d").alias("top"), F.min_by("parent", "d").alias("up"), F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved"))
    paths = stored(paths, "paths")
    now = paths.select("path", F.col("up").alias("far"), "leaves", "saved")
    while now.where("far IS NOT NULL").limit(1).collect():
        arrive = now.where("far IS NOT NULL").groupBy(F.col("far").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = now.join(arrive, "path", "left").select(
            "path", "far", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
        )
        # many paths hang off a few: the few that others hang off are what the pointers are looked up in
        further = now.where("far IS NOT NULL").select(F.col("path").alias("far"), F.col("far").alias("further"))
        now = stored(added.join(further, "far", "left").select("path", F.col("further").alias("far"), "leaves", "saved"), "paths")
    hung = now.join(paths.where("up IS NOT NULL").select("path", F.col("up").alias("conv"), (F.col("top") - 1).alias("d")), "path")
    hung = hung.groupBy("conv", "d").agg(F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
    here = nodes.join(hung, ["conv", "d"], "left").select(
        "conv", "d", (F.col("leaf") + F.coalesce("below_leaves", F.lit(0))).alias("leaf"), (F.col("saves") + F.coalesce("below_saved", F.lit(0))).alias("saves"), (-F.col("d")).alias("rise")
    )
    return running(ranged(here, ["conv", "rise"], "path_nodes"), ["conv"], ["rise"], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saves")}).select("conv", "d", "n_leaves", "saved_tokens")


def _nodes(found: DataFrame, by: Multipliers) -> tuple[DataFrame, bool]:
    """Stored nodes, and whether each one's members agree in their last turn and in their parent, whose fingerprint is a*."""
    for k, (f, t) in enumerate(zip(PRINT, TURN)):
        last = F.pmod(F.col(t) * by.power(k, F.greatest(F.col("d") - 1, F.lit(0))), F.lit(PRIME))
        found = found.withColumn(ABOVE[k], F.when(F.col("d") > 0, F.pmod(F.col(f) - last, F.lit(PRIME))).otherwise(-1))
    agreed = [F.min(c) == F.max(c) for c in (*TURN, *ABOVE, "chars")]
    nodes = found.groupBy("d", *PRINT).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in (*ABOVE, "chars")), *(a.alias(f"same{k}") for k, a in enumerate(agreed)))
    same = " AND ".join(f"same{k}" for k in range(len(agreed)))
    nodes = stored(nodes.select("d", *PRINT, "conv", "n_convs", *ABOVE, "chars", F.expr(same).alias("same")), "nodes")
    return nodes, not nodes.where("NOT same").limit(1).collect()


def trie(conversations: DataFrame, seeds=range(1, 100)) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see the module's text."""
    text_batches(conversations.sparkSession)
    for seed in seeds:
        by = Multipliers(seed)
        if hashes_differ(conversations, by):
            continue
        found = stored(prefixes(turns(conversations, by), by), "prefixes")
        nodes, verified = _nodes(found, by)
        if verified:
            break
    else:
        raise ValueError("no seed separated all turns")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), *(F.col(a).alias(f) for a, f in zip(ABOVE, PRINT))).agg(F.count(F.lit(1)).alias("n_children"))
    # a node's parent has another name only at the top of its path
    named = nodes.select((F.col("d") + 1).alias("d"), *(F.col(f).alias(a) for f, a in zip(PRINT, ABOVE)), F.col("conv").alias("parent"))
    tops = nodes.groupBy("conv").agg(F.min("d").alias("d"), *(F.min_by(a, "d").alias(a) for a in ABOVE)).join(named, ["d", *ABOVE]).select("conv", "d", F.col("parent").alias("above"))
    nodes = nodes.drop(*ABOVE).join(children, ["d", *PRINT], "left").join(end_digests(found), ["d", *PRINT], "left").join(tops, ["conv", "d"], "left")
    nodes = nodes.select(
        "conv",
        "d",
        F.when(F.col("d") > 0, F.coalesce("above", "conv")).alias("parent"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"),
    )
    nodes = stored(nodes, "trie")
    return nodes.join(subtree_sums(nodes), ["conv", "d"]).select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt `conversations`; nulls, ties, repeated rows and empty tables as in the module's text."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in DuckDB's SQL, with prefixes as lists of turns; crc32 by its rule, as the function is not built in.
ORACLE_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS l FROM o GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {HEADS} AS h FROM v, crc),
r AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN v b ON b.conv_id = a.conv_id - a.conv_id % {BASE}),
m AS (SELECT conv_id, d, l[1:d] AS p, len(l) = d AS ends FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].text) END AS saves FROM n LEFT JOIN k USING (d, p)),
u AS (SELECT e AS d, p[1:e] AS p, sum(saves) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT p, saves, n_children, unnest(range(d + 1)) AS e FROM s) GROUP BY 1, 2)
SELECT s.conv_id, s.d AS depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM s JOIN u USING (d, p) LEFT JOIN n q ON q.d = s.d - 1 AND q.p = s.p[1:s.d - 1]
"""
