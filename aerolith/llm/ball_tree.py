"""Ranked lexical search: exact largest inner products over sparse vectors in ball trees.

A document's vector has for each query term g = (10^9 tf) div (1000 tf + 12 m), an item's the
term's weight times its repeats; a score is their inner product, whole numbers throughout. One
pass over the texts keeps each document's length and its counts of query terms, as a table;
weights come from that table's totals. A task then takes blocks of documents, builds a ball tree
of each (centroid and radius of every node, halves by the projection on two far documents) and
searches it best-first for every item: no document of a node can score over
centroid . item + radius |item|, nor over that sum with a radius along each term instead of the
one. Texts have few terms in common with an item and many others, so the radius alone shuts out
almost nothing; along terms it leaves out two thirds to three quarters of the leaves. Nodes under the item's 20th best score so
far go unvisited. Bounds are computed in doubles and rounded outwards, which can only open a node
in vain; scores at the leaves are exact. For the balls, weights are split evenly between document and item
(square roots), which leaves all products as they are and radii small.

The best 20 are kept from block to block of a task, so most trees are entered at few leaves; what
tasks found is merged by one ranking. Items are taken in blocks of about BLOCK_TERMS terms, which
bounds what goes to the tasks (to a block or one item, if that is longer); each block is a pass.

Null and empty texts hold no term: such documents and items have no rows. A null item_id or
doc_id is an id like others, before all numbers; rows of one item_id are one item, whose distinct
texts count together. Repeated documents are documents of their own, and rank one after
another. Very long texts are cut into pieces between terms. Only ids and texts are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import ranges, stored, text_batches

TOP = 20
#: Documents of a block, numbers that its nodes' centroids have at most, documents of a leaf.
BLOCK_DOCS = 2048
BLOCK_CELLS = 1 << 22
LEAF = 16
#: Terms of all items in a pass, counted with repeats.
BLOCK_TERMS = 1 << 20
#: Documents of a search task, where there are enough of them.
TASK_DOCS = 1 << 16
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20

#: Terms are runs of digits, letters and all beyond ASCII; A-Z become a-z, other bytes blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> Counter:
    """Counts of a text's terms, as bytes."""
    found: Counter = Counter()
    data = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """g of each entry, whose document has n terms."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    else:
        m = 75 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """The ball tree of one block of documents: entries (document, term, g) by document; terms are numbered inside the block."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, g: np.ndarray, scale: np.ndarray):
        self.terms, local = np.unique(terms, return_inverse=True)
        self.g, self.local, self.lengths = g, local, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.values = g * scale[terms]
        row = np.repeat(np.arange(len(lengths)), lengths)
        self.norms = np.bincount(row, self.values**2, minlength=len(lengths))
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple] = {}
        centres: list[np.ndarray] = []
        radii: list[float] = []
        todo = [np.arange(len(lengths))]
        while len(centres) < len(todo):
            docs = todo[len(centres)]
            centre, radius, halves = self._ball(docs)
            centres.append(centre)
            radii.append(radius)
            if halves is None:
                self.children.append(None)
                self.leaves[len(centres) - 1] = self._leaf(docs)
            else:
                self.children.append((len(todo), len(todo) + 1))
                todo += halves
        self.centres, self.radii = np.array(centres), np.array(radii)
        # centroid plus the radius along each term: the greatest value that a document of the node has
        self.tops = np.zeros_like(self.centres)
        for node in reversed(range(len(todo))):
            if self.children[node] is not None:
                self.tops[node] = self.tops[list(self.children[node])].max(axis=0)
            else:
                at, begins = self.leaves[node][-2:]
                held = np.flatnonzero(np.diff(begins))
                self.tops[node, held] = np.maximum.reduceat(self.values[at], begins[held])

    def _ball(self, docs: np.ndarray):
        lengths = self.lengths[docs]
        at = ranges(self.starts[docs], lengths)
        term, value, norms = self.local[at], self.values[at], self.norms[docs]
        row = np.repeat(np.arange(len(docs)), lengths)
        centre = np.bincount(term, value, minlength=len(self.terms)) / len(docs)
        dot = lambda v: np.bincount(row, value * v[term], minlength=len(docs))
        own = float(centre @ centre)
        away = norms - 2 * dot(centre) + own
        # rounding may cost a few units in the last place of what was subtracted
        radius = math.sqrt(max(0.0, float(away.max())) + 1e-9 * (float(norms.max()) + own))
        if len(docs) <= LEAF:
            return centre, radius, None
        one = self._dense(docs[np.argmax(away)])
        near_one = dot(one)
        other = self._dense(docs[np.argmax(norms - 2 * near_one)])
        order = np.argsort(dot(other) - near_one, kind="stable")
        return centre, radius, [docs[order[: len(docs) // 2]], docs[order[len(docs) // 2 :]]]

    def _dense(self, doc: int) -> np.ndarray:
        at = slice(self.starts[doc], self.starts[doc] + self.lengths[doc])
        return np.bincount(self.local[at], self.values[at], minlength=len(self.terms))

    def _leaf(self, docs: np.ndarray) -> tuple:
        """Its documents; its entries by term: document's number, g, the entry's place, and where each term starts."""
        lengths = self.lengths[docs]
        at = ranges(self.starts[docs], lengths)
        order = np.argsort(self.local[at], kind="stable")
        at = at[order]
        begins = np.searchsorted(self.local[at], np.arange(len(self.terms) + 1))
        return docs, np.repeat(np.arange(len(docs)), lengths)[order], self.g[at], at, begins

    def bounds(self, local: np.ndarray, query: np.ndarray) -> np.ndarray:
        """What no document of a node can pass: by the ball, or by its radius along each of the query's terms."""
        ball = self.centres[:, local] @ query + self.radii * math.sqrt(float(query @ query))
        return np.minimum(ball, self.tops[:, local] @ query) * (1 + 1e-9) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, scale: np.ndarray, floor) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, their scores) of leaves, best bound first, while a leaf may hold a score of floor() or more."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        local, weights = at[known], weights[known]
        if not len(local):
            return
        query = weights / scale[terms[known]]
        bound = self.bounds(local, query)
        whole = float(weights.astype(float).sum()) * 1e6 < 1 << 53
        open_nodes = [(-bound[0], 0)]
        while open_nodes:
            least, node = heapq.heappop(open_nodes)
            if -least < floor():
                return
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(open_nodes, (max(least, -bound[child]), child))
                continue
            docs, row, g, _, begins = self.leaves[node]
            n = begins[local + 1] - begins[local]
            hit = ranges(begins[local], n)
            products = g[hit] * np.repeat(weights, n)
            if whole:  # sums of whole doubles under 2 ** 53 are exact
                scores = np.bincount(row[hit], products, minlength=len(docs)).astype(np.int64)
            else:
                scores = np.zeros(len(docs), dtype=np.int64)
                np.add.at(scores, row[hit], products)
            yield docs, scores


class Best:
    """An item's TOP documents so far as (-score, id is known, id)."""

    def __init__(self):
        self.found: list[tuple[int, bool, int]] = []

    def floor(self) -> int:
        return -self.found[-1][0] if len(self.found) == TOP else 1

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        enough = scores >= self.floor()
        if enough.any():
            more = zip((-scores[enough]).tolist(), known[enough].tolist(), ids[enough].tolist())
            self.found = heapq.nsmallest(TOP, [*self.found, *more])


def _vectors(vocabulary: dict[bytes, int]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, terms, tfs = [], [], []
            for text in rows["text"]:
                found = terms_of(text)
                n.append(sum(found.values()))
                kept = sorted((vocabulary[t], k) for t, k in found.items() if t in vocabulary)
                terms.append([t for t, _ in kept])
                tfs.append([k for _, k in kept])
            yield pd.DataFrame({"known": rows["known"], "id": rows["id"], "n": n, "terms": terms, "tfs": tfs})

    return count


def _full(docs: int, entries: int, vocabulary: int) -> bool:
    nodes = max(1, 2 * docs // LEAF)
    return docs >= BLOCK_DOCS or nodes * min(vocabulary, entries) >= BLOCK_CELLS


def _search(items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, scale: np.ndarray):
    """items: (term numbers ascending, weight times repeats) of each."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        docs = entries = 0
        for rows in batches:
            size = rows["terms"].map(len).to_numpy(dtype=np.int64)
            held.append(rows.assign(size=size)[size > 0])
            docs, entries = docs + len(held[-1]), entries + int(size.sum())
            if _full(docs, entries, len(scale)):
                yield pd.concat(held)
                held, docs, entries = [], 0, 0
        if docs:
            yield pd.concat(held)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best() for _ in items]
        for rows in blocks(batches):
            if not len(rows):
                continue
            lengths = rows["size"].to_numpy(dtype=np.int64)
            terms, tf = (np.concatenate(rows[c].tolist()).astype(np.int64) for c in ("terms", "tfs"))
            g = impacts(tf, np.repeat(rows["n"].to_numpy(dtype=np.int64), lengths), n_docs, n_terms)
            ids, known = rows["id"].to_numpy(dtype=np.int64), rows["known"].to_numpy(dtype=bool)
            tree = Tree(lengths, terms, g, scale)
            for one, (found, weights) in zip(best, items):
                for docs, scores in tree.search(found, weights, scale, one.floor):
                    one.add(scores, known[docs], ids[docs])
        flat = [(k, *row) for k, one in enumerate(best) for row in one.found]
        yield pd.DataFrame({"item": [r[0] for r in flat], "score": [-r[1] for r in flat], "known": [r[2] for r in flat], "id": [r[3] for r in flat]}).astype({"item": "int64", "score": "int64", "known": bool, "id": "int64"})

    return search


def _ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """known, id, text: a null id travels as 0 and not known, as pandas would make doubles of a column with nulls."""
    return df.select(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents over 0 of each item, equal scores by id."""
    spark = docs.sparkSession
    text_batches(spark)
    docs, items = _ids(docs, doc_id, text), _ids(items, item_id, text).distinct()

    def split(batches):
        for rows in batches:
            found = [terms_of(t) for t in rows["text"]]
            yield pd.DataFrame({"known": rows["known"], "id": rows["id"], "terms": [list(c) for c in found], "repeats": [list(c.values()) for c in found]})

    listed = items.mapInPandas(split, "known boolean, id long, terms array<binary>, repeats array<long>").where(F.size("terms") > 0)
    listed = stored(listed, "items")
    n_blocks = -(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    ranked = [_pass(docs, listed.where(F.pmod(F.xxhash64("known", "id"), F.lit(n_blocks)) == b).collect()) for b in range(n_blocks)]
    ranked = [r for r in ranked if r is not None]
    if not ranked:
        return spark.createDataFrame([], f"{item_id} long, rank int, {doc_id} long, score long")
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    order = Window.partitionBy("item_known", "item_id").orderBy(F.col("score").desc(), "known", "id")
    every = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return every.select(F.when(F.col("item_known"), F.col("item_id")).alias(item_id), "rank", F.when(F.col("known"), F.col("id")).alias(doc_id), "score")


def _pass(docs: DataFrame, block: list) -> DataFrame | None:
    """The best documents of each task for the items of one block."""
    texts: dict[tuple[bool, int], Counter] = {}
    for r in block:
        texts.setdefault((r["known"], r["id"]), Counter()).update({bytes(t): k for t, k in zip(r["terms"], r["repeats"])})
    vocabulary = {t: k for k, t in enumerate(sorted({t for c in texts.values() for t in c}))}
    if not vocabulary:
        return None
    vectors = docs.mapInPandas(_vectors(vocabulary), "known boolean, id long, n long, terms array<int>, tfs array<long>")
    vectors = stored(vectors.where("n > 0"), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(vocabulary))], dtype=np.int64)
    scale = np.sqrt(np.maximum(weights, 1).astype(float))
    keys, queries = list(texts), []
    for c in texts.values():
        found = sorted((vocabulary[t], k) for t, k in c.items())
        at = np.array([t for t, _ in found], dtype=np.int64)
        queries.append((at, weights[at] * np.array([k for _, k in found], dtype=np.int64)))
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs // TASK_DOCS))
    found = vectors.coalesce(tasks).mapInPandas(_search(queries, n_docs, n_terms, scale), "item long, score long, known boolean, id long")
    names = docs.sparkSession.createDataFrame([(k, *key) for k, key in enumerate(keys)], "item long, item_known boolean, item_id long")
    return found.join(F.broadcast(names), "item").drop("item")


def op11_ball_tree_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for every item of `benchmark`; nulls, ties, repeated rows and empty tables as in the module's text."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS l FROM documents),
z AS (SELECT count(*) AS n, sum(len(l)) AS total FROM d WHERE len(l) > 0),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2),
f AS (SELECT r, doc_id, n_doc, term, count(*) AS tf FROM (SELECT r, doc_id, len(l) AS n_doc, unnest(l) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY term, n),
s AS (SELECT item_id, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n_doc * n) // total)))) AS BIGINT) AS score
  FROM f JOIN w USING (term) JOIN q USING (term), z GROUP BY 1, 2, 3),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
