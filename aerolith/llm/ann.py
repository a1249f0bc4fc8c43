"""Nearest neighbours by score-aware anisotropic quantisation and four-bit table scans.

For the largest inner products, an error along a vector costs more than one across it. The
product quantiser therefore minimises |r|^2 + (eta - 1) * (r . x)^2 over residuals r of unit
vectors x: subspaces of two dimensions, 16 centres each (four bits), codes and centres found
by coordinate descent on that loss, trained on a bounded sample (SAMPLE_ROWS).

Every distinct vector is indexed. Copies of one vector keep their least ids only, as ties go
to the smaller id, so a vector that a third of all rows hold costs one entry. Vectors are
dealt to coarse partitions (spherical k-means on the sample) and inside these to blocks, so a
partition that holds a third of all vectors is many blocks. Quantised is what a vector differs by
from its partition's mean: inside a block, all of one partition, that alone orders the scores. A query visits the partitions
nearest to it, as many as the sample's own neighbours need for a recall of RECALL; where
neighbours know no partitions, as among random vectors, that is all of them, and the search a
scan of all blocks of one partition. A table of 16 products for each subspace and query gives the approximate
scores of a block by look-up; the best of each block, RERANK or the share that the sample's own
neighbours need, are scored exactly in double precision.

Blocks of a partition make tiles, and queries meet tiles, both by a shuffle: a query is copied once
for each tile that it visits, and a tile sends on its best k for each query. The sample is fitted in
one task. To the driver come the centres alone, which the sample bounds, never queries or blocks.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Ids may repeat; a query never finds rows of its own id; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from aerolith.llm.common import ranges, stored

NEAREST = 5
SAMPLE_ROWS = 20_000
BLOCK = 4096
QUERY_BLOCK = 256
#: Bytes of blocks, and of queries, that meet in one Python call, about.
CELL_BYTES = 32 << 20
#: Tasks in which they meet, at most.
CELL_TASKS = 2000
RERANK = 96
SUBSPACE = 2
CENTRES = 16
#: Vectors of a partition, about, as far as the sample allows.
PART = 1024
#: How much deeper than the sample needs a block is scored exactly.
DEEPER = 1.5
#: Recall on the sample that decides how many partitions a query visits.
RECALL = 0.98
#: Sampled vectors for each partition, at least, and those asked to measure that recall.
SAMPLED_EACH = 64
ASKED = 512
#: Inner products that matter are above this share of the norms; sets how much parallel error weighs.
THRESHOLD = 0.2


def eta(dimensions: int) -> float:
    return max(1.0, (dimensions - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _parts(x: np.ndarray) -> np.ndarray:
    """(subspaces, rows, SUBSPACE), the last subspace filled with zeros."""
    short = -x.shape[1] % SUBSPACE
    x = np.pad(x, ((0, 0), (0, short)))
    return np.ascontiguousarray(x.reshape(len(x), -1, SUBSPACE).transpose(1, 0, 2))


def encode(units: np.ndarray, centres: np.ndarray, weight: float, means: np.ndarray | float = 0.0, passes: int = 2) -> np.ndarray:
    """Code of each subspace for unit vectors less their partition's mean, by coordinate descent on the anisotropic loss."""
    x, y = _parts(units), _parts(units - means)
    codes = np.stack([((t[:, None] - c) ** 2).sum(axis=2).argmin(axis=1) for t, c in zip(y, centres)])
    along = np.stack([((t - c[k]) * p).sum(axis=1) for p, t, c, k in zip(x, y, centres, codes)])
    total = along.sum(axis=0)
    for _ in range(passes):
        for s, (p, t, c) in enumerate(zip(x, y, centres)):
            r = t[:, None] - c
            dot = (r * p[:, None]).sum(axis=2)
            loss = (r**2).sum(axis=2) + (weight - 1) * ((total - along[s])[:, None] + dot) ** 2
            codes[s] = loss.argmin(axis=1)
            new = dot[np.arange(len(p)), codes[s]]
            total += new - along[s]
            along[s] = new
    return codes.T.astype(np.uint8)


def train(units: np.ndarray, means: np.ndarray | float = 0.0, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres (subspaces, CENTRES, SUBSPACE) for unit vectors less their partitions' means."""
    rng = np.random.default_rng(seed)
    weight = eta(units.shape[1])
    x, y = _parts(units), _parts(units - means)
    pick = rng.integers(0, len(units), (len(x), CENTRES))
    centres = np.stack([t[i] for t, i in zip(y, pick)]) + rng.normal(0, 1e-4, (len(x), CENTRES, SUBSPACE))
    for _ in range(rounds):
        codes = encode(units, centres, weight, means, passes=1).T
        along = np.stack([((t - c[k]) * p).sum(axis=1) for p, t, c, k in zip(x, y, centres, codes)])
        total = along.sum(axis=0)
        for s, (p, t) in enumerate(zip(x, y)):
            rest = total - along[s]
            for k in range(CENTRES):
                mine = codes[s] == k
                if not mine.any():
                    centres[s, k] = t[rng.integers(0, len(t))]
                    continue
                px, ty = p[mine], t[mine]
                left = len(px) * np.eye(SUBSPACE) + (weight - 1) * px.T @ px
                right = ty.sum(axis=0) + (weight - 1) * px.T @ (rest[mine] + (px * ty).sum(axis=1))
                centres[s, k] = np.linalg.solve(left, right)
            new = ((t - centres[s][codes[s]]) * p).sum(axis=1)
            total += new - along[s]
            along[s] = new
    return centres


def averages(units: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Mean of the sample's unit vectors in each partition."""
    of = (units @ coarse.T).argmax(axis=1)
    total = np.zeros_like(coarse)
    np.add.at(total, of, units)
    return total / np.maximum(np.bincount(of, minlength=len(coarse)), 1)[:, None]


def partitions(units: np.ndarray, n: int, rounds: int = 10, seed: int = 9) -> np.ndarray:
    """Centres of at most n partitions of unit vectors, by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = units[np.sort(rng.permutation(len(units))[:n])]
    for _ in range(rounds if len(centres) > 1 else 0):
        of = (units @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, units)
        size = np.sqrt((total**2).sum(axis=1))
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def visits(units: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many partitions must be visited for the recall, measured on the sample's own nearest."""
    some = units[:: max(1, len(units) // ASKED)]
    score = some @ units.T
    np.put_along_axis(score, score.argmax(axis=1)[:, None], -2, axis=1)  # itself
    k = min(k, len(units) - 1)
    if k < 1 or len(centres) < 2:
        return len(centres)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = (-(some @ centres.T)).argsort(axis=1).argsort(axis=1)  # of each partition, nearest first
    need = np.sort(np.take_along_axis(place, (units @ centres.T).argmax(axis=1)[near], axis=1).ravel())
    least = int(need[int(np.ceil(recall * len(need))) - 1]) + 1
    return least if least <= 0.75 * len(centres) else len(centres)


def depth(units: np.ndarray, coarse: np.ndarray, means: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> float:
    """Share of a block that must be scored exactly for the recall, measured on the sample's own nearest."""
    some = units[:: max(1, len(units) // (ASKED // 2))]
    of = (units @ coarse.T).argmax(axis=1)
    score = some @ units.T
    own = score.argmax(axis=1)
    np.put_along_axis(score, own[:, None], -2, axis=1)
    k = min(k, len(units) - 1)
    if k < 1:
        return 0.0
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    codes = encode(units, centres, eta(units.shape[1]), means[of])
    about = scan(codes, np.einsum("sqd,scd->qsc", _parts(some).astype(np.float32), centres.astype(np.float32)))
    need = [((about[i][mine] > about[i, j]).sum() + 1) / len(mine) for i, row in enumerate(near) for j in row for mine in [np.flatnonzero(of == of[j])]]
    need.sort()
    return float(need[int(np.ceil(recall * len(need))) - 1])


def _visited(centres: np.ndarray, n: int):
    """Column function: vector -> the n nearest partitions."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        score = -(_units(np.stack(vectors.to_numpy())) @ centres.T)
        return pd.Series(list(score.argsort(axis=1, kind="stable")[:, :n].astype(np.int32)))

    return run


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def _valid(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)")


_FITTED = "coarse binary, means binary, centres binary, n_visits int, share double"


def _fit(dimensions: int, total: int, k: int, exact: bool):
    """Batches of the sample's vectors -> one row of what it taught; none for no vectors."""

    def run(batches):
        sample = [np.stack(pdf["v"].to_numpy()).astype(np.float64) for pdf in batches if len(pdf)]
        if not sample:
            return
        v = np.concatenate(sample)
        units = _units(v[np.lexsort(v.T[::-1])])
        coarse = partitions(units, max(1, min(len(units) // SAMPLED_EACH, total // PART)))
        n_visits = len(coarse) if exact else visits(units, coarse, k)
        if n_visits == len(coarse):
            coarse, n_visits = partitions(units, 1), 1
        means = averages(units, coarse)
        centres = train(units, means[(units @ coarse.T).argmax(axis=1)])
        share = DEEPER * depth(units, coarse, means, centres, k)
        yield pd.DataFrame([(coarse.tobytes(), means.tobytes(), centres.tobytes(), n_visits, share)], columns=["coarse", "means", "centres", "n_visits", "share"])

    return run


def tiles(n_blocks: list[int], block_bytes: int, least: int) -> tuple[int, list[int]]:
    """Blocks of a tile, and each partition's first tile: as few tiles as leave `least` tasks work and keep a tile within CELL_BYTES."""
    each = max(1, min(CELL_BYTES // block_bytes, sum(n_blocks) // least))
    return each, np.cumsum([0, *(-(-n // each) for n in n_blocks)]).tolist()


def _pack_block(centres: np.ndarray, means: np.ndarray, weight: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, rows = int(pdf["tile"].iloc[0]), []
        for a in range(0, len(pdf), BLOCK):
            part = pdf.iloc[a : a + BLOCK]
            v = np.stack(part["v"].to_numpy()).astype(np.float64)
            codes = encode(_units(v), centres, weight, means[int(part["part"].iloc[0])])
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            ids = [np.asarray(x, dtype=np.int64) for x in part["ids"]]
            rows.append((tile, (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8).tobytes(), v.tobytes(), np.concatenate(ids).tobytes(), np.array([len(x) for x in ids], dtype=np.int64).tobytes(), len(part)))
        return pd.DataFrame(rows, columns=["tile", "codes", "vectors", "ids", "sizes", "n"])

    return run


_QUERIES = "part int, of int, q_vectors binary, q_ids binary"


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for a in range(0, len(pdf), QUERY_BLOCK):
        some = pdf.iloc[a : a + QUERY_BLOCK]
        rows.append((int(some["part"].iloc[0]), int(some["of"].iloc[0]), np.stack(some["v"].to_numpy()).astype(np.float64).tobytes(), some["id"].to_numpy(dtype=np.int64).tobytes()))
    return pd.DataFrame(rows, columns=["part", "of", "q_vectors", "q_ids"])


def scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows) from four-bit codes (rows, subspaces) and tables (queries, subspaces, CENTRES)."""
    out = np.zeros((len(tables), len(codes)), dtype=np.float32)
    columns = np.ascontiguousarray(codes.T)
    for s, c in enumerate(columns):
        out += tables[:, s].take(c, axis=1)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, ties to smaller ids, none twice."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])][: len(ids)]
    return ids[new][:k], scores[new][:k]


def _meet(centres: np.ndarray, dimensions: int, k: int, rerank: int, share: float):
    """A tile's blocks and the queries that meet it -> the tile's best k for each query."""
    table_of = centres.astype(np.float32)

    def unpacked(row):
        v = np.frombuffer(row.vectors).reshape(row.n, dimensions)
        packed = np.frombuffer(row.codes, dtype=np.uint8).reshape(row.n, -1)
        codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(row.n, -1)[:, : len(centres)]
        sizes = np.frombuffer(row.sizes, dtype=np.int64)
        return codes, v, np.sqrt((v * v).sum(axis=1)), np.frombuffer(row.ids, dtype=np.int64), sizes, np.cumsum(sizes) - sizes

    def run(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index = [unpacked(row) for row in blocks.itertuples()] if len(asked) else []
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for row in asked.itertuples() if index else ():
            q = np.frombuffer(row.q_vectors).reshape(-1, dimensions)
            q_ids, q_norms = np.frombuffer(row.q_ids, dtype=np.int64), np.sqrt((q * q).sum(axis=1))
            tables = np.einsum("sqd,scd->qsc", _parts(_units(q)).astype(np.float32), table_of)
            found: list[list] = [[] for _ in q_ids]
            for codes, v, norms, ids, sizes, first in index:
                near = scan(codes, tables)
                take = min(max(rerank, int(share * len(v)) + 1), len(v))
                for i, at in enumerate(np.argpartition(-near, take - 1, axis=1)[:, :take]):
                    exact = (v[at] * q[i]).sum(axis=1) / (norms[at] * q_norms[i])
                    these, scores = ids[ranges(first[at], sizes[at])], np.repeat(exact, sizes[at])
                    other = these != q_ids[i]
                    found[i].append(_best(these[other], scores[other], k))
            for own, each in zip(q_ids, found):
                these, scores = _best(*map(np.concatenate, zip(*each)), k)
                out.append((np.full(len(these), own), these, scores))
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], map(np.concatenate, zip(*out)))))

    return run


def learned(vectors: DataFrame, dimensions: int, total: int, k: int, sample_rows: int, exact: bool) -> Row:
    """What a sample of the distinct vectors v teaches; it is fitted in one task."""
    share = min(1.0, sample_rows / total)
    sample = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().limit(2 * sample_rows)
    # a limit that holds anyway is dropped at run time, and with it the one partition that it makes
    fits = (x.repartition(1).mapInPandas(_fit(dimensions, total, k, exact), _FITTED) for x in (sample, vectors.limit(1)))
    (one,) = next(filter(None, (x.collect() for x in fits)))
    return one


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest rows of vectors by cosine; exact: visiting all partitions."""
    spark = vectors.sparkSession
    valid = _valid(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), "v").where("id is not null")
    lengths = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, total = lengths[0]["d"], lengths[0]["count"]
    valid = valid.where(F.size("v") == d)
    # of copies, the least ids: k, and one more that may be the query's own
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = valid.distinct().withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    *arrays, n_visits, share = learned(valid.select("v"), d, total, k, sample_rows, exact)
    coarse, means, centres = (np.frombuffer(x).reshape(shape) for x, shape in zip(arrays, [(-1, d), (-1, d), (-1, CENTRES, SUBSPACE)]))
    dealt = stored(distinct.withColumn("part", _visited(coarse, 1)("v")[0]), "dealt")
    sizes = dict(map(tuple, dealt.groupBy("part").count().collect()))  # one row for each partition
    n_blocks = [-(-sizes.get(i, 0) // BLOCK) for i in range(len(coarse))]
    first = np.cumsum([0, *n_blocks]).tolist()
    of_part = lambda values: F.element_at(F.lit(values), F.col("part") + 1)
    block = (of_part(first) + F.pmod(F.xxhash64("v"), of_part([max(1, n) for n in n_blocks]).cast("long"))).cast("int")
    each, first_tile = tiles(n_blocks, BLOCK * (8 * d + -(-d // 4) + 16), 4 * spark.sparkContext.defaultParallelism)
    tile = (of_part(first_tile) + F.floor((F.col("block") - of_part(first)) / each)).cast("int")
    blocks = dealt.withColumn("block", block).withColumn("tile", tile).groupBy("tile", "block")
    index = stored(blocks.applyInPandas(_pack_block(centres, means, eta(d)), "tile int, codes binary, vectors binary, ids binary, sizes binary, n int"), "index")
    asked = _valid(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), "v").where((F.size("v") == d) & F.col("id").isNotNull())
    asked = stored(asked, "queries")
    n_asked = asked.count()
    of = F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-n_asked // QUERY_BLOCK)))).cast("int")
    part = F.explode(_visited(coarse, n_visits)("v")) if len(coarse) > 1 else F.lit(0)
    packed = asked.withColumn("part", part).withColumn("of", of).groupBy("part", "of").applyInPandas(_pack_queries, _QUERIES)
    # cells: a tile, and a share of the queries that one Python call can hold
    shares = max(1, -(-n_asked * 8 * (d + 1) // CELL_BYTES))
    n_cells = max(1, min(CELL_TASKS, first_tile[-1] * shares))
    tile = F.explode(F.sequence(of_part(first_tile), of_part(first_tile[1:]) - 1))
    packed = packed.where(of_part(n_blocks) > 0).select(tile.alias("tile"), F.pmod("of", F.lit(shares)).alias("cell"), "q_vectors", "q_ids")
    index = index.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    left, right = (x.repartition(n_cells, "tile", "cell").groupBy("tile", "cell") for x in (index, packed))
    found = left.cogroup(right).applyInPandas(_meet(centres, d, k, rerank, share), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_anisotropic_ann(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of `embeddings` of each row whose vec_id is divisible by 50; rows without a usable vector take no part."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
