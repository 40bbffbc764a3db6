"""Nearest neighbours by vantage-point trees.

Vectors are dealt to shards by a hash of their id.  A shard's tree splits at the median distance
(chord length of unit vectors, which orders as the cosine does) from a vantage point, and keeps
the vectors of its leaves side by side.  Blocks of queries walk a tree together.  A side is left
out when the query's distance to the border exceeds `factor` times its current k-th distance:
factor 1 is the triangle inequality and exact, smaller factors leave out more.

Equal vectors of a shard are one point with their k + 1 smallest ids, which loses nothing: ties
go to the smaller id, and one id may be the query's own.

Vectors are scaled by a power of two to components of at most 1 before any product, so that neither very large nor very
small ones leave the range of doubles; cosines stay the same bit for bit.  Every tree is built once and kept as one row.

Defined results: null, zero and other-length vectors and such with null or non-finite components take no part
(the length is that of the vector of smallest id); repeated ids are repeated candidates; fewer candidates than k give fewer rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

LEAF = 256
#: Vectors of a shard at most (in the mean), and shards at least, so that small tables use all cores.
SHARD_VECTORS, SHARDS = 16_384, 24
#: Queries of a block, and blocks that one task holds.
BLOCK_QUERIES, TASK_BLOCKS = 512, 64


class Tree:
    """A vantage-point tree over the rows of a matrix of unit vectors."""

    def __init__(self, units: np.ndarray, seed: int = 0):
        self.nodes: list[tuple] = []  # (vantage vector, border, inner, outer) or (first, stop)
        rng, order = np.random.default_rng(seed), []
        if len(units):
            self._build(units, np.arange(len(units)), rng, order)
        self.order = np.array(order, np.int64)
        self.units = units[self.order]

    def _build(self, units, rows, rng, order) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) > LEAF:
            # the vantage point is that of a few whose distances spread most
            tries = rng.choice(rows, min(5, len(rows)), replace=False)
            probe = rng.choice(rows, min(256, len(rows)), replace=False)
            vantage = tries[np.argmax([chord(units[probe] @ units[t]).std() for t in tries])]
            distance = chord(units[rows] @ units[vantage])
            border = float(np.median(distance))
            inside = distance <= border
            if 0 < inside.sum() < len(rows):
                inner = self._build(units, rows[inside], rng, order)
                outer = self._build(units, rows[~inside], rng, order)
                self.nodes[at] = (units[vantage], border, inner, outer)
                return at
        self.nodes[at] = (len(order), len(order) + len(rows))
        order.extend(rows.tolist())
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """[queries, k]: rows of the nearest found, -1 where there are fewer."""
        near = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, np.int64)
        if not len(self.units):
            return found
        todo = [(0, np.arange(len(queries)), None)]
        while todo:
            at, who, gap = todo.pop()
            if gap is not None:  # the k-th distance may have come down meanwhile
                who = who[gap <= factor * near[who, -1]]
            if not len(who):
                continue
            node = self.nodes[at]
            if len(node) == 2:
                first, stop = node
                distance = chord(queries[who] @ self.units[first:stop].T)
                both = np.concatenate([near[who], distance], 1)
                rows = np.concatenate([found[who], np.broadcast_to(np.arange(first, stop), distance.shape)], 1)
                best = np.argpartition(both, k - 1, 1)[:, :k]
                both, rows = np.take_along_axis(both, best, 1), np.take_along_axis(rows, best, 1)
                by = np.argsort(both, 1)
                near[who], found[who] = np.take_along_axis(both, by, 1), np.take_along_axis(rows, by, 1)
                continue
            vantage, border, inner, outer = node
            distance = chord(queries[who] @ vantage)
            inside, gap = distance <= border, np.abs(distance - border)
            # the own side first: it is on top of the stack
            todo += [(outer, who[inside], gap[inside]), (inner, who[~inside], gap[~inside]), (inner, who[inside], None), (outer, who[~inside], None)]
        return np.where(found >= 0, self.order[found], -1)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def scaled(vec: np.ndarray) -> np.ndarray:
    """Rows with their largest component between 1/2 and 1."""
    return np.ldexp(vec, -np.frexp(np.abs(vec).max(-1, keepdims=True))[1]) if len(vec) else vec


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one fixed order of additions."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vec of the rows that take part, in double precision."""
    vec = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    df = vectors.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.filter(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50, k: int = 5, factor: float = 0.3) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id `every` divides."""
    points = valid(vectors, id_column, vector_column)
    head = points.agg(F.count("*").alias("n"), F.min_by(F.size("vec"), "id").alias("width")).first()
    n, width = head.n, head.width or 0
    points = points.filter(F.size("vec") == width)
    shards = max(SHARDS, math.ceil(n / SHARD_VECTORS))
    blocks = max(1, math.ceil(n / every / BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    # every block of queries meets every shard once: blocks go along in whole, vectors by shard
    asked = points.filter(F.pmod("id", F.lit(every)) == 0).withColumn("block", block)
    packed = asked.groupBy("block").agg(F.collect_list(F.struct("id", "vec")).alias("queries"))
    pairs = packed.select("block", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    pairs = pairs.withColumn("turn", (F.col("block") / TASK_BLOCKS).cast("int"))
    turns = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // TASK_BLOCKS)))
    trees = written(points.withColumn("shard", shard).select("shard", "id", "vec").groupBy("shard").applyInArrow(_build(width), "shard int, tree binary"), "trees")
    trees = trees.select("shard", "tree", turns.alias("turn"))
    found = trees.groupBy("shard", "turn").cogroup(pairs.groupBy("shard", "turn")).applyInArrow(_search(k, factor, width), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _build(width: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, vec = rows.column("id").to_numpy(), scaled(matrix(rows.column("vec"), width))
        order = np.argsort(ids, kind="stable")
        ids, vec = ids[order], vec[order]
        distinct, member = np.unique(vec, axis=0, return_inverse=True)
        by = np.argsort(member.ravel(), kind="stable")
        starts = np.searchsorted(member.ravel()[by], np.arange(len(distinct) + 1))
        tree = Tree(distinct / np.sqrt((distinct * distinct).sum(1))[:, None])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps((tree, distinct, ids[by], starts))], pa.binary())})

    return run


def _search(k: int, factor: float, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            tree, distinct, ids, starts = pickle.loads(left.column("tree")[0].as_py())
            for i in range(right.num_rows):
                block = right.column("queries")[i].values
                asked, queries = block.field("id").to_numpy(), scaled(matrix(block.field("vec"), width))
                # one more for the query itself, two for ties in the last bits
                rows = tree.search(queries / np.sqrt((queries * queries).sum(1))[:, None], min(k + 3, max(len(distinct), 1)), factor)
                who, what = np.nonzero(rows >= 0)
                what = rows[who, what]
                score = cosines(queries[who], distinct[what])
                found = []
                for j in range(k + 1):  # ids of equal vectors, ascending
                    at = starts[what] + j
                    live = at < starts[what + 1]
                    found.append((who[live], score[live], ids[at[live]]))
                who, score, what = map(np.concatenate, zip(*found, strict=True))
                other = what != asked[who]
                who, score, what = who[other], score[other], what[other]
                order = np.lexsort((what, -score, who))  # k of each query are enough
                who, score, what = who[order], score[order], what[order]
                best = np.arange(len(who)) - np.searchsorted(who, who) < k
                out["query_id"].append(asked[who[best]])
                out["vec_id"].append(what[best])
                out["score"].append(score[best])
        return pa.table({c: np.concatenate(v) if v else np.empty(0, float if c == "score" else np.int64) for c, v in out.items()})

    return run
