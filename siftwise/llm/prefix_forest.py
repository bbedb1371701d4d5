"""Nearest neighbours by a hash-prefix forest.

Each tree gives a vector a hash string: one bit for each of `BITS` random planes. Rows are filed
in blocks; a block keeps, for each tree, its rows' strings as a sorted array. A query descends
every tree to its longest matching prefix, then ascends all trees together, bit by bit; at each
depth it scores the rows that share the prefix in some tree. It stops at the depth, and within it at
the tree, at which a row as near as the best k so far would have been met with probability `RECALL`
or more: near neighbours end the ascent early, far ones make it go on, in data of any size.

Queries meet every block in turn: both sides are cut into blocks, each pair of blocks is one
group, and of each group only the best k of each query go on.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part;
vectors meet only those of their own dimension; equal scores go by the smaller id; rows with a
null id take no part; repeated ids are separate candidates, except that a query never meets a row
with its own id; a query without candidates has no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TREES, BITS, RECALL = 64, 32, 0.9
#: Rows of a block (larger ones are read to a smaller share), and queries that a block's forest is built for at most and at least.
ROWS, QUERIES, FEW = 65_536, 32_768, 256
SEED = 11


def planes(dimension: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, trees * bits)).astype(np.float32)


def strings(x: np.ndarray, flat: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, n) hash strings, the first bit highest."""
    out = np.zeros((trees, len(x)), np.uint32)
    for at in range(0, len(x), 1024):
        on = (x[at : at + 1024].astype(np.float32) @ flat >= 0).reshape(-1, trees, bits)
        value = np.zeros(on.shape[:2], np.uint32)
        for b in range(bits):
            value = (value << np.uint32(1)) | on[:, :, b]
        out[:, at : at + 1024] = value.T
    return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, component by component in order, so that equal vectors score equally."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * q[k]
    return out


class Forest:
    """Sorted hash strings of the rows of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, flat: np.ndarray, trees: int, bits: int):
        self.ids, self.x, self.bits, self.trees = ids, x, bits, trees
        self.light = x.astype(np.float32)  # what ranges are scored by; the best are scored anew in double precision
        self.read = 0  # rows scored for all queries
        self.longest_row = float(np.sqrt((x * x).sum(1)).max())
        hashed = strings(x, flat, trees, bits)
        order = np.argsort(hashed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashed, order, axis=1)
        self.order = list(order.astype(np.int32))

    def longest(self, q: np.ndarray) -> np.ndarray:
        """Length of each query's longest matching prefix in any tree. q: (trees, queries)."""
        best = np.zeros(q.shape[1], np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], q[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.ids) - 1)):
                differ = (self.sorted[t][near] ^ q[t]).astype(np.float64)
                best = np.maximum(best, self.bits - np.frexp(differ)[1])
        return best

    def ranges(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): where rows lie that share the leading `depth` bits."""
        keep = (0xFFFFFFFF << (self.bits - depth)) & ((1 << self.bits) - 1)
        first = q & np.uint32(keep)
        last = first | np.uint32(~keep & ((1 << self.bits) - 1))
        low = np.stack([np.searchsorted(self.sorted[t], first[t], "left") for t in range(self.trees)])
        return low, np.stack([np.searchsorted(self.sorted[t], last[t], "right") for t in range(self.trees)])

    def search(self, ids: np.ndarray, x: np.ndarray, flat: np.ndarray, k: int, recall: float) -> list[tuple[int, int, float]]:
        hashed = strings(x, flat, self.trees, self.bits)
        out = []
        for at in range(0, len(ids), 256):
            q = hashed[:, at : at + 256]
            asked = [_Query(self, int(i), v, k, recall) for i, v in zip(ids[at : at + 256], x[at : at + 256], strict=True)]
            start = self.longest(q)
            for depth in range(int(start.max()), -1, -1):
                own = [j for j, a in enumerate(asked) if start[j] >= depth and not a.done]
                if not own:
                    continue
                low, high = self.ranges(q[:, own], depth)
                enough = (high - low).sum(0) >= 8 * k  # fewer could not fill the k best; ascend at once
                for j, lo, hi, ready in zip(own, low.T.tolist(), high.T.tolist(), enough.tolist(), strict=True):
                    if ready or not depth:
                        asked[j].look(depth, lo, hi)
            for a in asked:
                out += a.best()
        return out


class _Query:
    """What one query has met in a forest so far."""

    def __init__(self, forest: Forest, own: int, q: np.ndarray, k: int, recall: float):
        self.forest, self.own, self.q, self.k, self.recall = forest, own, q, k, recall
        self.light = q.astype(np.float32)
        self.size = math.sqrt(float(q @ q))
        self.seen = forest.ids == own
        self.rows: list[np.ndarray] = []
        self.scores: list[np.ndarray] = []
        self.met, self.done = 0, False

    def look(self, depth: int, low: list[int], high: list[int]) -> None:
        """Score the rows of the trees' ranges at a depth: of all trees, or of as many as the wanted chance asks for."""
        f = self.forest
        trees = self.trees_needed(depth)
        if trees:
            mark = np.zeros(len(f.ids), bool)
            mark[np.concatenate([order[a:b] for order, a, b in zip(f.order[:trees], low, high, strict=False)])] = True
            mark &= ~self.seen
            new = np.flatnonzero(mark)
            if len(new):
                self.seen |= mark
                self.rows.append(new)
                self.scores.append(f.light[new] @ self.light)
                self.met += len(new)
                f.read += len(new)
        self.done = trees < f.trees

    def trees_needed(self, depth: int) -> int:
        """How many trees must ascend to this depth, when all were one deeper, for the wanted chance to have met the k best."""
        f = self.forest
        if self.met < self.k or not depth:
            return f.trees
        total = np.concatenate(self.scores)
        bound = float(-np.partition(-total, self.k - 1)[self.k - 1])
        # the chance that a bit is shared with a row at the widest angle at which the longest row scores as the k-th best
        near = 1 - math.acos(max(-1.0, min(1.0, bound / (self.size * f.longest_row)))) / math.pi
        here, before = math.log1p(-min(near**depth, 1 - 1e-12)), math.log1p(-min(near ** (depth + 1), 1 - 1e-12))
        if here >= before:
            return 0
        return max(0, min(f.trees, math.ceil((math.log1p(-self.recall) - f.trees * before) / (here - before))))

    def best(self) -> list[tuple[int, int, float]]:
        if not self.met:
            return []
        f = self.forest
        found, total = np.concatenate(self.rows), np.concatenate(self.scores)
        if len(total) > self.k:
            bound = float(-np.partition(-total, self.k - 1)[self.k - 1])
            found = found[total >= bound - 1e-5 * (self.size * f.longest_row + abs(bound))]
        scores = exact(f.x[found], self.q)
        order = np.lexsort((f.ids[found], -scores))[: self.k]
        return [(self.own, int(f.ids[i]), float(v)) for i, v in zip(found[order], scores[order], strict=True)]


def _search(k: int, trees: int, bits: int, recall: float):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        flat = planes(int(key[0]), trees, bits)
        forest = Forest(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.float64), flat, trees, bits)
        got = forest.search(queries["vec_id"].to_numpy(np.int64), np.stack(queries["v"].to_numpy()).astype(np.float64), flat, k, recall)
        return pd.DataFrame(got, columns=columns)

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, v (doubles), dim of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & some).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, is_query, k: int = 20, trees: int = TREES, bits: int = BITS, recall: float = RECALL, block_rows: int = ROWS, block_queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product found for each query.

    is_query: a condition on vec_id. Blocks are dealt by hash, so equal vectors spread.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = common.checkpointed(usable(vectors))
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    parts = max(1, math.ceil(n / block_rows))
    # rows are copied once for each group of queries: as few groups as tasks are wanted
    groups = max(1, math.ceil(m / block_queries), min(math.ceil(m / FEW), math.ceil(spark.sparkContext.defaultParallelism / parts)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("group", every(groups))
    right = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", every(parts))
    keys = ["dim", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k, trees, bits, recall), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
