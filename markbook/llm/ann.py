"""Approximate nearest neighbours by collision counting.

Largest inner products become smallest distances: every vector gets one more coordinate that brings
it to the greatest length of all, the query gets a zero there.  Each of ``LINES`` random directions is
a hash of its own: a block of vectors keeps one sorted array of projections per direction.  Around the
query's projection a window is opened in every array; virtual rehashing widens all windows by ``GROWTH``
at a time, without hashing anything again, and only the newly covered entries are counted.  A vector
found in at least ``SHARE`` of the windows is verified by its true product.  A query's search in a
block ends when ``TIMES * k`` rows and ``VERIFIED`` of the block are verified, or all are covered.

Queries (a stated set) meet the blocks of all rows in a grid of query blocks and vector blocks; every
row is indexed, each cell returns at most k rows a query, and no vector is broadcast.

Defined results: vectors that are null, zero, or hold a null, NaN or infinity take no part, nor do rows
without an id; of rows that repeat an id the smallest vector counts; only vectors of the query's own
dimension are its candidates; products are summed in the order of the components, so equal vectors have
equal scores, which go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .topk import _matrix, best, usable

K = 20
LINES = 64
SHARE = 0.8
#: First half-width of the windows, and the factor of each rehashing.
FIRST = 1.1
GROWTH = 1.05
#: Rows to verify in a block: so many times k, plus this share of the block.
TIMES = 10
VERIFIED = 0.06
BLOCK = 16384
QUERIES = 512
SEED = 7


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component in double precision."""
    total = np.zeros(len(vectors))
    for i, x in enumerate(query):
        total += x * vectors[:, i]
    return total


def directions(dimension: int, seed: int) -> np.ndarray:
    """Random directions as columns; as many as the dimension allows at a time are orthogonal."""
    draw = np.random.default_rng([seed, dimension])
    parts = [np.linalg.qr(draw.standard_normal((dimension, dimension)))[0] for _ in range(-(-LINES // dimension))]
    return np.concatenate(parts, axis=1)[:, :LINES] * np.sqrt(dimension)


class Index:
    """Sorted projections of a block."""

    def __init__(self, vectors: np.ndarray, greatest: float, seed: int = SEED) -> None:
        n, d = vectors.shape
        self.vectors = vectors
        self.greatest = greatest
        squares = (vectors / greatest) ** 2
        last = np.sqrt(np.maximum(0.0, 1 - squares.sum(axis=1)))
        self.lines = directions(d + 1, seed)
        projected = (vectors / greatest) @ self.lines[:d] + last[:, None] * self.lines[d]
        self.order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=0).T.copy()
        self.order = self.order.T.copy()

    def search(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the places of the vectors that are to be verified."""
        n = len(self.vectors)
        wanted = min(n, TIMES * k + int(np.ceil(VERIFIED * n)))
        units = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = (units @ self.lines[: queries.shape[1]]).T
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at)])
        high = low.copy()
        hits = np.zeros((len(queries), n), np.uint8)
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        searching = np.arange(len(queries))
        width = FIRST
        while len(searching):
            here = at[:, searching]
            below = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, here - width)])
            above = np.array([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, here + width)])
            going = []
            for c, q in enumerate(searching):
                new = [
                    part
                    for order, a, b, x, y in zip(
                        self.order, below[:, c].tolist(), low[:, q].tolist(), high[:, q].tolist(), above[:, c].tolist()
                    )
                    for part in (order[a:b], order[x:y])
                ]
                hits[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
                near = np.flatnonzero(hits[q] >= SHARE * LINES)
                if len(near) >= wanted or (below[:, c].max() == 0 and above[:, c].min() == n):
                    found[q] = near
                else:
                    going.append(c)
            low[:, searching] = np.minimum(below, low[:, searching])
            high[:, searching] = np.maximum(above, high[:, searching])
            searching = searching[going]
            width *= GROWTH
        return found


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = (
        usable(vectors)
        .withColumn("__norm", F.sqrt(squares))
        .where("__norm > 0 AND __norm < double('infinity')")
        .withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
        .withColumn("dim", F.size("v"))
        .select("dim", "vec_id", "v", "__norm")
    )
    counts = whole.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count_if(is_query) / QUERIES).cast("int").alias("shares"),
        F.max("__norm").alias("greatest"),
    )
    known = whole.join(counts, "dim").where("shares > 0")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    share = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shares")).cast("int").alias("share")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = known.where(is_query).select("dim", upto("blocks").alias("block"), share, F.col("vec_id").alias("query_id"), "v")
    right = known.select("dim", block, upto("shares").alias("share"), "vec_id", "v", "greatest")

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            index = Index(_matrix(rows["v"]), float(rows["greatest"].iloc[0]))
            asked = _matrix(queries["q_v"])
            for i, query, near in zip(queries["q_query_id"], asked, index.search(asked, k + 1)):
                near = near[ids[near] != i]
                score = products(query, index.vectors[near])
                found += [(i, ids[near[t]], score[t]) for t in best(score, ids[near], k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    key = ["dim", "block", "share"]
    found = left.toDF(*(f"q_{c}" for c in left.columns)).groupBy(*(f"q_{c}" for c in key)).cogroup(right.groupBy(*key)).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
