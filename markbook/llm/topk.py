"""Exact top-k by inner product: norm-bucketed retrieval.

Components become integers, so every product is exact.  Vectors are grouped by length, and long groups
are cut into blocks of ``BLOCK`` rows.  A query first meets the ``PROBE`` longest vectors of all; its
k-th product there is a floor that the answer can't fall below.  In a group whose longest vector has
length l, only vectors with cosine >= floor / (|q| l) can count.  If no cosine reaches that, the group
is skipped for the query.  If the local threshold is high, coordinates prune: each of the query's
largest coordinates confines a vector's coordinate to an interval.  If it is low, length prunes: only
vectors at least floor / |q| long are looked at.  What remains is verified by full products; the floor
rises as blocks are worked off.  All bounds are widened by more than the rounding error, and ties with
the floor stay.

Queries (a stated set) meet the blocks of all rows in a grid of query blocks and vector blocks; each
cell returns at most k rows a query.  The probe is the only broadcast: at most ``PROBE`` vectors.

Defined results: vectors that are null, hold a null, NaN or infinity, or whose squared integer length
is beyond 62 bits take no part, nor do rows without an id; of rows that repeat an id the smallest
vector counts; only vectors of the query's own dimension are its candidates; equal scores go to the
smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 10
SCALE = 1024.0
BLOCK = 4096
QUERIES = 1024
PROBE = 2048
#: Coordinates that prune, and the local cosine from which they do.
FOCUS, STEEP = 6, 0.6


def usable(vectors: DataFrame) -> DataFrame:
    """One row an id: vec_id, embedding; without what takes no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    )
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def integers(embedding: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles that hold integers."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), float).reshape(len(rows), -1)


def products(queries: np.ndarray, vectors: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer products: doubles hold them below 2**53, longs beyond."""
    if largest < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    return np.einsum("qd,vd->qv", queries.astype(np.int64), vectors.astype(np.int64))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then by the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _cell(qid, q, floor, vid, v, k):
    """The k best of a block for each query, pruned by each query's floor: (query, vector, score)."""
    lengths, q_lengths = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(-lengths, kind="stable")
    v, vid, lengths = v[order], vid[order], lengths[order]
    longest = lengths[0] if len(lengths) else 0.0
    units = v / np.maximum(lengths, 1e-300)[:, None]
    out = []
    for i in range(len(q)):
        reach = q_lengths[i] * longest
        least = floor[i] - 1e-6 * (abs(floor[i]) + reach) - 1e-6
        if reach < least:
            continue
        near = np.arange(len(v))
        cosine = least / reach if reach > 0 else -1.0
        if least > 0:
            near = near[: np.searchsorted(-lengths, -least / q_lengths[i], "right")]
        if cosine >= STEEP and len(near):
            # A vector within the threshold's angle of the query lies within that angle, more or less,
            # of the query's own angle to each axis.
            to_axis = np.arccos(np.clip(q[i] / q_lengths[i], -1, 1))
            apart = np.arccos(min(cosine, 1.0))
            for f in np.argsort(-np.abs(q[i]))[:FOCUS]:
                low = np.cos(min(np.pi, to_axis[f] + apart)) - 1e-6
                high = np.cos(max(0.0, to_axis[f] - apart)) + 1e-6
                at = units[near, f]
                near = near[(at >= low) & (at <= high)]
        near = near[vid[near] != qid[i]]
        if not len(near):
            continue
        score = products(q[i : i + 1], v[near], reach)[0]
        top = best(score, vid[near], k)
        out += [(qid[i], vid[near[t]], score[t]) for t in top if score[t] >= least]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query with other rows."""
    spark = vectors.sparkSession
    whole = usable(vectors).select("vec_id", integers(F.col("embedding"), scale).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sized = whole.withColumn("__norm", F.sqrt(squares)).where("__norm < 2147483648.0").withColumn("dim", F.size("v"))

    # Longest vectors of all: at most PROBE rows.
    longest = sized.orderBy(F.desc("__norm"), "vec_id").select("vec_id", "v").limit(PROBE).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in longest}:
        own = [r for r in longest if len(r["v"]) == d]
        by_dim[d] = np.array([r["vec_id"] for r in own]), np.array([r["v"] for r in own], float).reshape(len(own), d)
    probe = spark.sparkContext.broadcast(by_dim)

    @F.pandas_udf("double")
    def floors(ids: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for i, row in zip(ids, rows):
            q = np.array(row, float)[None, :]
            known = probe.value.get(q.shape[1])
            floor = -np.inf
            if known is not None:
                others = known[1][known[0] != i]
                if len(others) >= k:
                    reach = np.linalg.norm(q) * np.linalg.norm(others, axis=1).max()
                    floor = float(np.partition(products(q, others, reach)[0], -k)[-k])
            out.append(floor)
        return pd.Series(out, dtype=float)

    asked = sized.where(is_query).select("dim", F.col("vec_id").alias("query_id"), "v")
    asked = asked.withColumn("floor", floors("query_id", "v"))
    step = F.when(F.col("__norm") > 0, F.floor(F.log2("__norm") * 4)).otherwise(-1).cast("int")
    grouped = sized.withColumn("step", step)
    blocks = grouped.groupBy("dim", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = grouped.join(blocks, ["dim", "step"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    shares = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int")
    cells = blocks.select("dim", "step", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    left = asked.join(shares, "dim").withColumn("share", share).join(cells, "dim")
    left = left.select("dim", "step", "block", "share", "query_id", "v", "floor")
    right = placed.join(shares, "dim").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = right.select("dim", "step", "block", "share", "vec_id", "v")

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            found = _cell(
                queries["q_query_id"].to_numpy(),
                _matrix(queries["q_v"]),
                queries["q_floor"].to_numpy(),
                rows["vec_id"].to_numpy(),
                _matrix(rows["v"]),
                k,
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    key = ["dim", "step", "block", "share"]
    found = left.toDF(*(f"q_{c}" for c in left.columns)).groupBy(*(f"q_{c}" for c in key)).cogroup(right.groupBy(*key)).applyInPandas(
        search, "query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = f"""
WITH usable AS (
  SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {K}
"""
