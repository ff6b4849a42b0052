"""Approximate nearest neighbours (largest inner product) by collision counting over sorted projections.

Largest inner product becomes least distance by one more coordinate, sqrt(M**2 - |v|**2) for stored vectors and
0 for queries. Each of PROJECTIONS random directions gives one sorted array of projections. A query opens, in
every array, a window around its own projection; a vector in enough windows has collided and is verified with
its exact inner product. Windows grow with the radius (virtual rehashing: no array is built again) until as
many verified vectors as asked for lie within the radius. The last radius covers everything, so a query
always gets all it can.

Vectors are dealt to blocks and queries to chunks; one task holds one chunk and one block, and the best of all
blocks are merged per query.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, stored

PROJECTIONS, SEED = 40, 11
#: Half-width of a window as a share of the radius, and how far under the expected collisions of a vector at
#: the radius (in standard deviations) the threshold lies; then the first radius and the steps between radii.
HALF_WIDTH, SLACK = 0.5, 1.0
FIRST, GROWTH, ROUNDS = 0.75, 1.25, 12
BLOCK, CHUNK = 16_384, 4096
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), dim and sq (squared length) of vectors that take part: not null or empty,
    with finite components only, and not zero."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda x: x != 0)
    out = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    out = out.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    return out.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("sq"))


def _needed(m: int) -> int:
    """Collisions of PROJECTIONS that a vector at the radius reaches but for SLACK standard deviations."""
    from math import erf, sqrt

    p = erf(HALF_WIDTH / sqrt(2))
    return max(1, int(m * p - SLACK * sqrt(m * p * (1 - p))))


def search_block(ids: np.ndarray, x: np.ndarray, sq: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, m: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and scores of the k best of this block that each query finds."""
    dim, need = x.shape[1], _needed(m)
    rng = np.random.default_rng(SEED)
    a = rng.normal(size=(dim + 1, m))
    most = float(np.sqrt(max(sq.max(), (q**2).sum(1).max())))
    scale = most or 1.0
    extra = np.sqrt(np.maximum(most**2 - sq, 0))
    px = (np.c_[x, extra] @ a) / scale
    # queries are brought to length `most`: that changes no order, and puts them on the vectors' sphere
    unit = q / np.sqrt((q**2).sum(1))[:, None]
    pq = unit @ a[:dim]
    order = np.argsort(px, axis=0, kind="stable")
    ranked = np.take_along_axis(px, order, axis=0)
    order = np.ascontiguousarray(order.T)
    radius = FIRST * GROWTH ** np.arange(ROUNDS)
    radius = np.r_[radius[radius < 2], np.inf]
    bounds = np.stack([np.stack([np.searchsorted(ranked[:, j], pq[:, j] - HALF_WIDTH * r, "left") for r in radius], 1) for j in range(m)], 1)
    ends = np.stack([np.stack([np.searchsorted(ranked[:, j], pq[:, j] + HALF_WIDTH * r, "right") for r in radius], 1) for j in range(m)], 1)
    out_q, out_v, out_s = [], [], []
    k = min(k + 1, len(ids))  # the query itself may be among them
    for i in range(len(q)):
        count = np.zeros(len(ids), np.int32)
        seen = np.zeros(len(ids), bool)
        got, score = np.zeros(0, np.int64), np.zeros(0)
        lo0 = hi0 = None
        for t in range(len(radius)):
            lo, hi = bounds[i, :, t], ends[i, :, t]
            if radius[t] == np.inf:
                new = np.flatnonzero(~seen)
            else:
                if lo0 is None:
                    parts = [order[j, lo[j] : hi[j]] for j in range(m)]
                else:
                    parts = [order[j, lo[j] : lo0[j]] for j in range(m)] + [order[j, hi0[j] : hi[j]] for j in range(m)]
                count += np.bincount(np.concatenate(parts), minlength=len(ids)).astype(np.int32)
                new = np.flatnonzero((count >= need) & ~seen)
                lo0, hi0 = lo, hi
            if len(new):
                seen[new] = True
                got, score = np.r_[got, new], np.r_[score, x[new] @ q[i]]
            # within the radius: distance on the sphere of radius `most`, in units of it
            reach = np.sqrt(np.maximum(2 - 2 * score / (scale * np.sqrt((q[i] ** 2).sum())), 0))
            if (reach <= radius[t]).sum() >= k:
                break
        best = np.lexsort((ids[got], -score))[:k]
        out_q.append(np.full(len(best), qids[i]))
        out_v.append(ids[got[best]])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors found with the largest inner product, the query's own row
    left out; ties go to the smaller vec_id.

    vectors and queries: vec_id and embedding. Null, empty, zero and non-finite vectors take no part; vectors
    are compared with those of the same length only. A vec_id that occurs several times counts as the first
    of its vectors. Fewer than k candidates are all returned; no rows give no rows.
    """
    base = stored(usable(vectors).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "sq")).alias("r")).select("vec_id", "r.*"), "vectors")
    asked = queries.select(F.col("vec_id").cast("long").alias("id")).distinct()
    asked = stored(base.join(asked, base["vec_id"] == asked["id"], "left_semi"), "queries")
    n, nq = base.count(), asked.count()
    blocks, chunks = -(-n // BLOCK) or 1, -(-nq // CHUNK) or 1
    # at least a few tasks where there is work for them
    blocks = max(blocks, min(8, -(-n // 2048))) or 1
    deal = lambda col, parts: F.pmod(F.xxhash64("vec_id", F.lit(col)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = base.select("vec_id", "v", "dim", "sq", deal(0, blocks).alias("block")).withColumn("chunk", each(chunks))
    right = asked.select("vec_id", "v", "dim", deal(1, chunks).alias("chunk")).withColumn("block", each(blocks))

    def search(key: tuple, own: pa.Table, ask: pa.Table) -> pa.Table:
        if not own.num_rows or not ask.num_rows:
            return arrow(FOUND).empty_table()
        dim = own.column("dim")[0].as_py()
        x = np.array(own.column("v").combine_chunks().flatten()).reshape(-1, dim)
        q = np.array(ask.column("v").combine_chunks().flatten()).reshape(-1, dim)
        qi, vi, s = search_block(own.column("vec_id").to_numpy(), x, own.column("sq").to_numpy(), ask.column("vec_id").to_numpy(), q, k)
        return pa.table([qi, vi, s], schema=arrow(FOUND))

    keys = ["dim", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND).where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(vectors: DataFrame, by: int) -> DataFrame:
    return vectors.where(F.col("vec_id") % by == 0)


