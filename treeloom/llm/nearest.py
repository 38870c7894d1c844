"""Approximate nearest neighbours by collision counting over sorted projections.

Vectors are scaled by the largest norm and given one more component, so that the largest inner product is
the least distance. A block of vectors is indexed once by the sorted arrays of some orthogonal random
projections. Around a query's own projection a window grows in every array at once (a larger radius takes the
former windows in: virtual rehashing), and a vector collides once for each array whose window holds it, which
its rank there tells. Vectors that collide in enough arrays are verified by their inner product. The radius
grows until the neighbours verified are nearer than the distance at which a vector can be expected to collide
about that often; the last step is halved a few times, so that no window grows much farther than it must.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import cut, prepare

#: Projections, share of them that must collide, first half-width of the windows, its growth, how often the last
#: step is halved, and half-width in units of the distance from which on collisions are due.
PROJECTIONS, COLLISIONS, RADIUS, GROWTH, HALVED, SURE = 128, 0.8, 0.8, 1.25, 3, 1.34
#: Vectors of a block (ranks have 16 bits), and queries that meet it at once.
BLOCK, QUERIES = 8192, 256
RESULT = "query_id long, vec_id long, score double, verified long"


def projections(d: int, m: int = PROJECTIONS) -> np.ndarray:
    """d x m, fixed for each d: columns orthogonal in groups of d, of length sqrt(d)."""
    rng = np.random.default_rng(d)
    return np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-m // d))], 1)[:, :m] * math.sqrt(d)


class Index:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        n, d = vectors.shape
        if n > 1 << 16:
            raise ValueError(f"{n} vectors in a block")
        self.ids, self.vectors, self.largest, self.a = ids, vectors, largest, projections(d + 1)
        unit = vectors / largest
        p = (np.c_[unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(1)))] @ self.a).T
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        self.rank = np.empty(p.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.uint16)[None, :], 1)
        self.least = math.ceil(COLLISIONS * len(p))

    def _collided(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the vectors whose ranks lie from lo to hi in enough arrays."""
        rank, some = self.rank, hi > lo
        if not some.all():  # an empty window holds no rank
            lo, hi, rank = lo[some], hi[some], rank[some]
        held = (rank - lo.astype(np.uint16)[:, None]) <= (hi - lo - 1).astype(np.uint16)[:, None]
        return np.flatnonzero(np.add.reduce(held.view(np.uint8), axis=0, dtype=np.uint8) >= self.least)

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int):
        """Yields for each query (its place, places and scores of the k nearest vectors found whose id isn't its
        own, how many were verified)."""
        norms = np.linalg.norm(queries, axis=1)
        h = np.c_[queries / norms[:, None], np.zeros(len(queries))] @ self.a
        # For each query: the largest radius that was too small, the least that was enough, the one to try, and
        # how often the step between the former two is still to be halved.
        low, high, radius = np.zeros(len(queries)), np.full(len(queries), np.inf), np.full(len(queries), RADIUS)
        left, best, active = np.full(len(queries), HALVED), [None] * len(queries), np.arange(len(queries))
        while len(active):
            lo = np.array([s.searchsorted(x) for s, x in zip(self.sorted, (h[active] - radius[active, None]).T, strict=True)])
            hi = np.array([s.searchsorted(x, side="right") for s, x in zip(self.sorted, (h[active] + radius[active, None]).T, strict=True)])
            on = []
            for j, a in enumerate(active.tolist()):
                found = self._collided(lo[:, j], hi[:, j])
                enough = len(found) == len(self.ids)
                found = found[self.ids[found] != own[a]]
                scores = self.vectors[found] @ queries[a]
                if not enough and len(found) >= k:
                    worst = np.partition(scores, len(scores) - k)[len(scores) - k] / (self.largest * norms[a])
                    enough = math.sqrt(max(0.0, 2 - 2 * worst)) * SURE <= radius[a]
                if enough:
                    high[a], best[a] = radius[a], (found, scores)
                else:
                    low[a] = radius[a]
                if best[a] is None:
                    radius[a] *= GROWTH
                    on.append(a)
                elif low[a] and left[a]:
                    left[a] -= 1
                    radius[a] = math.sqrt(low[a] * high[a])
                    on.append(a)
                else:
                    found, scores = best[a]
                    at = top(self.ids[found], scores, k)
                    yield a, found[at], scores[at], len(found)
            active = np.array(on, np.int64)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and v, as doubles, of the vectors that take part."""
    v = F.transform(vectors[column], lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(fine, F.lit(False)))


def found_in_blocks(vectors: DataFrame, queries: DataFrame, *, column: str = "embedding", k: int = 20, block: int = BLOCK) -> DataFrame:
    """RESULT: for each query and block of vectors the k nearest found, and how many vectors were verified."""
    prepare(vectors.sparkSession)
    all_rows = cut(usable(vectors, column).select("vec_id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("r")), "vectors")
    # A query id that repeats is asked once, with the least of its vectors.
    asked = usable(queries, column).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, largest = all_rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    blocks, largest = max(1, -(-n // (block - block // 16))), largest or 1.0  # blocks are filled by a hash, not evenly
    rows = all_rows.select(F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int").alias("b"), "d", F.lit(0).alias("kind"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = asked.select(every.alias("b"), F.size("v").alias("d"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = rows.union(asks).repartition("b").sortWithinPartitions("b", "d", "kind", "vec_id", "v")

    def run(batches):
        last, ids, held, index, asked_ids, asked_v = None, [], [], [], [], []

        def answers():
            for i in index if asked_ids else ():
                for a, at, scores, verified in i.nearest(np.array(asked_ids), np.stack(asked_v), k):
                    yield pd.DataFrame({"query_id": asked_ids[a], "vec_id": i.ids[at], "score": scores, "verified": verified})

        for b in batches:
            out = []
            for place, kind, vec_id, v in zip(zip(b["b"], b["d"], strict=True), b["kind"], b["vec_id"], b["v"], strict=True):
                if place != last or len(asked_ids) == QUERIES:
                    out += answers()
                    asked_ids, asked_v = [], []
                if place != last:
                    last, ids, held, index = place, [], [], []
                if kind == 0:
                    ids.append(vec_id)
                    held.append(v)
                    continue
                if ids and not index:  # more than one only where the hash filled a block far too much
                    parts = -(-len(ids) // (1 << 16))
                    index = [Index(np.array(ids[i::parts]), np.stack(held[i::parts]), largest) for i in range(parts)]
                    held = []
                if index:
                    asked_ids.append(vec_id)
                    asked_v.append(v)
            if out:
                yield pd.concat(out)
        if out := list(answers()):
            yield pd.concat(out)

    return dealt.mapInPandas(run, RESULT)


def search(vectors: DataFrame, queries: DataFrame, *, column: str = "embedding", k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (vec_id and column, like vectors) the k nearest rows
    of vectors found, without those of its own id, by the inner product in double precision.

    The vectors are indexed in blocks of fixed size, each once; every query is asked of every block, as it
    streams by, and its k rows of each block are ranked. Vectors that are null, zero or not finite take no
    part. Vectors are compared with those of equal length alone. Rows that repeat a vec_id are candidates
    each; a query id that repeats is asked once, with the least of its vectors. Ties go to the smaller vec_id.
    An empty table gives an empty result; other columns are ignored.
    """
    found = found_in_blocks(vectors, queries, column=column, k=k, block=block)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
