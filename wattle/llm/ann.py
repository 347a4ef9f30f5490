"""Approximate nearest neighbours by collision counting: every projection is
one sorted array; a window centred on the query widens by virtual rehashing,
and vectors that collide with the query in enough projections are verified.

A vector at distance r differs from the query by a normal variable of standard
deviation r in every projection, so the share of projections in which it lies
within WIDTH * r is known. The threshold is that share less a slack: what is
nearer passes nearly always, what is farther the less often the farther it is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.llm.textkit import ship_package

# Projections (counts fit a byte), and the half-width of a window as a multiple
# of the radius that a round looks at.
PROJECTIONS, WIDTH = 240, 1.2
# A vector at the radius collides with the query in a known share of the
# projections; the threshold lies so many standard deviations below it.
SLACK = 2.0
# The first radius is the nearest of a sample of the shard's vectors; each
# rehashing widens it, by more and more.
SAMPLE_ROWS, RATIO = 512, 1.06
# Vectors of a shard, and queries of a block: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 25_000, 4_096
# Vectors that are verified in one go.
PIECE_ROWS = 512


def directions(dims: int, count: int = PROJECTIONS) -> np.ndarray:
    """Gaussian directions, the same in every task."""
    return np.random.default_rng(20_240_229).standard_normal((dims, count))


class Shard:
    """Sorted projections of the vectors of one shard.

    Largest inner product becomes least distance by one more coordinate:
    vectors are divided by the largest norm of all and filled up to length
    one; the query is normalised and has 0 there. Equal vectors are projected,
    counted and verified once, with all their ids.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, count: int = PROJECTIONS):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)  # no negative zeros
        rows = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1])))[:, 0]
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        # Distinct vectors stand in the order of their least ids.
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        group, self.vectors = rank[group], vectors[np.sort(first)]
        self.ids = self.ids[np.argsort(group, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(group))])
        unit = self.vectors / most
        fill = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", unit, unit)))
        self.way = directions(vectors.shape[1] + 1, count)
        points = unit @ self.way[:-1] + np.outer(fill, self.way[-1])
        order = np.argsort(points, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(points.T, order, axis=1)
        # The sorted arrays the other way round: each vector's place in each.
        kind = np.uint16 if len(points) < 1 << 16 else np.uint32
        self.places = np.empty(order.shape, dtype=kind)
        np.put_along_axis(self.places, order, np.arange(len(points), dtype=kind)[None, :], axis=1)
        self.most = most
        share = math.erf(WIDTH / math.sqrt(2))
        self.need = max(1, math.ceil(share * count - SLACK * math.sqrt(count * share * (1 - share))))
        some = np.random.default_rng(7).permutation(len(points))[:SAMPLE_ROWS]
        self.sample = self.vectors[some]
        self.verified = 0  # vectors verified so far, over all searches

    def collisions(self, centre: np.ndarray, half: float) -> np.ndarray:
        """In how many sorted arrays each vector lies in the query's window. A
        window is a run of places, so one comparison a vector tells."""
        n, count = len(self.vectors), len(self.sorted)
        counts = np.zeros(n, dtype=np.uint8 if count < 256 else np.uint16)
        past, inside = np.empty(n, dtype=self.places.dtype), np.empty(n, dtype=bool)
        for row, places, c in zip(self.sorted, self.places, centre, strict=True):
            low, high = row.searchsorted(c - half), row.searchsorted(c + half, side="right")
            np.subtract(places, places.dtype.type(low), out=past)  # places below wrap around
            np.less(past, places.dtype.type(high - low), out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts

    def distance(self, product: float, length: float) -> float:
        """Distance in the space of the projections."""
        return math.sqrt(max(0.0, 2 - 2 * product / (length * self.most)))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest found, ties to smaller ids."""
        length = float(np.sqrt(query @ query))
        centre = (query / length) @ self.way[:-1]
        # The query itself may be in the sample, so the second nearest counts.
        near = np.sort(self.sample @ query)[::-1]
        radius, ratio = max(1e-3, self.distance(near[min(1, len(near) - 1)], length)), RATIO
        seen = np.zeros(len(self.vectors), dtype=bool)
        best_i, best_s = np.empty(0, dtype=np.int64), np.empty(0)
        while True:
            hits = self.collisions(centre, WIDTH * radius) >= self.need
            fresh = np.flatnonzero(hits & ~seen)
            seen |= hits
            if len(fresh):
                self.verified += len(fresh)
                best_i = np.concatenate([best_i, fresh])
                # In pieces that stay in the cache.
                best_s = np.concatenate([best_s, *[self.vectors[fresh[i:i + PIECE_ROWS]] @ query
                                                   for i in range(0, len(fresh), PIECE_ROWS)]])
                # One more than k, as the query's own id doesn't count; least ids
                # are in the order of positions, so positions break ties.
                if len(best_s) > k:
                    kept = best_s >= np.partition(best_s, -k - 1)[-k - 1]
                    best_i, best_s = best_i[kept], best_s[kept]
                top = np.lexsort((best_i, -best_s))[:k + 1]
                best_i, best_s = best_i[top], best_s[top]
            ids, scores = self.expand(best_i, best_s, own, k)
            # Nearer ones than the radius have all had their chance.
            if (len(ids) >= k and self.distance(scores[-1], length) <= radius) or seen.all():
                return ids, scores
            radius, ratio = radius * ratio, ratio * ratio

    def expand(self, places: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids of distinct vectors with their scores, ``own`` left out."""
        parts = [self.ids[self.bounds[i]:min(self.bounds[i + 1], self.bounds[i] + k + 1)] for i in places]
        ids = np.concatenate([np.empty(0, dtype=self.ids.dtype), *parts])
        scores = np.repeat(scores, [len(p) for p in parts])
        other = ids != own
        ids, scores = ids[other], scores[other]
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, without nulls, zero vectors and
    vectors with a null or non-finite component or no id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine
                   & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of the k nearest found
    of every vector whose id is divisible by ``every``, itself left out.

    Vectors are dealt to shards and queries to blocks by a hash of the id; a
    task holds one shard and one block, and what it finds (k rows a query) is
    merged by a ranking of each query. Vectors that are null, zero or hold
    null or non-finite components take no part; those of another dimension
    than a query's are no candidates of it. Rows that repeat an id count
    once; an empty table has no result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn(
        "dims", F.size("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n, most = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-n // (every * block_rows)))

    def each(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    queries = rows.where(F.col("vec_id") % every == 0)
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "embedding", "dims",
                       each(blocks).alias("block"))
    right = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("block"), "vec_id",
                           "embedding", "dims",
                           each(shards).alias("shard"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            shard = Shard(a["vec_id"].to_numpy(), np.stack(a["embedding"].to_numpy()), most)
            for own, q in zip(b["vec_id"], b["embedding"], strict=True):
                ids, scores = shard.search(np.asarray(q), own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["shard", "block", "dims"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("less"), "vec_id", "score"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("i", "t")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
