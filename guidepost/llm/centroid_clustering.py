"""Centroid clustering with Orchard's search.

Vectors become whole numbers, so distances, sums and floors of means are exact and every
run gives the same clusters. Every centroid has the list of all others, nearest first.
The search of a vector begins at one centroid and walks along its list; when it meets a
centroid that is closer (or as close with a smaller number), it goes on with that one's
list from the beginning. Centroids it has met are marked and not measured again. It
stops where the list is strictly beyond twice the current distance: by the triangle
inequality all that follow are strictly farther, so no tie is lost.

Each round is one pass over the stored whole numbers: a task adds up the vectors of each
centroid and returns one row per centroid; centroids and their lists (``k`` rows) go to
the tasks. No row is moved between tasks.

Rows whose vector is null, has another length, or holds null or non-finite components are
not in the result. Rows that repeat are clustered each; equal hashes are ordered by their
components; rows without an id come last among the starts. With fewer than ``k`` vectors
there are as many centroids as vectors; an empty table gives no rows. Components beyond
``vectors.LIMIT`` count as that; sums beyond a long are given as the largest long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import store
from guidepost.llm.vectors import group_sums, matrix, moved, pairwise, slices, squared, usable, whole
from guidepost.session import scratch_path

LONG = 2**63 - 1


class Orchard:
    """Centroids with, for each, the others from near to far and how far they are."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.c = centroids
        between = pairwise(centroids, centroids)
        np.fill_diagonal(between, -1)  # itself first, then left out
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.far = np.take_along_axis(between, self.order, axis=1)
        self.steps = k - 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, the smaller
        number among equals, and how many distances it took."""
        n = len(x)
        best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        dist = squared(x, self.c[best])
        met = np.zeros((n, len(self.c)), bool)
        met[:, 0] = True
        taken = n
        live = np.arange(n if self.steps else 0)
        while len(live):
            here = best[live], at[live]
            go = self.far[here] <= 4 * dist[live]
            live, ahead = live[go], self.order[here][go]
            new = ~met[live, ahead]
            row, cand = live[new], ahead[new]
            d = squared(x[row], self.c[cand])
            taken += len(row)
            met[row, cand] = True
            closer = (d < dist[row]) | ((d == dist[row]) & (cand < best[row]))
            at[live] += 1
            jump = row[closer]
            best[jump], dist[jump], at[jump] = cand[closer], d[closer], 0
            live = live[at[live] < self.steps]
        return best, dist, taken


def starts(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, in its order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    got = kept.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in got], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``
    and ``centroid_sha256`` of every vector with ``dim`` finite components."""
    spark = vectors.sparkSession
    root = scratch_path(spark, "clusters")
    v = F.col(embedding).cast("array<double>")
    src = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(usable(F.col("v")) & (F.size("v") == dim))
    kept = store(src.select("vec_id", whole(F.col("v"), scale).alias("x")), f"{root}/x")
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))], F.lit("").alias("centroid_sha256"))

    for _ in range(rounds):
        search = Orchard(centroids)

        def nearest(rows, search=search):
            x = matrix(rows.column("x"), dim)
            return search.nearest(x)[0], x

        centroids = moved(centroids, *group_sums(kept.select("x"), len(centroids), dim, nearest))

    search = Orchard(centroids)

    def assign(batches):
        for rows in slices(batches):
            best, dist, _ = search.nearest(matrix(rows.column("x"), dim))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    done = store(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), f"{root}/assigned")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    each = [(c, min(s, LONG), min(sum(sums.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    totals = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
