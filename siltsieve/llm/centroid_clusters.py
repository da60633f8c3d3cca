"""Clusters around centroids by rounds of assignment, with an annulus search for the nearest centroid.

Centroids are sorted by their norms. A vector knows one centroid already (that of the round before, at
first the one whose norm is nearest to its own); its distance is an upper bound u. A nearer or equally
near centroid has a norm within u of the vector's, so two binary searches give the stretch of
centroids to compare with, and these are compared exactly, in whole numbers. Bounds are widened by
more than their rounding, so a centroid on the edge is in.

Vectors are whole numbers, so sums, means and distances are exact and do not depend on how the rows
are dealt out. A round writes the assigned rows into the shared folder and sums them up by cluster,
with one partial sum of each cluster in each task; only centroids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from .vectors import lists, matrix, steps

SCALE = 64
#: Entries whose whole number has this absolute value or more don't fit: squared distances of 64 of them would pass 2**63.
LIMIT = float(1 << 27)
SLICE_ROWS = 4096


def nearest(x: np.ndarray, centroids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; of equally near ones the smallest number. start: a centroid of each row, -1 for none yet."""
    squares = (centroids**2).sum(axis=1)
    order = np.argsort(squares, kind="stable")
    norms = np.sqrt(squares[order].astype(np.float64))
    own = np.sqrt((x**2).sum(axis=1).astype(np.float64))
    right = np.searchsorted(norms, own)
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(norms) - 1)
    by_norm = order[np.where(own - norms[left] <= norms[right] - own, left, right)]
    best = np.where(start >= 0, start, by_norm)
    least = ((x - centroids[best]) ** 2).sum(axis=1)
    reach = np.sqrt(least.astype(np.float64))
    slack = 1e-6 + 1e-9 * (own + reach)
    low, high = np.searchsorted(norms, own - reach - slack, "left"), np.searchsorted(norms, own + reach + slack, "right")
    for j in range(int(low.min(initial=len(norms))), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= j) & (j < high))
        d = ((x[rows] - centroids[order[j]]) ** 2).sum(axis=1)
        better = (d < least[rows]) | ((d == least[rows]) & (order[j] < best[rows]))
        best[rows[better]], least[rows[better]] = order[j], d[better]
    return best, least


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, x, cluster, distance); rows: vec_id, x, cluster."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(a, SLICE_ROWS)
                best, least = nearest(matrix(some.column(1), width).astype(np.int64), centroids, some.column(2).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "x", "cluster", "distance"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, x array<int>, cluster int, distance long")


def _sums(rows: DataFrame, k: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has rows: their number and the sum of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x, cluster = matrix(batch.column(0), width).astype(np.int64), batch.column(1).to_numpy()
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                total[j] += x[cluster == j].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists(total[some])], ["cluster", "n", "total"])

    partial = rows.select("x", "cluster").mapInArrow(run, "cluster int, n long, total array<long>")
    # At most width sums of each cluster; one after another would make long code, so entries are rows for a moment.
    flat = partial.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = flat.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("total"))
    return {r.cluster: (r.n, [t.s for t in r.total]) for r in whole.collect()}  # a row for each centroid


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = SCALE, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row whose vector has width entries, none null or not finite.

    An entry x becomes floor(scale * x). The first centroids are the k vectors of the smallest sha256 of
    seed and id. Each round assigns all vectors and moves every centroid that has any to the floor of
    their mean; then vectors are assigned once more. distance is squared.

    Edge cases: rows of one id are vectors each, those of equal hashes start in the order of their
    entries; rows with a null id start last; with fewer than k vectors there are fewer centroids, and
    equal centroids leave all vectors to the smallest number; an empty table gives an empty result.
    Vectors with an entry of 2**27 / scale or more in absolute value are left out like those that are
    not finite, since their squared distances fit no long. Further columns are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    own = vectors.where(F.size(vector_col) == width).select(F.col(id_col).cast("long").alias("vec_id"), steps(vector_col, scale, LIMIT).alias("x"))
    rows = scratch.cut(own.where("x is not null").select("vec_id", F.transform("x", lambda c: c.cast("int")).alias("x"), F.lit(-1).alias("cluster")))
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, width)
    if not len(centroids):
        return rows.select(F.col("vec_id").alias(id_col), "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        rows = scratch.cut(_assigned(rows, centroids))
        scratch.drop(but=rows)
        for j, (n, total) in _sums(rows, len(centroids), width).items():
            centroids[j] = [s // n for s in total]
    rows = scratch.cut(_assigned(rows, centroids).drop("x"))
    scratch.drop(but=rows)
    found = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    about = [(j, d, sum(found.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in found.items()]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(clusters), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
