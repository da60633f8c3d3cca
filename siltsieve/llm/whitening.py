"""Whitening of embeddings by the eigenvectors of a compensated covariance.

Sums are double-double: a number is an unevaluated sum of a high and a low double, and error-free
transformations carry what a rounded sum or product loses into the low part. Vectors are centred
first, then their outer products are split into product and error and folded in pairs. A task gives
the high and low parts of its own sums, a row for each row of the matrix; these are merged by
matrix row, so no task merges more than its rows of all tasks, one after another.

The eigen-solve is LAPACK's: reduction to a tridiagonal matrix, then divide and conquer. Its vectors
are good to the rounding of doubles over the gap between eigenvalues, which may be narrow; one step
of refinement (Ogita and Aishima, 2018) in extended precision, from both parts of the covariance,
takes that loss away. Sums of 64 or so dimensions are small; rows never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from .vectors import lists, matrix, steps

SCALE, SHIFT = 1024, 100_000
#: Scaled entries of this absolute value or more are no whole numbers that a double holds exactly.
LIMIT = float(1 << 52)
CHUNK_ROWS = 512

Parts = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Parts:
    """a + b rounded, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _short_sum(a: np.ndarray, b: np.ndarray) -> Parts:
    """two_sum where a is the larger one."""
    s = a + b
    return s, b - (s - a)


def split(a: np.ndarray) -> Parts:
    """a as two numbers of half its digits."""
    c = 134217729.0 * a  # 2**27 + 1
    high = c - (c - a)
    return high, a - high


def add(a: Parts, b: Parts) -> Parts:
    """The sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = _short_sum(s, e + t)
    return _short_sum(s, e + f)


def fold(high: np.ndarray, low: np.ndarray) -> Parts:
    """The sum of all rows, in pairs."""
    while (n := len(high)) > 1:
        half = n // 2
        h, e = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (h, e) if n == 2 * half else (np.concatenate([h, high[-1:]]), np.concatenate([e, low[-1:]]))
    return high[0], low[0]


def centred(x: np.ndarray, mean: Parts) -> Parts:
    """x less the mean."""
    d, e = two_sum(x, -mean[0])
    return _short_sum(d, e - mean[1])


def outer_sums(d: Parts) -> Parts:
    """The sum of the rows' outer products; the lower triangle stays 0."""
    high, low = d
    h, t = split(high)
    width = high.shape[1]
    out = np.zeros((width, width)), np.zeros((width, width))
    for i in range(width):
        a, ah, at, al = high[:, i : i + 1], h[:, i : i + 1], t[:, i : i + 1], low[:, i : i + 1]
        b, bh, bt, bl = high[:, i:], h[:, i:], t[:, i:], low[:, i:]
        p = a * b
        e = ((ah * bh - p) + ah * bt + at * bh) + at * bt
        out[0][i, i:], out[1][i, i:] = fold(p, e + (a * bl + al * b))
    return out


def _merged(rows: DataFrame, partial, width: int, n_rows: int) -> tuple[int, Parts]:  # noqa: ANN001
    """(number of vectors, n_rows x m sums of both parts) over all tasks. rows: x; partial(chunk) -> the sums of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = matrix(batch.column(0), width)
            for a in range(0, len(x), CHUNK_ROWS):
                own = partial(x[a : a + CHUNK_ROWS])
                total = own if total is None else add(total, own)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_rows, dtype=np.int32)), pa.array(np.full(n_rows, n)), lists(total[0]), lists(total[1])], ["i", "n", "high", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, Parts]] = {}
        for batch in batches:
            for i, n, high, low in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = np.array(high), np.array(low)
                before = found.get(i)
                found[i] = (n, own) if before is None else (before[0] + n, add(before[1], own))
        for i, (n, (high, low)) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n]), lists(high[None]), lists(low[None])], ["i", "n", "high", "low"])

    schema = "i int, n long, high array<double>, low array<double>"
    got = sorted(rows.select("x").mapInArrow(run, schema).repartition("i").mapInArrow(merge, schema).collect(), key=lambda r: r.i)  # n_rows of them
    if not got:
        return 0, (np.zeros((n_rows, width)), np.zeros((n_rows, width)))
    return got[0].n, (np.array([r.high for r in got]), np.array([r.low for r in got]))


def sums(rows: DataFrame, width: int) -> tuple[int, Parts]:
    """(number of vectors, their sum in both parts)."""
    # A row of the "matrix" for each entry, so that merging is spread.
    n, (high, low) = _merged(rows, lambda x: tuple(s[:, None] for s in fold(x, np.zeros_like(x))), width, width)
    return n, (high.reshape(-1)[:width], low.reshape(-1)[:width])


def mean_of(n: int, total: Parts) -> Parts:
    """total / n in both parts."""
    high = total[0] / n
    h, t = split(high)
    k = float(n)
    kh, kt = split(np.float64(k))
    p = high * k
    e = ((h * kh - p) + h * kt + t * kh) + t * kt  # high * n is p + e
    return _short_sum(high, (((total[0] - p) - e) + total[1]) / k)


def covariance(rows: DataFrame, width: int) -> tuple[int, Parts, np.ndarray]:
    """(n, sums, covariance with divisor n in extended precision) of column x: vectors of one width without nulls."""
    n, total = sums(rows, width)
    if not n:
        return 0, total, np.zeros((width, width), np.longdouble)
    mean = mean_of(n, total)
    _, (high, low) = _merged(rows, lambda x: outer_sums(centred(x, mean)), width, width)
    upper = (high.astype(np.longdouble) + low) / n
    return n, total, upper + np.triu(upper, 1).T


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, unit eigenvectors as columns) of a symmetric matrix in extended precision, rounded to doubles."""
    x = np.linalg.eigh(v.astype(np.float64))[1][:, ::-1].astype(np.longdouble)
    r = np.eye(len(v), dtype=np.longdouble) - x.T @ x
    s = x.T @ v @ x
    e = np.diag(s) / (1 - np.diag(r))
    apart = e[None, :] - e[:, None]
    near = np.abs(apart) <= 2 * (np.abs(s - np.diag(e)).sum(axis=1).max() + np.abs(v).sum(axis=1).max() * np.abs(r).sum(axis=1).max())
    x = x + x @ np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, apart))
    e, x = e.astype(np.float64), x.astype(np.float64)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """For each row, the sum of (n * x - total) ** 2, exact. x: whole numbers as doubles."""
    if not len(x):
        return []
    if n * (float(np.abs(x).max()) + 1) + max(map(abs, total)) < 2.0**52:
        y = x.astype(np.int64) * n - np.array(total, np.int64)
        high, low = y >> 24, y & 0xFFFFFF  # squares of up to 28 bits each
        if x.shape[1] <= 64:
            parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
            return [(a << 48) + (b << 25) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
    return [sum((n * int(c) - t) ** 2 for c, t in zip(row, total, strict=True)) for row in x.tolist()]


def whitened(vectors: DataFrame, components: int = 8, scale: int = SCALE, shift: int = SHIFT, width: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every remaining row and each of the first components.

    A row remains if neither its vector nor an entry is null and all entries are finite; an entry c
    becomes x = floor(scale * c) + shift. n: remaining rows, S: their sums. deviation, decimal(38, 0):
    the exact sum of (n * x - S)**2 over entries. whitened: x - S / n on the component (an eigenvector of
    the covariance, by falling eigenvalue e) over sqrt(e). explained: e over all eigenvalues'
    sum. identity_error: the largest entry of whitened's covariance less the identity.

    width: of the vectors that count; by default the most frequent one (of equally frequent ones the
    largest), others are left out. Edge cases: rows of one id and repeated rows count each; a null id
    stays null; fewer entries than components give fewer components; a component without variance has
    whitened 0 and no part in identity_error (with a single row, or equal ones, all have none); an empty
    table gives an empty result; entries of 2**52 / scale or more in absolute value count as not finite,
    since their x is not exact in a double; a deviation of more than 38 digits is null. Further columns
    are left out.
    """
    scratch = Scratch(vectors.sparkSession)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), steps(vector_col, scale, LIMIT).alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0))
    rows = scratch.cut(own.withColumn("x", F.transform("x", lambda c: c + F.lit(float(shift)))))
    if width is None:
        row = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = row.width if row else 1
    rows = rows.where(F.size("x") == width)
    n, total, v = covariance(rows, width)
    e, x = eigen(v)
    components = min(components, width)
    e, trace = np.maximum(e[:components], 0), float(np.trace(v))
    varied = e > width * np.finfo(np.float64).eps * trace
    by = np.where(varied, x[:, :components] / np.sqrt(np.where(varied, e, 1)), 0)
    mean, exact = mean_of(max(n, 1), total), [int(a) + int(b) for a, b in zip(*(t.tolist() for t in total), strict=True)]
    most = 10**38

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(1), width)
            d = centred(own, mean)
            away = [Decimal(a) if a < most else None for a in deviations(own, n, exact)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(away, pa.decimal128(38, 0)), lists(d[0] @ by)], ["vec_id", "deviation", "x"])

    out = scratch.cut(rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation decimal(38,0), x array<double>"))
    scratch.drop(but=out)
    found = covariance(out, components)[2]
    error = float(np.abs(found - np.diag(varied.astype(np.float64)))[np.ix_(varied, varied)].max(initial=0)) if varied.any() else 0.0
    share = F.array(*[F.lit(float(a / trace) if trace else 0.0) for a in e])
    flat = out.select("vec_id", "deviation", F.posexplode("x").alias("i", "whitened"))
    return flat.select(F.col("vec_id").alias(id_col), (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
