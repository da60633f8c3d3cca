"""Clustering and whitening of embeddings against brute force in whole numbers and fractions."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from siltsieve.llm import centroid_clusters as cc
from siltsieve.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, cluster string, i string, n string"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def brute_clusters(rows, k, rounds, width):
    own = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [x for _, x in sorted(own, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in own:
            members[near(x)[1]].append(x)
        c = [tuple(sum(z) // len(members[j]) for z in zip(*members[j])) if j in members else y for j, y in enumerate(c)]
    got = [(i, *near(x)) for i, x in own]
    inertia = defaultdict(int)
    for _, d, j in got:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in got), key=str)


def random_rows(width, n=90):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(0, r.choice([0.02, 0.1, 1.0]), width)).tolist()) for i in range(n)]
    some = rows[3][1]
    return rows + [(n + i, some) for i in range(40)] + [(7, some), (7, rows[7][1]), (None, some), (900, None), (901, some[:-1]), (902, [*some, 1.0]), (903, [None, *some[1:]]), (904, [math.nan, *some[1:]]), (905, [-math.inf, *some[1:]]), (906, [])]


@pytest.mark.parametrize(("k", "rounds", "width"), [(16, 3, 3), (5, 0, 3), (500, 2, 2), (1, 1, 3)])
def test_clusters_equal_brute_force(spark, k, rounds, width):
    rows = random_rows(width)
    got = cc.centroid_clusters(frame(spark, rows), k, rounds, width).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=str) == brute_clusters(rows, k, rounds, width)


def test_clusters_of_nothing(spark):
    got = cc.centroid_clusters(frame(spark, [(1, None), (2, [1.0])]))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_annulus_leaves_out_no_tie():
    r = np.random.default_rng(1)
    for width in (1, 2, 5):
        for _ in range(200):
            c = r.integers(-4, 5, (12, width))
            x = np.concatenate([r.integers(-6, 7, (40, width)), c, (c[:6] + c[6:]) // 2])
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            for start in (np.full(len(x), -1), r.integers(0, 12, len(x))):
                best, least = cc.nearest(x, c, start)
                assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_large_vectors_are_exact():
    r = np.random.default_rng(2)
    c = r.integers(-(1 << 27), 1 << 27, (16, 64))
    x = np.concatenate([c + r.integers(-2, 3, c.shape), -c])
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c)) for v in x]
    best, least = cc.nearest(x, c, np.full(len(x), -1))
    assert list(zip(least.tolist(), best.tolist())) == want


# Whitening


def exact_covariance(x):
    n = len(x)
    mean = [Fraction(sum(c), n) for c in zip(*x)]
    d = [[a - m for a, m in zip(row, mean)] for row in x]
    return mean, d, [[sum(row[i] * row[j] for row in d) / n for j in range(len(mean))] for i in range(len(mean))]


def test_covariance_is_exact_to_double_double(spark):
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 3, (700, 5)) + 10**9)
    x[:, 1] = x[:, 0] + (r.random(700) < 0.01)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(7)
    n, total, v = whitening.covariance(rows, 5)
    mean, _, want = exact_covariance([[int(c) for c in row] for row in x])
    assert n == 700 and [int(a) + int(b) for a, b in zip(*total)] == [int(m * n) for m in mean]
    for i in range(5):
        for j in range(5):
            got = Fraction(float(v[i, j])) + Fraction(float(v[i, j] - np.longdouble(float(v[i, j]))))
            assert abs(got - want[i][j]) <= abs(want[i][j]) * Fraction(1, 10**18) + Fraction(1, 10**18)


def test_eigenvectors_of_narrow_gaps():
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(12, dtype=np.longdouble) - 0.5 * (q.T @ q))
    e = np.longdouble(17000) + np.arange(12, 0, -1).astype(np.longdouble) / 1000
    got, x = whitening.eigen((q * e) @ q.T)
    assert np.abs(got - e.astype(float)).max() < 1e-10
    # The matrix itself is rounded by 1e-19 * 17000, seen through gaps of 0.001; without refinement it would be 4e-9.
    assert np.abs(np.abs((x.T @ q).astype(float)) - np.eye(12)).max() < 1e-11
    got, x = whitening.eigen(np.eye(4, dtype=np.longdouble) * 5)  # any basis will do
    assert (got == 5).all() and np.abs(x.T @ x - np.eye(4)).max() < 1e-15
    assert (whitening.eigen(np.zeros((3, 3), np.longdouble))[0] == 0).all()


def check(got, rows, width, components=8):
    own = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    n, (mean, d, v) = len(own), exact_covariance([x for _, x in own])
    value, vector = np.linalg.eigh(np.array(v, dtype=np.float64))
    value, vector = value[::-1], vector[:, ::-1]
    k = min(width, components)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert sum(map(len, by.values())) == n * k
    share = value[:k] / value.sum()
    signs = {}
    for (i, _), away in zip(own, d):
        want = np.array(away, dtype=np.float64) @ vector[:, :k] / np.sqrt(value[:k])
        deviation = int(sum((n * a) ** 2 for a in away))
        mine = sorted(by[i], key=lambda r: r.component)
        assert {r.deviation for r in mine} >= {deviation} and {r.n for r in mine} == {n}
        for r in mine:
            assert abs(r.explained - share[r.component - 1]) <= 1e-10 and 0 <= r.identity_error <= 1e-10
        if len(mine) == k:
            for r, w in zip(mine, want):
                sign = signs.setdefault(r.component, 1 if r.whitened * w >= 0 else -1) if abs(w) > 1e-3 else signs.get(r.component, 1 if r.whitened * w >= 0 else -1)
                assert abs(sign * r.whitened - w) < 1e-8


def test_whitening_equals_fractions(spark):
    rows = random_rows(3)
    check(whitening.whitened(frame(spark, rows)).collect(), rows, 3)
    check(whitening.whitened(frame(spark, rows), components=2, width=3).collect(), rows, 3, 2)


def test_whitening_of_the_table(spark):
    got = queries.op12_whitening(spark, SF).collect()
    check(got, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], 64)


def test_whitening_edge_cases(spark):
    def of(rows):
        return sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in whitening.whitened(frame(spark, rows)).collect())

    assert of([]) == of([(1, None), (2, []), (3, [math.nan])]) == []
    assert of([(1, [2.0, 3.0])]) == [(1, 1, 1, 0, 0.0, 0.0, 0.0), (1, 2, 1, 0, 0.0, 0.0, 0.0)]
    assert of([(1, [2.0]), (2, [2.0])]) == [(1, 1, 2, 0, 0.0, 0.0, 0.0), (2, 1, 2, 0, 0.0, 0.0, 0.0)]
    one = of([(1, [0.0, 5.0]), (2, [2.0, 5.0]), (3, [7.0])])  # the second entry is constant; the odd width is left out
    assert [abs(r[4]) for r in one] == [1.0, 0.0, 1.0, 0.0] and [r[5] for r in one] == [1.0, 0.0, 1.0, 0.0] and {r[3] for r in one} == {2048**2}
    far = whitening.whitened(frame(spark, [(1, [1e12, 0.0]), (2, [0.0, 0.0])])).first()
    assert far.deviation == (1024 * 10**12) ** 2


def test_deviations_of_any_size():
    for top in (3, 10**6, 2**45):
        x = np.floor(np.random.default_rng(top).random((9, 4)) * top) + 100_000
        total = [int(sum(c)) for c in zip(*x.tolist())]
        assert whitening.deviations(x, 9, total) == [sum((9 * int(c) - t) ** 2 for c, t in zip(row, total)) for row in x.tolist()]
