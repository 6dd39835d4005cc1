import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ragloom.llm import pivot_clusters as pc

SCHEMA = "vec_id long, embedding array<float>, label int"


def fine(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, k, rounds, dims):
    """Lloyd rounds in Python integers; every distance is computed."""
    kept = [(i, float_row) for i, v in rows if fine(v, dims) for float_row in [[float(np.float32(x)) for x in v]]]
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], v) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centroids = [v for _, v, _ in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v, _ in kept]
    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v, _), (_, n) in zip(kept, found) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    top = (1 << 63) - 1

    def held(x):
        return x if x <= top else None
    per = Counter()
    for d, n in found:
        per[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    gaps = any(d > top for d, _ in found)
    return Counter((i, n, held(d), held(per[n]) if not any(e > top for e, m in found if m == n) else None,
                    None if gaps else held(sum(per.values())), digest[n]) for (i, _, _), (d, n) in zip(kept, found))


def rows_of(seed, n, dims, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dims))
    return [(k, [float(x) for x in centres[k % 9] + spread * r.normal(size=dims)]) for k in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
    return Counter(map(tuple, pc.cluster(df, **more).collect()))


@pytest.mark.parametrize("k,rounds,dims", [(8, 10, 64), (20, 4, 3), (3, 6, 1)])
def test_against_plain_rounds(spark, k, rounds, dims):
    rows = rows_of(k, 240, dims)
    assert run(spark, rows, k=k, rounds=rounds, dims=dims) == plain(rows, k, rounds, dims)


def test_ties_and_repeated_rows(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.integers(-1, 2, 4)]) for k in range(60)] * 2 + [(7, [0.0] * 4)] * 50
    assert run(spark, rows, dims=4, rounds=5) == plain(rows, 8, 5, 4)


def test_awkward_vectors(spark):
    v = [0.5, -0.25, 3.0]
    rows = [(1, v), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [1.0, math.nan, 2.0]), (6, [math.inf, 0.0, 0.0]), (7, v[:2]), (8, v),
            (None, v), (9, [-0.0, 0.0, 1e-30]), (10, [-1e-30, 0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (11, [9.0, 9.0, -9.0])]
    got = run(spark, rows, dims=3, rounds=3)
    assert got == plain(rows, 8, 3, 3) and sum(got.values()) == 7


def test_components_beyond_64_bits(spark):
    rows = [(k, [float(x) * 10.0 ** (10 * (k % 4)), 3e38 if k % 5 == 0 else -1.0, 2.0]) for k, x in enumerate(range(-9, 9))]
    got = run(spark, rows, dims=3, rounds=3, k=4)
    assert got == plain(rows, 4, 3, 3) and any(r[2] is None for r in got)


def test_clashing_names_and_empty(spark):
    rows = rows_of(2, 30, 3)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 AS e", "2 AS cluster", "3 AS distance", "4 AS x")
    assert Counter(map(tuple, pc.cluster(df, dims=3).collect())) == plain(rows, 8, 10, 3)
    assert pc.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark, [(1, [1.0])]) == Counter()


def test_bounds_hold_and_exclude():
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 16)) * 4
    x = pc.scaled((centres[r.integers(0, 30, 2000)] + 0.2 * r.normal(size=(2000, 16))).ravel(), 16)
    c = pc.scaled(centres.ravel(), 16)
    pivots = pc.Pivots(c[:8])
    of_x = pc.roots(x, pivots.points)
    bounds = pivots.bounds(of_x, pc.roots(c, pivots.points))
    exact = np.stack([pc.squared(x, p) for p in c], axis=1)
    assert (bounds ** 2 <= exact).all()
    cluster, best, done = pc.nearest(x, of_x, c, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert done < exact.size / 4  # most distances are never computed


def test_limbs():
    for v in (0, -1, 5, -(1 << 31), 1 << 31, -(1 << 200) + 12345, (1 << 140) + 7):
        assert sum(x << (32 * p) for p, x in pc._limbs(v)) == v and all(abs(x) < 1 << 33 for _, x in pc._limbs(v))
