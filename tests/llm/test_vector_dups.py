import math
from collections import Counter

import numpy as np
import pytest

from ragloom.llm import vector_dups
from tests.llm.helpers import closure, smallest_ids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.9):
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    vs = [np.array(v, np.float32).astype(np.float64) if fine(v) else None for _, v, *_ in rows]

    def linked(i, j):
        a, b = vs[i], vs[j]
        return a is not None and b is not None and len(a) == len(b) and float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    comp = smallest_ids(ids, closure(len(rows), linked))
    return Counter((d, k, c, d == c) for d, k, c in zip(ids, n, comp))


def rows_of(seed, n, dims):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    return [(k, [float(x) for x in centres[k % 12] + r.normal(size=dims) * r.choice([0.05, 0.33, 0.6])], 0) for k in range(n)]


@pytest.mark.parametrize("tile_rows", [16, None])
def test_random_clusters_against_all_pairs(spark, tile_rows):
    rows = rows_of(1, 150, 24)
    got = vector_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile_rows=tile_rows).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)


def test_awkward_vectors(spark):
    v = [0.3, -0.4, 0.5]
    rows = [(1, v, 0), (2, v, 1), (2, v, 1), (None, v, 0), (3, [2 * x for x in v], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0),
            (7, [1.0, None, 2.0], 0), (8, [1.0, float("nan"), 2.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [0.3, -0.4], 0),
            (11, [1e-38, 0.0, 0.0], None), (12, [3e38, 0.0, 0.0], None), (13, [-0.0, 1.0, 0.0], 0), (14, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_links", "2 AS component_id", "3 AS e")
    got = Counter(tuple(r) for r in vector_dups.near_duplicates(df).collect())
    assert got == plain(rows)


def test_quantisation_bound_holds():
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 40)) * r.choice([1e-3, 1, 50], size=(300, 1))
    t = vector_dups.Tile(np.arange(300), np.ones(300, np.int64), v)
    exact = t.unit @ t.unit.T
    coded = vector_dups._products(t.codes, t.codes) * t.scale[:, None] * t.scale[None, :]
    e = t.error
    assert (np.abs(exact - coded) <= e[:, None] + e[None, :] + 3 * e[:, None] * e.max() + 1e-9).all()


def test_wide_vectors_use_strips():
    r = np.random.default_rng(2)
    a = r.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (vector_dups._products(a, a) == a.astype(np.int64) @ a.astype(np.int64).T).all()


def test_empty(spark):
    assert vector_dups.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
