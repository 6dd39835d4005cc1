"""kNN against numpy brute force, across block layouts (metamorphic)."""

import numpy as np
import pytest

from ragloom.operators import knn


def brute(Q, qids, X, xids, k, exclude_self=False, metric="l2"):
    out = {}
    for i, q in enumerate(Q):
        if metric == "l2":
            d = ((X - q) ** 2).sum(axis=1)
        else:
            nn = (q @ q) * (X * X).sum(axis=1)
            d = -np.where(nn > 0, (X @ q) / np.sqrt(np.where(nn > 0, nn, 1)), 0.0)
        order = sorted((dd, xid) for dd, xid in zip(d, xids) if not (exclude_self and xid == qids[i]))
        out[int(qids[i])] = [int(x) for _, x in order[:k]]
    return out


def frame(spark, ids, M):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, M)],
                                 "id long, vec array<double>")


@pytest.mark.parametrize("qblock,xblock,minx,strategy", [(1000, 1000, 1, "blocks"), (7, 13, 3, "blocks"),
                                                          (3, 50, 8, "blocks"), (0, 0, 0, "broadcast")])
def test_knn_l2_matches_brute_force(spark, qblock, xblock, minx, strategy):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 6)).round(2)
    X[5] = X[7]  # exact duplicate: tie broken by id
    Q = rng.normal(size=(25, 6)).round(2)
    qids, xids = np.arange(1000, 1025), np.arange(120)
    got = knn.knn_join(frame(spark, qids, Q), frame(spark, xids, X), k=5, q_id="id", q_vec="vec",
                       x_id="id", x_vec="vec", q_block_rows=qblock or 1, x_block_rows=xblock or 1,
                       min_x_blocks=minx or None, strategy=strategy)
    res = {}
    for r in got.orderBy("qid", "rank").collect():
        res.setdefault(r["qid"], []).append(r["id"])
    assert res == brute(Q, qids, X, xids, 5)


def test_knn_self_join_excludes_self(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 4))
    ids = np.arange(60)
    df = frame(spark, ids, X)
    for strategy in ("blocks", "broadcast"):
        got = knn.knn_join(df, df, k=3, q_id="id", q_vec="vec", x_id="id", x_vec="vec",
                           exclude_self=True, x_block_rows=16, q_block_rows=16, strategy=strategy)
        res = {}
        for r in got.orderBy("qid", "rank").collect():
            res.setdefault(r["qid"], []).append(r["id"])
        assert res == brute(X, ids, X, ids, 3, exclude_self=True)


def test_knn_cosine_counts(spark):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 4, size=(80, 8)).astype(float)
    X[0] = 0.0  # zero vector: cosine 0
    Q = rng.integers(0, 4, size=(10, 8)).astype(float)
    qids, xids = np.arange(10), np.arange(80)
    got = knn.knn_join(frame(spark, qids, Q), frame(spark, xids, X), k=4, q_id="id", q_vec="vec",
                       x_id="id", x_vec="vec", metric="cosine", x_block_rows=20)
    res = {}
    for r in got.orderBy("qid", "rank").collect():
        res.setdefault(r["qid"], []).append(r["id"])
        assert abs(r["distance"] - (2 - 2 * r["cosine"])) < 1e-12
    assert res == brute(Q, qids, X, xids, 4, metric="cosine")


def _mmr_brute(q, X, k, lam):
    unit = lambda v: v / np.linalg.norm(v)
    qu, Xu = unit(np.asarray(q)), np.array([unit(np.asarray(x)) for x in X])
    chosen, left = [], list(range(len(X)))
    while left and len(chosen) < k:
        best, best_s = None, None
        for i in left:  # candidates in rank order, first maximum wins
            red = max((Xu[i] @ Xu[j] for j in chosen), default=0.0)
            s = round(lam * (Xu[i] @ qu) - (1 - lam) * red, 12)  # equal up to rounding is a tie
            if best_s is None or s > best_s:
                best, best_s = i, s
        chosen.append(best)
        left.remove(best)
    return chosen


def test_mmr_matches_greedy_definition(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for qid in range(5):
        q = rng.normal(size=3)
        X = rng.normal(size=(8, 3))
        X[3] = X[0] * 1.01  # near copy of the best-ranked candidate
        for r, x in enumerate(X, start=1):
            rows.append((qid, r, 100 * qid + r, q.tolist(), x.tolist()))
        expected[qid] = [100 * qid + i + 1 for i in _mmr_brute(q, X, 3, 0.5)]
    df = spark.createDataFrame(rows, "qid long, rank int, id long, q_vec array<double>, x_vec array<double>")
    got = {}
    for r in knn.mmr(df, k=3, lambda_mult=0.5).orderBy("qid", "mmr_rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == expected


def test_few_pairs_are_scored_again(monkeypatch):
    import numpy as np
    from ragloom.operators import knn
    r = np.random.default_rng(3)
    x, q, seen = r.normal(size=(40_000, 8)), r.normal(size=(700, 8)), []
    kept = knn._Best._rescored
    monkeypatch.setattr(knn._Best, "_rescored", lambda self, a, qi, *rest: (seen.append(len(qi)), kept(self, a, qi, *rest)))
    qi, xi, d = knn._cell_topk(np.arange(700), q, np.arange(40_000), x, 10, True)
    # 10 * (1 + 1/2 + ... ) of 20 pieces a question are expected, 200 were scored before
    assert sum(seen) < 700 * 60
    for k in (0, 511, 512, 699):
        full = ((q[k] - x) ** 2).sum(axis=1)
        full[k] = np.inf
        assert xi[qi == k].tolist() == np.lexsort((np.arange(40_000), full))[:10].tolist()
        assert np.allclose(d[qi == k], np.sort(full)[:10])


def test_null_ids_and_uneven_vectors():
    import pyarrow as pa
    import pytest
    from ragloom.operators import knn
    assert knn._arrow_ids(pa.array([3, None], pa.int64())).tolist() == [3, -2 ** 63]
    assert knn._arrow_matrix(pa.array([[1.0], [2.0], [3.0]]).slice(1)).tolist() == [[2.0], [3.0]]
    for bad in ([[1.0], None], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            knn._arrow_matrix(pa.array(bad))
