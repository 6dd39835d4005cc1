"""Centroid clustering in exact integers, with Ptolemaic pivots instead of most distances.

Ptolemy's inequality d(x,c) d(s,t) >= |d(x,s) d(c,t) - d(x,t) d(c,s)| holds
for any four points of a Euclidean space. With fixed pairs (s, t) of pivots
it gives a lower bound of d(x,c) from distances to pivots alone; those of the
vectors never change and are kept beside them, those of the centroids are
taken once a round. A vector's distance to the centroid of the smallest bound
is computed first; a centroid whose bound, rounded down, lies above it cannot
be nearest, all others are checked exactly. Vectors and centroids are
integers, so distances, sums and ties are exact.

A round reads the kept vectors once and returns sums by cluster, added up by
Spark; the driver sees k centroids and no vector but the initial ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare

SCALE = 1024
#: Pivots (the first initial centroids that differ) and pairs of them that are compared.
PIVOTS = 8
PAIRS = 12
#: Components below this in size: squared distances of up to 2 ** 7 components fit 63 bits.
_NARROW = 1 << 27
#: Covers the rounding of three square roots, two products, a difference and a quotient.
_SLACK = 1e-14
#: Sums of clusters are sent in limbs of so many bits.
_LIMB = 32
_ROWS = 4096


def scaled(flat: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x) of finite doubles as an integer matrix; Python integers where 64 bits may not hold squares."""
    big = flat.size and np.abs(flat).max() >= (_NARROW - 1) / SCALE
    if not big:
        return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dims)
    whole = [int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in flat.tolist()]
    return np.array(whole, object).reshape(-1, dims)


def _narrow(x: np.ndarray) -> bool:
    return x.dtype != object or not x.size or max(abs(x.max()), abs(x.min())) < _NARROW


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one point."""
    if x.shape[1] <= 128 and _narrow(x) and _narrow(c):
        d = x.astype(np.int64) - c.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)


def _root(d: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite where a double cannot hold the square."""
    if d.dtype == object:
        d = np.array([float(v) if v < 1 << 1000 else np.inf for v in d.tolist()])
    return np.sqrt(d.astype(np.float64))


def roots(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances (double) of the rows of ``x`` to ``points``."""
    return np.stack([_root(squared(x, p)) for p in points], axis=1) if len(points) else np.zeros((len(x), 0))


class Pivots:
    """Fixed pivots and pairs of them; all pairs differ, so no bound divides by zero."""

    def __init__(self, points: np.ndarray, pairs: int = PAIRS):
        self.points = points
        between = roots(points, points)
        found = [(between[s, t], s, t) for s in range(len(points)) for t in range(s) if between[s, t] > 0]
        self.pairs = sorted(found, reverse=True)[:pairs]

    def bounds(self, of_x: np.ndarray, of_c: np.ndarray) -> np.ndarray:
        """Lower bounds, rounded down, of the distance of every vector to every centroid."""
        best = np.zeros((len(of_x), len(of_c)))
        for apart, s, t in self.pairs:
            with np.errstate(over="ignore", invalid="ignore"):
                a, b = of_x[:, s, None] * of_c[None, :, t], of_x[:, t, None] * of_c[None, :, s]
                bound = (np.abs(a - b) - _SLACK * (a + b)) / apart
            bound[~np.isfinite(bound)] = 0  # what a double cannot hold excludes nothing
            np.maximum(best, bound, out=best)
        return best * (1 - _SLACK)


def nearest(x: np.ndarray, of_x: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), exact squared distance, and how many distances were computed."""
    bounds = pivots.bounds(of_x, roots(centroids, pivots.points))
    cluster = bounds.argmin(axis=1)
    best = np.zeros(len(x), object if not (_narrow(x) and _narrow(centroids) and x.shape[1] <= 128) else np.int64)
    first = cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero(first == c)
        best[rows] = squared(x[rows], centroids[c])
    done = len(x)
    for c in range(len(centroids)):
        reach = _root(best) * (1 + _SLACK)
        rows = np.flatnonzero((bounds[:, c] <= reach) & (first != c))
        d = squared(x[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = c, d[better]
        done += len(rows)
    return cluster, best, done


def _pack(x: np.ndarray) -> list[bytes]:
    """A row of integers as bytes: 32 bits each, or decimal text where they need more."""
    if x.dtype != object:
        return [r.tobytes() for r in x.astype("<i4")]
    return [b"," + ",".join(map(str, r)).encode() for r in x.tolist()]


def _unpack(rows: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 4 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(-1, dims).astype(np.int64)
    return np.array([[int(v) for v in r[1:].split(b",")] if len(r) != 4 * dims else np.frombuffer(r, "<i4").tolist() for r in rows], object)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value) with total = sum of value << (_LIMB * place); the sign is in the last."""
    place = 0
    while not -(1 << 31) <= total < 1 << 31:
        yield place, total & ((1 << _LIMB) - 1)
        total, place = total >> _LIMB, place + 1
    yield place, total


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their integers and distances to pivots."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            x = _unpack(part.column("x").to_pylist(), dims)
            yield part, x, np.frombuffer(b"".join(part.column("p").to_pylist()), "<f8").reshape(len(x), -1)


class Clusters:
    """Vectors with their pivot distances, kept in the checkpoint folder, and the centroids of the last round."""

    def __init__(self, vectors: DataFrame, k: int, dims: int, order: Callable, vec_id: str, embedding: str):
        prepare(vectors.sparkSession)
        e, self.dims = F.col("e"), dims
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
        fine = (F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        rows = rows.where(F.coalesce(fine, F.lit(False)))
        start = rows.orderBy(order(F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), "e").limit(k).collect()
        self.centroids = scaled(np.array([r["e"] for r in start], np.float64).ravel(), dims)
        seen: list[tuple] = []
        for c in map(tuple, self.centroids.tolist()):
            if c not in seen and len(seen) < PIVOTS:
                seen.append(c)
        self.pivots = Pivots(np.array(seen, self.centroids.dtype).reshape(-1, dims))
        pivots = self.pivots

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, _ROWS):
                    part = b.slice(at, _ROWS)
                    x = scaled(part.column(1).flatten().to_numpy(zero_copy_only=False), dims)
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": part.column(0), "x": pa.array(_pack(x), pa.binary()),
                        "p": pa.array([r.tobytes() for r in roots(x, pivots.points).astype("<f8")], pa.binary())})

        self.kept = cut(rows.mapInArrow(keep, "vec_id long, x binary, p binary"))

    def round(self) -> None:
        """Assign all vectors and replace every centroid that has any by the floor of its mean."""
        centroids, pivots, dims = self.centroids, self.pivots, self.dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = [0] * len(centroids), [np.zeros(dims, object) for _ in centroids]
            for _, x, p in _parts(batches, dims):
                cluster = nearest(x, p, centroids, pivots)[0]
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    n[c] += len(own)
                    total[c] += own.sum(axis=0).astype(object)
            rows = [(c, -1, 0, n[c]) for c in range(len(n)) if n[c]]
            rows += [(c, at, place, v) for c in range(len(n)) if n[c] for at, t in enumerate(total[c].tolist()) for place, v in _limbs(t)]
            yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("c", "at", "place", "v"))})

        found = self.kept.mapInArrow(sums, "c long, at long, place long, v long").groupBy("c", "at", "place").agg(F.sum("v").alias("v"))
        n: dict[int, int] = {}
        total: dict[tuple[int, int], int] = {}
        for c, at, place, v in found.collect():  # at most k x (dims + 1) x a few limbs
            if at < 0:
                n[c] = v
            else:
                total[c, at] = total.get((c, at), 0) + (v << (_LIMB * place))
        new = [[total[c, at] // n[c] for at in range(dims)] if c in n else old for c, old in enumerate(self.centroids.tolist())]
        wide = any(abs(v) >= _NARROW for c in new for v in c)
        self.centroids = np.array(new, object if wide else np.int64).reshape(-1, dims)

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance (squared; null if 63 bits do not hold it) of every kept vector."""
        centroids, pivots, dims = self.centroids, self.pivots, self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x, p in _parts(batches, dims):
                cluster, best, _ = nearest(x, p, centroids, pivots)
                fits = [v if v < 1 << 63 else None for v in best.tolist()]
                yield pa.RecordBatch.from_pydict({"vec_id": part.column(0), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(fits, pa.int64())})

        return cut(self.kept.mapInArrow(assign, "vec_id long, cluster int, distance long"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, order: Callable = lambda i: F.sha2(F.concat(F.lit("3:"), i), 256),
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Kept are vectors of ``dims`` components, none null or not finite; others
    give no row. ``order`` maps the decimal id to the string by which the
    first ``k`` are the initial centroids; rows of equal ids are ordered by
    their components, a null id is the empty string and stays null in the
    result. Fewer than ``k`` vectors: that many clusters. Repeated rows count
    and are returned each. Equal initial centroids: the smaller number gets
    the vectors. Squared distances and inertias over 2 ** 63 - 1 are null.
    Other columns are ignored. No rows: none.
    """
    found = Clusters(vectors, k, dims, order, vec_id, embedding)
    for _ in range(rounds if len(found.centroids) else 0):
        found.round()
    rows = found.assigned()
    spark = vectors.sparkSession
    wide, top = F.col("distance").cast("decimal(38,0)"), (1 << 63) - 1
    per = {r["cluster"]: None if r["gaps"] else int(r["sum"]) for r in rows.groupBy("cluster").agg(
        F.sum(wide).alias("sum"), F.count_if(F.col("distance").isNull()).alias("gaps")).collect()}
    whole = None if None in per.values() else sum(per.values())

    def held(v: int | None) -> int | None:
        return v if v is not None and v <= top else None

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    table = spark.createDataFrame([Row(cluster=c, cluster_inertia=held(per.get(c)), inertia=held(whole), centroid_sha256=d) for c, d in enumerate(digest)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
