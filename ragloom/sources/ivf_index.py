"""Inverted-file vector index (J1, third strategy): probe a few lists instead of every vector.

Layout under ``root``::

    root/vectors/list=<n>/  vectors by nearest centroid, a folder a list (partition-pruned scans)
    root/lists/             per list: centroid, rows, radius (largest distance of a member)
    root/probes/            how many lists to probe, as calibrated

The centroids are fitted on a bounded sample (``SAMPLE_ROWS`` vectors by hash
of the id); every vector is indexed. A question meets the vectors of its
``probes`` nearest lists, re-scored exactly by the kernel of the full scan, so
what is returned is exact but for neighbours in other lists. How many lists
that takes is measured: the exact neighbours, among all vectors, of
``CALIBRATION_ROWS`` questions must lie in the first lists with a share of
``TARGET_RECALL``. ``exact=True``
goes on: a list whose centroid is so far that, less its radius, no member can
beat the k-th hit found is skipped, all others are searched as well.

With the cosine metric lists and radii are those of the unit vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn

#: Vectors that the centroids are fitted on.
SAMPLE_ROWS = 20_000
#: Lists: about the square root of the rows, within this bound (the centroids are broadcast).
MAX_LISTS = 4096
#: Bytes of the centroid table at most; fewer lists for wider vectors.
CENTROID_BYTES = 64 << 20
#: Vectors of a list that go to one file, estimated from the sample.
FILE_ROWS = 200_000
#: Indexed vectors, by hash of the id, that are asked to find out how many lists to probe; the share of their
#: neighbours (so many each) that the probed lists must hold.
CALIBRATION_ROWS = 200
TARGET_RECALL = 0.97
CALIBRATION_K = 10
#: Rows whose distances to all lists are held at a time.
PIECE_ROWS = 512
#: Pairs of a question (with its vector) and a list that leave a Python worker at a time.
PROBED_ROWS = 4096
#: Covers the rounding of distances where lists are skipped.
_SLACK = 1e-9


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return m
    n = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _distances(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to centroids by a matrix product, and how far rounding may put each off."""
    mn, cn = np.einsum("ij,ij->i", m, m)[:, None], np.einsum("ij,ij->i", centroids, centroids)[None, :]
    d = np.sqrt(np.maximum(0, mn + cn - 2.0 * (m @ centroids.T)))
    margin = 8.0 * np.finfo(np.float64).eps * max(1, m.shape[1]) * (mn + cn)
    return d, margin / np.maximum(np.maximum(d, np.sqrt(margin)), np.finfo(np.float64).tiny)


def _pieces(batches):
    """The batches in pieces of at most PIECE_ROWS rows, so that a piece's distances to all lists stay small."""
    for b in batches:
        for at in range(0, len(b), PIECE_ROWS):
            yield b.iloc[at:at + PIECE_ROWS]


def number_of_lists(rows: int, dims: int) -> int:
    return max(1, min(MAX_LISTS, CENTROID_BYTES // (8 * max(1, dims)), round(math.sqrt(rows))))


def _sampled(vectors: DataFrame, rows: int, size: int, x_id: str, x_vec: str, seed: int) -> DataFrame:
    """``size`` rows (i, v) by hash of the id; about twice as many are ordered."""
    u = F.pmod(F.xxhash64(F.col(x_id), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    share = min(1.0, 2.0 * size / max(1, rows))
    near = vectors.select(u.alias("u"), F.col(x_id).cast("long").alias("i"), F.col(x_vec).cast("array<double>").alias("v")).where(F.col("u") < share)
    return near.orderBy("u", "i", "v").limit(size).select("i", "v")


def fit_centroids(vectors: DataFrame, rows: int, lists: int, x_id: str, x_vec: str, metric: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and how many sampled vectors each has; the sample is SAMPLE_ROWS vectors by hash of the id."""
    sample = _sampled(vectors, rows, SAMPLE_ROWS, x_id, x_vec, seed).repartition(vectors.sparkSession.sparkContext.defaultParallelism)

    def unit(batches):
        for b in _pieces(batches):
            yield pd.DataFrame({"v": list(_unit(knn._matrix(b["v"]), metric))})

    points = sample.select("v").mapInPandas(unit, "v array<double>").select(array_to_vector("v").alias("features")).cache()
    fitted = KMeans(k=lists, seed=seed, maxIter=10).fit(points)
    centroids = np.stack(fitted.clusterCenters())
    sizes = np.zeros(len(centroids), np.int64)
    for r in fitted.transform(points).groupBy("prediction").count().collect():
        sizes[r["prediction"]] = r["count"]
    points.unpersist()
    return centroids, sizes


def build(vectors: DataFrame, root: str, x_id: str = "chunk_id", x_vec: str = "embedding", lists: int | None = None,
          metric: str = "l2", seed: int = 7) -> None:
    """Write the index of all rows that have a vector; ids must be integral.

    All vectors must be of one length. Rows of one list go to as many files
    as its share of the sample asks for, so a list that holds a third of all
    rows is many tasks and many files. Repeated rows stay.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.size(F.col(x_vec)) > 0)
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(x_vec)).alias("d")).first()
    rows, dims = seen["n"], seen["d"] or 1
    empty = spark.createDataFrame([], "id long, vec array<double>, list int")
    if not rows:
        empty.write.partitionBy("list").parquet(f"{root}/vectors")
        spark.createDataFrame([], "list int, centroid array<double>, rows long, radius double").write.parquet(f"{root}/lists")
        spark.createDataFrame([(1,)], "probes int").write.parquet(f"{root}/probes")
        return
    lists = lists or number_of_lists(rows, dims)
    centroids, sizes = fit_centroids(vectors, rows, lists, x_id, x_vec, metric, seed)
    files = np.maximum(1, np.ceil(sizes / max(1, sizes.sum()) * rows / FILE_ROWS)).astype(int)
    shared = spark.sparkContext.broadcast((centroids, files))

    def assign(batches):
        c, parts = shared.value
        for b in _pieces(batches):
            if len(b):
                d, off = _distances(_unit(knn._matrix(b["vec"]), metric), c)
                at = d.argmin(axis=1)
                away = np.take_along_axis(d + off, at[:, None], axis=1).ravel()  # no member is farther
                yield b.assign(list=at.astype(np.int32), part=(b["h"].to_numpy() % parts[at]).astype(np.int32), away=away)

    dealt = vectors.select(F.col(x_id).cast("long").alias("id"), F.col(x_vec).cast("array<double>").alias("vec"),
                           F.pmod(F.xxhash64(x_id), F.lit(1 << 30)).alias("h"))
    dealt = dealt.mapInPandas(assign, "id long, vec array<double>, h long, list int, part int, away double").drop("h")
    dealt.repartition("list", "part").write.partitionBy("list").parquet(f"{root}/vectors")
    found = spark.read.parquet(f"{root}/vectors").groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"))
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>")
    table.join(found, "list").coalesce(1).write.parquet(f"{root}/lists")
    index = IvfIndex(spark, root, metric)
    index.calibrate(_sampled(vectors, rows, CALIBRATION_ROWS, x_id, x_vec, seed + 1).dropDuplicates(["i"]).withColumnsRenamed({"i": "qid", "v": "vec"}))


class IvfIndex:
    """A written index; the driver holds its bounded table of lists."""

    def __init__(self, spark: SparkSession, root: str, metric: str = "l2"):
        self.spark, self.root, self.metric = spark, root, metric
        table = sorted(spark.read.parquet(f"{root}/lists").collect(), key=lambda r: r["list"])
        self.lists = np.array([r["list"] for r in table], np.int64)
        self.centroids = np.array([r["centroid"] for r in table], np.float64)
        self.radius = np.array([r["radius"] for r in table], np.float64)
        self.rows = np.array([r["rows"] for r in table], np.int64)
        self._calibrated: int | None = None

    @property
    def probes(self) -> int:
        """How many lists to probe, as calibrated when the index was built."""
        if self._calibrated is None:
            self._calibrated = self.spark.read.parquet(f"{self.root}/probes").first()["probes"]
        return self._calibrated

    def calibrate(self, questions: DataFrame, k: int = CALIBRATION_K, recall: float = TARGET_RECALL) -> int:
        """Set ``probes`` so that the first lists hold ``recall`` of the exact neighbours, among all vectors, of ``questions`` (qid, vec).

        One scan of all vectors with a bounded set of questions; of an indexed
        vector its own row is left out.
        """
        questions = questions.checkpoint(eager=True)
        hits = knn.knn_join(questions, self.vectors(), k=k, q_vec="vec", x_id="id", x_vec="vec", metric=self.metric, exclude_self=True)
        places = self._probes(questions, len(self.lists), place=True)
        owner = knn.join_hits(hits.select("qid", "id"), self.vectors().select(F.col("id").alias("chunk_id"), F.col("list").cast("long").alias("list")))
        needed = owner.join(places, ["qid", "list"]).groupBy("place").count().orderBy("place").collect()  # a row a list at most
        total, seen, found = sum(r["count"] for r in needed), 0, 1
        for r in needed:
            if total and seen >= recall * total:
                break
            seen, found = seen + r["count"], r["place"] + 1
        self._calibrated = found
        self.spark.createDataFrame([(found,)], "probes int").write.mode("overwrite").parquet(f"{self.root}/probes")
        return found

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        """Rows of the index; of the given lists only, whose folders alone are then read."""
        found = self.spark.read.schema("id long, vec array<double>, list int").parquet(f"{self.root}/vectors")
        return found if lists is None else found.where(F.col("list").isin(lists))

    def _probes(self, questions: DataFrame, probes: int, place: bool = False) -> DataFrame:
        """qid, vec, list for the nearest lists of every question; ``place``: instead of the vector the list's place among them, from 0."""
        shared, metric = self.spark.sparkContext.broadcast((self.centroids, self.lists)), self.metric

        def near(batches):
            c, names = shared.value
            for b in _pieces(batches):
                at = np.argsort(_distances(_unit(knn._matrix(b["vec"]), metric), c)[0], axis=1, kind="stable")[:, :probes]
                n = at.shape[1]
                few = max(1, PROBED_ROWS // max(1, n))
                for s in range(0, len(b), few):
                    some, lists = b.iloc[s:s + few], names[at[s:s + few]].ravel()
                    if place:
                        yield pd.DataFrame({"qid": some["qid"].to_numpy().repeat(n), "list": lists, "place": np.tile(np.arange(n), len(some))})
                    else:
                        yield some.loc[some.index.repeat(n)].assign(list=lists)

        return questions.select("qid", "vec").mapInPandas(near, "qid long, list long, place int" if place else "qid long, vec array<double>, list long")

    def _others(self, probed: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        """qid, vec, list for lists not probed that may hold a neighbour nearer than, or as near as, the k-th hit."""
        reach = hits.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("kth"))
        asked = probed.groupBy("qid").agg(F.first("vec").alias("vec"), F.collect_set("list").alias("seen")).join(reach, "qid", "left")
        shared, metric = self.spark.sparkContext.broadcast((self.centroids, self.lists, self.radius)), self.metric

        def reachable(batches):
            c, names, radius = shared.value
            for b in _pieces(batches):
                if len(b):
                    d, off = _distances(_unit(knn._matrix(b["vec"]), metric), c)
                    # fewer than k hits: every list may hold one
                    limit = np.sqrt(np.maximum(b["kth"].astype(float).fillna(np.inf).to_numpy(), 0))[:, None]
                    may = (d - off - radius[None, :]) * (1 - _SLACK) - _SLACK <= limit
                    may &= ~np.stack([np.isin(names, s) for s in b["seen"]])
                    i, j = np.nonzero(may)
                    for s in range(0, len(i), PROBED_ROWS):  # a row holds a vector
                        yield b.iloc[i[s:s + PROBED_ROWS]][["qid", "vec"]].assign(list=names[j[s:s + PROBED_ROWS]])

        return asked.mapInPandas(reachable, "qid long, vec array<double>, list long")

    def _scored(self, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """qid, id, distance: the k best of every (question, list), whose vectors alone are read.

        Questions within the bounds of the full scan are broadcast and the
        lists scored where they lie; beyond, both sides are dealt by (list,
        part), the parts of a list following its rows.
        """
        names = sorted(r[0] for r in asked.select("list").distinct().collect())  # at most MAX_LISTS numbers
        vectors, metric = self.vectors(names), self.metric
        size = asked.limit(knn.BROADCAST_MAX_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.size("vec").cast("long") * 8)).first()
        schema = "qid long, id long, distance double"
        if size[0] <= knn.BROADCAST_MAX_ROWS and (size[1] or 0) <= knn.BROADCAST_MAX_BYTES:
            by_list: dict[int, tuple[list, list]] = {}
            for r in asked.collect():
                ids, vecs = by_list.setdefault(r["list"], ([], []))
                ids.append(r["qid"])
                vecs.append(r["vec"])
            shared = self.spark.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(v, np.float64)) for n, (i, v) in by_list.items()})

            def scan(batches):
                best: dict[int, knn._Best] = {}
                for b in batches:
                    for s in range(0, b.num_rows, knn.INNER_CHUNK):
                        part = b.slice(s, knn.INNER_CHUNK)
                        ids, vecs, lists = knn._arrow_ids(part.column(0)), knn._arrow_matrix(part.column(1)), part.column(2).to_numpy()
                        for n in np.unique(lists).tolist():
                            if n not in best:
                                best[n] = knn._Best(*shared.value[n], k, exclude_self, metric)
                            best[n].add(ids[lists == n], vecs[lists == n])
                for found in best.values():
                    yield from knn._hits(found.rows()).to_batches()

            return vectors.mapInArrow(scan, schema)
        parts = np.maximum(1, -(-self.rows // FILE_ROWS))
        table = self.spark.createDataFrame([(int(n), int(p)) for n, p in zip(self.lists, parts)], "list long, parts long")
        spread = F.broadcast(table)  # at most MAX_LISTS rows
        left = asked.join(spread, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = vectors.withColumn("list", F.col("list").cast("long")).join(spread, "list").withColumn(
            "part", F.pmod(F.xxhash64("id"), F.col("parts")))

        def cell(q: pa.Table, x: pa.Table) -> pa.Table:
            return knn._hits(knn._cell_topk(*knn._ids_and_vectors(q, "qid", "vec"), *knn._ids_and_vectors(x, "id", "vec"), k, exclude_self, metric))

        return (left.select("qid", "vec", "list", "part").groupBy("list", "part")
                .cogroup(right.select("id", "vec", "list", "part").groupBy("list", "part")).applyInArrow(cell, schema))

    def _top(self, scored: DataFrame, k: int) -> DataFrame:
        """k best hits; ``distance`` is squared L2 (of the unit vectors for the cosine metric)."""
        top = knn.top_k(scored, k)
        if self.metric == "cosine":
            top = top.withColumn("cosine", -F.col("distance")).withColumn("distance", F.lit(2.0) - F.lit(2.0) * F.col("cosine"))
        return top.checkpoint(eager=True)

    def search(self, questions: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, q_id: str = "qid", q_vec: str = "embedding",
               exclude_self: bool = False) -> DataFrame:
        """qid, rank, id, distance (and cosine) of the nearest vectors, ties by id, as ``knn.knn_join`` returns them.

        Question ids must be integral and differ. Questions without a vector
        have no hits. ``probes``: as calibrated unless given. ``exact``: the
        same rows as the full scan.
        """
        asked = questions.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).cast("array<double>").alias("vec")).where(F.size("vec") > 0)
        if not len(self.lists):
            return self._top(self.spark.createDataFrame([], "qid long, id long, distance double"), k)
        probed = self._probes(asked, probes or self.probes).checkpoint(eager=True)
        hits = self._top(self._scored(probed, k, exclude_self), k)
        if not exact:
            return hits
        others = self._others(probed, hits, k).checkpoint(eager=True)
        scored = self._scored(others, k, exclude_self)
        before = hits.select("qid", "id", (-F.col("cosine") if self.metric == "cosine" else F.col("distance")).alias("distance"))
        return self._top(before.unionByName(scored), k)

    def work(self, questions: DataFrame, probes: int | None = None, q_id: str = "qid", q_vec: str = "embedding") -> DataFrame:
        """qid, lists, rows: how many lists and vectors the probes of every question meet."""
        asked = questions.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).cast("array<double>").alias("vec")).where(F.size("vec") > 0)
        table = self.spark.createDataFrame([(int(n), int(r)) for n, r in zip(self.lists, self.rows)], "list long, rows long")
        return self._probes(asked, probes or self.probes).join(F.broadcast(table), "list").groupBy("qid").agg(
            F.count(F.lit(1)).alias("lists"), F.sum("rows").alias("rows"))
