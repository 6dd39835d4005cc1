"""Nearest-neighbour retrieval.

Exact top-k by squared L2 distance (ties broken by id) between a table of
question vectors and a table of index vectors, with no cross join and
without emitting all pairs:

1. Each side is cut into hash blocks. A question block is replicated to the
   index blocks it must meet, an index block to the question blocks; the
   replication factors are chosen from the measured row counts so every
   (question block, index block) cell holds a bounded number of rows.
2. ``cogroup(...).applyInPandas`` handles one cell: a float64 matrix product
   ranks the pairs (``|q|^2 + |x|^2 - 2 q.x``), candidates within a margin of
   the k-th value are re-scored exactly as ``sum((q - x)^2)``, and only the
   k best per question (id tie-break) leave the task.
3. ``row_number`` over (question) keeps the global k; Catalyst plans it as a
   partial + final ``WindowGroupLimit``, so at most k rows per question and
   block cross the final shuffle.

Work is O(|Q| x |X|) as exact search must be; memory per task is bounded by
the block sizes and the inner chunking, never by a whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L

# memory budget (float64 bytes) of the question / index block of one cogroup cell;
# rows per block follow from the vector width, so wide vectors get fewer rows
Q_BLOCK_BYTES = 32 * 1024 * 1024
X_BLOCK_BYTES = 64 * 1024 * 1024
Q_BLOCK_ROWS = None  # derived from Q_BLOCK_BYTES unless given
X_BLOCK_ROWS = None
# broadcast strategy: question matrix at most this many rows and bytes
BROADCAST_MAX_ROWS = 4096
BROADCAST_MAX_BYTES = 32 * 1024 * 1024
# questions and index rows scored per inner matrix product (bounds task memory)
INNER_QUESTIONS = 512
INNER_CHUNK = 2048
PAIR_SLICE = 1 << 14  # candidate pairs recomputed at a time (bounds the gathered vectors)


# --------------------------------------------------------------- column forms
def squared_l2(a, b) -> Column:
    """P9 (squared): ``sum((a_i - b_i)^2)`` in double, for small joins and oracles."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_distance(a, b, squared: bool = True) -> Column:
    d = squared_l2(a, b)
    return d if squared else F.sqrt(d)


def distance_to_similarity(d) -> Column:
    """P10: ``1 / (1 + d)``."""
    d = F.col(d) if isinstance(d, str) else d
    return F.lit(1.0) / (F.lit(1.0) + d)


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors; 0 when either has zero norm."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
                           F.lit(0.0), lambda acc, v: acc + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


# ------------------------------------------------------------- block kernel
def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _arrow_matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of an Arrow column as a matrix, without an object a row."""
    if len(lists) == 0:
        return np.zeros((0, 0))
    sizes = pc.list_value_length(lists)
    if lists.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("all vectors must have the same length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), sizes[0].as_py())


def _arrow_ids(ids: pa.Array) -> np.ndarray:
    """Ids of an Arrow column; null ids as the smallest integer."""
    return pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy()


def _cell_topk(qids, Q, xids, X, k: int, exclude_self: bool, metric: str = "l2"):
    """Exact k nearest (distance, id) of each question row among the X rows.

    ``metric="cosine"`` returns ``-cos`` as the distance (ascending order is
    cosine descending); with integer-valued vectors it is exact.
    """
    if len(qids) == 0 or len(xids) == 0:
        return [], [], []
    best = _Best(qids, Q, k, exclude_self, metric)
    best.add(xids, X)
    return best.rows()


class _Best:
    """The k nearest index rows of every question row among those added so far.

    What the matrix product puts beyond a question's k-th best so far is not
    looked at again, so few pairs are re-scored after the first rows. Memory:
    one score matrix of INNER_QUESTIONS by INNER_CHUNK, k rows a question.
    """

    def __init__(self, qids, Q, k: int, exclude_self: bool, metric: str):
        self.qids, self.Q, self.k, self.exclude_self, self.metric = qids, Q, k, exclude_self, metric
        self.qn = np.einsum("ij,ij->i", Q, Q)
        self.bound = np.full(len(qids), np.inf)  # distance of the k-th best so far; ties with it go by id
        none = np.zeros(0, np.int64)
        self.held = [(none, none, np.zeros(0)) for _ in range(0, len(qids), INNER_QUESTIONS)]  # question row, id, distance

    def add(self, xids, X) -> None:
        for s in range(0, len(xids), INNER_CHUNK):
            Xc, ids = X[s:s + INNER_CHUNK], xids[s:s + INNER_CHUNK]
            xn = np.einsum("ij,ij->i", Xc, Xc)
            for a in range(0, len(self.qids), INNER_QUESTIONS):
                self._met(a, ids, Xc, xn)

    def rows(self):
        """Question id, id and distance of all that is held."""
        q, x, d = (np.concatenate(c) for c in zip(*self.held))
        return self.qids[q], x, d

    def _met(self, a: int, ids, Xc, xn) -> None:
        part = slice(a, a + INNER_QUESTIONS)
        Q, qn = self.Q[part], self.qn[part]
        margin = 8.0 * np.finfo(np.float64).eps * max(Q.shape[1], 1)
        approx = Q @ Xc.T
        if self.metric == "cosine":
            approx = -_cos(approx, qn[:, None] * xn[None, :])
            slack = np.full(len(Q), margin)
        else:
            approx *= -2.0
            approx += qn[:, None]
            approx += xn[None, :]
            slack = margin * (qn + xn.max())  # rounding grows with the norms
        if self.exclude_self:
            approx[self.qids[part][:, None] == ids[None, :]] = np.inf
        near = approx <= (self.bound[part] + 2 * slack)[:, None]
        many = near.sum(axis=1) > max(self.k, 1)
        if many.any():  # the k-th best of these rows alone is a bound as well
            kk = min(self.k, len(ids))
            kth = np.partition(approx[many], kk - 1, axis=1)[:, kk - 1]
            near[many] &= approx[many] <= (kth + 2 * slack[many])[:, None]
        qi, xj = np.nonzero(near & np.isfinite(approx))
        for p in range(0, len(qi), PAIR_SLICE):
            self._rescored(a, qi[p:p + PAIR_SLICE], xj[p:p + PAIR_SLICE], ids, Xc, xn)

    def _rescored(self, a: int, qi, xj, ids, Xc, xn) -> None:
        """Keep the pairs (qi, xj) by their exact distance, k a question (distance, then id)."""
        q = qi + a
        if self.metric == "cosine":
            d = -_cos(np.einsum("ij,ij->i", self.Q[q], Xc[xj]), self.qn[q] * xn[xj])
        else:
            diff = self.Q[q] - Xc[xj]
            d = np.einsum("ij,ij->i", diff, diff)
        kept = d <= self.bound[q]
        if not kept.any():
            return
        slot = a // INNER_QUESTIONS
        q, x, d = (np.concatenate(c) for c in zip(self.held[slot], (q[kept], ids[xj[kept]], d[kept])))
        order = np.lexsort((x, d, q))
        q, x, d = q[order], x[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.bound[q[last]] = d[last]
        self.held[slot] = (q[place < self.k], x[place < self.k], d[place < self.k])


def _cos(dot, norm_product):
    """dot / sqrt(|q|^2 |x|^2), 0 where a norm is 0 (same operation order as SQL)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        c = dot / np.sqrt(norm_product)
    return np.where(norm_product > 0, c, 0.0)


def _blocks(n: int, rows_per_block: int, min_blocks: int = 1) -> int:
    return max(min_blocks, int(math.ceil(max(n, 1) / rows_per_block)))


def knn_join(questions: DataFrame, index: DataFrame, k: int = L.RETRIEVER_K,
             q_id: str = "qid", q_vec: str = "embedding",
             x_id: str = "chunk_id", x_vec: str = "embedding",
             exclude_self: bool = False, q_block_rows: int | None = Q_BLOCK_ROWS,
             x_block_rows: int | None = X_BLOCK_ROWS, min_x_blocks: int | None = None,
             metric: str = "l2", materialize: bool = True, strategy: str = "auto") -> DataFrame:
    """J1 + W1: (qid, rank, id, distance) with rank 1..k.

    ``metric="l2"``: exact squared L2 distance. ``metric="cosine"``: rank by
    cosine (descending); the output adds ``cosine`` and reports
    ``distance = 2 - 2 cos`` (squared L2 between the unit vectors).
    Ids must be integral (bigint). ``exclude_self`` drops pairs with equal
    ids (self-join of one table).

    ``strategy``: ``"broadcast"`` ships the question matrix (only below
    ``BROADCAST_MAX_ROWS`` rows and ``BROADCAST_MAX_BYTES``, checked on the
    measured row count and vector size) and scores each index partition where
    it lies - no index shuffle; ``"blocks"`` is the blocked cogroup for
    question sets of any size; ``"auto"`` picks by the check.

    ``materialize`` writes the (small, k rows per question) result with a
    reliable ``checkpoint()`` into the session's checkpoint folder, so the
    block products run once however many branches read the hits, and a lost
    executor does not recompute them.
    """
    spark = questions.sparkSession
    q = questions.select(F.col(q_id).cast("long").alias("_id"), F.col(q_vec).alias("_v"))
    x = index.select(F.col(x_id).cast("long").alias("_id"), F.col(x_vec).alias("_v"))
    rows = None
    if strategy in ("auto", "broadcast"):
        # rows and bytes are measured before any vector reaches the driver
        size = q.limit(BROADCAST_MAX_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.size("_v").cast("long") * 8)).first()
        fits = size[0] <= BROADCAST_MAX_ROWS and (size[1] or 0) <= BROADCAST_MAX_BYTES
        rows = q.limit(BROADCAST_MAX_ROWS).collect() if fits else None
        if strategy == "broadcast" and not fits:
            raise ValueError("question matrix exceeds the broadcast bound; use strategy='blocks'")
        strategy = "broadcast" if fits else "blocks"
    if strategy == "broadcast":
        local = _broadcast_scan(spark, rows, x, k, exclude_self, metric)
    else:
        local = _block_cogroup(spark, q, x, q.count(), k, exclude_self, metric, q_block_rows,
                               x_block_rows, min_x_blocks)
    top = top_k(local, k, "qid", "distance", "id")
    if metric == "cosine":
        top = (top.withColumn("cosine", -F.col("distance"))
               .withColumn("distance", F.lit(2.0) - F.lit(2.0) * F.col("cosine")))
    if materialize:
        top = top.checkpoint(eager=True)
    return top


def _broadcast_scan(spark, rows, x: DataFrame, k: int, exclude_self: bool,
                    metric: str) -> DataFrame:
    """Score every index partition against the broadcast question matrix
    (``rows``: the size-checked question rows)."""
    qids = np.array([r["_id"] for r in rows], dtype=np.int64)
    Q = np.stack([np.asarray(r["_v"], dtype=np.float64) for r in rows]) if rows else np.zeros((0, 0))
    bq = spark.sparkContext.broadcast((qids, Q))

    def scan(batches):
        qi, Qm = bq.value
        best = _Best(qi, Qm, k, exclude_self, metric) if len(qi) else None
        seen = False
        for b in batches:
            for s in range(0, b.num_rows if best else 0, INNER_CHUNK):
                part, seen = b.slice(s, INNER_CHUNK), True
                best.add(_arrow_ids(part.column(0)), _arrow_matrix(part.column(1)))
        if seen:
            yield from _hits(best.rows()).to_batches()

    return x.mapInArrow(scan, "qid long, id long, distance double")


def _block_cogroup(spark, q: DataFrame, x: DataFrame, nq: int, k: int, exclude_self: bool,
                   metric: str, q_block_rows: int, x_block_rows: int,
                   min_x_blocks: int | None) -> DataFrame:
    """Blocked cogroup: (question block, index block) cells of bounded size.

    The index is replicated once per question block and the questions once
    per index block, so large question blocks keep the index replication low;
    both block sizes come from a memory budget and the measured vector width.
    """
    nx = x.count()
    dim = int((x.select(F.size("_v").alias("d")).first() or {"d": 1})["d"] or 1)
    q_block_rows = q_block_rows or max(256, Q_BLOCK_BYTES // (8 * dim))
    x_block_rows = x_block_rows or max(1024, X_BLOCK_BYTES // (8 * dim))
    if min_x_blocks is None:
        min_x_blocks = spark.sparkContext.defaultParallelism
    QB = _blocks(nq, q_block_rows)
    XB = _blocks(nx, x_block_rows, min_blocks=min(min_x_blocks, max(nx, 1)))
    # both block keys must have one type on both sides, or cogroup cells do not line up
    q = (q.withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(QB)).cast("long"))
          .withColumn("_xb", F.explode(F.sequence(F.lit(0), F.lit(XB - 1)).cast("array<bigint>"))))
    x = (x.withColumn("_xb", F.pmod(F.xxhash64("_id"), F.lit(XB)).cast("long"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(QB - 1)).cast("array<bigint>"))))

    def cell(qs: pa.Table, xs: pa.Table) -> pa.Table:
        return _hits(_cell_topk(*_ids_and_vectors(qs, "_id", "_v"), *_ids_and_vectors(xs, "_id", "_v"), k, exclude_self, metric))

    return (q.groupBy("_qb", "_xb").cogroup(x.groupBy("_qb", "_xb"))
            .applyInArrow(cell, "qid long, id long, distance double"))


def _hits(found) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "id", "distance"])


def _ids_and_vectors(t: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    return _arrow_ids(_column(t, ids)), _arrow_matrix(_column(t, vectors))


def _column(t: pa.Table, name: str) -> pa.Array:
    found = t[name].combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


HIT_BROADCAST_ROWS = 2_000_000


def join_hits(hits: DataFrame, table: DataFrame, hit_id: str = "id",
              table_id: str = "chunk_id") -> DataFrame:
    """Attach index columns (text, vectors, ...) to hits.

    Hits hold k rows per question; below ``HIT_BROADCAST_ROWS`` (measured) they
    are broadcast and the index streams through a hash join without being
    shuffled; above it both sides shuffle on the id.
    """
    h = F.broadcast(hits) if hits.count() <= HIT_BROADCAST_ROWS else hits
    return h.join(table.withColumnRenamed(table_id, hit_id), hit_id)


def top_k(hits: DataFrame, k: int, part: str = "qid", dist: str = "distance",
          tie: str = "id", rank_col: str = "rank") -> DataFrame:
    """Keep the k smallest ``dist`` per ``part`` with 1-based rank."""
    w = Window.partitionBy(part).orderBy(F.col(dist).asc(), F.col(tie).asc())
    return hits.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def with_relevance(hits: DataFrame, distance: str = "distance") -> DataFrame:
    """Relevance of unit vectors by squared L2 distance: ``1 - d / sqrt(2)`` (1 at equality, below 0 past a right angle)."""
    return hits.withColumn("relevance", F.lit(1.0) - F.col(distance) / F.sqrt(F.lit(2.0)))


def score_threshold(hits: DataFrame, threshold: float = L.SCORE_THRESHOLD,
                    sim_col: str = "relevance") -> DataFrame:
    """keep hits whose relevance score (``with_relevance``) reaches the threshold."""
    return hits.filter(F.col(sim_col) >= threshold)


# ---------------------------------------------------------------------- MMR
def mmr(candidates: DataFrame, k: int = L.RETRIEVER_K, lambda_mult: float = L.MMR_LAMBDA,
        q_vec: str = "q_vec", x_vec: str = "x_vec") -> DataFrame:
    """Maximal marginal relevance over each question's fetch_k candidates.

    ``candidates``: (qid, rank, id, q_vec, x_vec) with at most fetch_k rows per
    question (the output of ``knn_join(..., k=fetch_k)`` joined with vectors),
    so every group is bounded by fetch_k. Relevance and redundancy are cosine
    similarities; ties go to the better (lower) retrieval rank.
    Output: (qid, mmr_rank, id, rank).
    """
    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="mergesort")
        X = _matrix(pdf[x_vec])
        qv = np.asarray(pdf[q_vec].iloc[0], dtype=np.float64)

        def unit(m):
            n = np.linalg.norm(m, axis=-1, keepdims=True)
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        Xu, qu = unit(X), unit(qv)
        rel = Xu @ qu
        sim = Xu @ Xu.T
        chosen: list[int] = []
        left = list(range(len(pdf)))
        while left and len(chosen) < k:
            if chosen:
                red = sim[np.ix_(left, chosen)].max(axis=1)
            else:
                red = np.zeros(len(left))
            # equal up to rounding is a tie
            score = np.round(lambda_mult * rel[left] - (1 - lambda_mult) * red, 12)
            pick = left[int(np.argmax(score))]  # argmax keeps the first (best-ranked) tie
            chosen.append(pick)
            left.remove(pick)
        sel = pdf.iloc[chosen]
        return pd.DataFrame({"qid": sel["qid"].to_numpy(dtype=np.int64),
                             "mmr_rank": np.arange(1, len(sel) + 1, dtype=np.int32),
                             "id": sel["id"].to_numpy(dtype=np.int64),
                             "rank": sel["rank"].to_numpy(dtype=np.int32)})

    return (candidates.select("qid", "rank", "id", q_vec, x_vec)
            .groupBy("qid").applyInPandas(greedy, "qid long, mmr_rank int, id long, rank int"))
