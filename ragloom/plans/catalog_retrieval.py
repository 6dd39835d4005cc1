"""Registered queries over the inverted-file index (J1, third strategy)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import rnd
from ..operators import knn as knn_ops
from ..session import scratch_path
from . import sqlgen as S
from .catalog import KNN_K, _benchmark_hits, _corpus_index, register, table
from ..operators import embed as embed_ops
from ..sources import ivf_index

#: Questions of the vector table: every row whose id is divisible by this, against all rows.
EVERY = 100


def _vector_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ivf_index.IvfIndex]:
    """All vectors, the questions among them, and the index of all vectors."""
    emb = table(spark, sf_dir, "embeddings")
    root = scratch_path(spark, f"ivf-{uuid.uuid4().hex}")
    ivf_index.build(emb, root, "vec_id", "embedding")
    asked = emb.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return emb, asked, ivf_index.IvfIndex(spark, root)


@register("ivf_exact_top10", oracle=f"""
WITH pairs AS (
  SELECT q.vec_id AS qid, x.vec_id AS neighbour_id, {S.sqdist('q.embedding', 'x.embedding')} AS d
  FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, neighbour_id) AS rank FROM pairs)
SELECT qid, rank, neighbour_id, round(d, 6) AS distance FROM ranked WHERE rank <= {KNN_K}
""")
def q_ivf_exact_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 by inverted lists, exact: the nearest lists first, then those that their radius does not rule out."""
    _, asked, index = _vector_index(spark, sf_dir)
    hits = index.search(asked, KNN_K, exact=True, exclude_self=True)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbour_id"), rnd("distance").alias("distance"))


def _recall(exact: DataFrame, probed: DataFrame, work: DataFrame, rows: int) -> DataFrame:
    """qid, hits, found, lists, share: exact hits, those among the probed ones, lists probed, share of the rows met."""
    found = exact.select("qid", "id").join(probed.select("qid", "id", F.lit(1).alias("_in")), ["qid", "id"], "left")
    per = found.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.coalesce("_in", F.lit(0))).cast("long").alias("found"))
    return per.join(work, "qid").select("qid", "hits", "found", "lists", (F.col("rows") / F.lit(rows)).alias("share"))


@register("ivf_probe_recall")
def q_ivf_probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10 of the probed lists against the full scan for every hundredth vector, and the share of all vectors that they hold."""
    emb, asked, index = _vector_index(spark, sf_dir)
    exact = knn_ops.knn_join(asked, emb, k=KNN_K, x_id="vec_id", exclude_self=True)
    return _recall(exact, index.search(asked, KNN_K, exclude_self=True), index.work(asked), int(index.rows.sum()))


@register("ivf_chunk_recall")
def q_ivf_chunk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10 of the probed lists against the full scan for every benchmark question over the chunks of the corpus."""
    chunks = _corpus_index(spark, sf_dir).select("chunk_id", "vec")
    root = scratch_path(spark, f"ivf-{uuid.uuid4().hex}")
    ivf_index.build(chunks, root, "chunk_id", "vec", metric="cosine")
    index = ivf_index.IvfIndex(spark, root, "cosine")
    asked = embed_ops.count_vectors(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), "text", "embedding")
    exact = _benchmark_hits(spark, sf_dir, KNN_K).select("qid", F.col("chunk_id").alias("id"))
    return _recall(exact, index.search(asked, KNN_K), index.work(asked), int(index.rows.sum()))


# ------------------------------------------------------------ J2 with a lexicon of the data
#: Keywords taken from the corpus: its most frequent words of four letters or more.
LEXICON_WORDS = 10_000

_LEXICON_SQL = f"""
SELECT w AS keyword, 'intent-' || ((length(w) * 31 + ascii(w)) % 7) AS intent, CAST((length(w) * 31 + ascii(w)) % 7 AS INT) AS intent_ord
FROM (SELECT w, count(*) AS n FROM (SELECT {{words}} AS w FROM documents) x GROUP BY w ORDER BY n DESC, w LIMIT {LEXICON_WORDS}) y
"""


@register("keyword_join_corpus", oracle=f"""
WITH lex AS ({_LEXICON_SQL.format(words="unnest(regexp_extract_all(lower(text), '[a-z]{4,}'))")}),
t AS (SELECT doc_id, {S.strip('lower(text)')} AS t FROM documents),
s AS (SELECT doc_id, intent, intent_ord, sum(CASE WHEN t = keyword THEN 10 ELSE 1 END) AS score
      FROM t JOIN lex ON contains(t, keyword) GROUP BY doc_id, intent, intent_ord)
SELECT doc_id, intent, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, intent_ord) = 1
""")
def q_keyword_join_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + W7 over whole documents with a lexicon of 10,000 words of the corpus, by Aho-Corasick."""
    from ..operators import route as route_ops
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"))).alias("w")).groupBy("w").count()
    top = words.orderBy(F.desc("count"), "w").limit(LEXICON_WORDS)
    order = (F.length("w") * 31 + F.ascii("w")) % 7
    lexicon = top.select(F.col("w").alias("keyword"), F.concat(F.lit("intent-"), order).alias("intent"), order.cast("int").alias("intent_ord"))
    best = route_ops.keyword_join(docs, lexicon.checkpoint(eager=True), "doc_id", "text")
    return best.select("doc_id", "intent", F.col("score").cast("long").alias("score"))
