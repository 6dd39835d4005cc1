"""Context compression.

For every retrieved text of a question: split into sentences (P4); texts
with at most ``max_sentences`` sentences stay as they are; otherwise the
sentences are optionally prefiltered by keyword score (W3, stable: score
desc, position asc, first ``prefilter_k``) and reranked by cosine similarity
to the question (W4); the best ``max_sentences`` are emitted in list order
(document order, or prefilter order when a prefilter ran) joined with
``。`` and closed with ``。`` (W5).

All groups are (question, hit) pairs with a bounded number of sentences;
sentence rows are exploded, scored with JVM expressions over the embedder's
vectors and folded back with a collect of at most ``max_sentences`` items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import compression_ratio, keyword_score, split_sentences
from . import embed as embed_ops


QUESTION_BROADCAST_ROWS = 32_768  # x 512 float32 = 64 MB


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of two count vectors: dot / sqrt(|a|^2 |b|^2); 0 when a norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
                           F.lit(0.0), lambda acc, v: acc + v)
    nn = dot(a, a) * dot(b, b)
    return F.when(nn > 0, dot(a, b) / F.sqrt(nn)).otherwise(F.lit(0.0))


def compress_hits(hits: DataFrame, questions: DataFrame, qid: str = "qid", rank: str = "rank",
                  text_col: str = "text", question_col: str = "question",
                  terminators: str = L.SENTENCE_TERMINATORS_CJK,
                  max_sentences: int = L.MAX_SENTENCES_PER_DOC,
                  min_length: int = L.MIN_SENTENCE_LENGTH,
                  keywords_col: str | None = None,
                  prefilter_k: int = L.PREFILTER_SENTENCES,
                  embed_counts=None, order: str = "list", method: str = "hybrid") -> DataFrame:
    """Adds n_sentences, compressed, before_chars, after_chars, ratio.

    ``keywords_col`` (array<string> on ``hits``) enables the W3 prefilter for
    texts with more than ``prefilter_k`` sentences. ``embed_counts`` maps a
    (DataFrame, text column, out column) to count vectors; default: the
    hashed trigram embedder. ``order="document"`` emits the chosen sentences
    as they stand in the text, also after a prefilter.
    ``method``: ``hybrid`` (prefilter where it applies, then the rerank),
    ``semantic`` (rerank only) or ``textrank`` (best sentences by keyword
    score, no rerank; needs ``keywords_col``).
    """
    if method not in ("hybrid", "semantic", "textrank") or method == "textrank" and not keywords_col:
        raise ValueError(f"method {method!r} is unknown or lacks keywords")
    if order not in ("list", "document"):
        raise ValueError(f"unknown order {order!r}")
    embed_counts = embed_counts or embed_ops.count_vectors
    staged = hits.withColumn("_ss", split_sentences(F.col(text_col), terminators, min_length)) \
                 .withColumn("n_sentences", F.size("_ss").cast("long"))
    long_ = staged.filter(F.col("n_sentences") > max_sentences)
    if method == "semantic":
        keywords_col = None
    kcols = [keywords_col] if keywords_col else []
    sent = long_.select(qid, rank, *kcols, F.posexplode("_ss").alias("pos", "sentence"))
    if keywords_col:
        # Stable keyword prefilter, only for texts with more than prefilter_k sentences
        wk = Window.partitionBy(qid, rank).orderBy(F.col("_kscore").desc(), F.col("pos"))
        sent = (sent.withColumn("_kscore", keyword_score(F.lower("sentence"), F.transform(F.col(keywords_col), F.lower)))
                .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(qid, rank)))
                .withColumn("_kr", F.row_number().over(wk)))
        by_keywords = sent.withColumn("_order", F.col("_kr") - 1)
        sent = (sent.filter((F.col("_n") <= prefilter_k) | (F.col("_kr") <= prefilter_k))
                .withColumn("_order", F.when(F.col("_n") > prefilter_k, F.col("_kr") - 1)
                            .otherwise(F.col("pos")))
                .drop("_kscore", "_n", "_kr", keywords_col))
    else:
        sent = sent.withColumn("_order", F.col("pos"))
    if method == "textrank":
        best = by_keywords.filter(F.col("_order") < max_sentences)
    else:
        sv = embed_counts(sent, "sentence", "_sv")
        qv = embed_counts(questions.select(qid, F.col(question_col).alias("_q")), "_q", "_qv").drop("_q")
        # question vectors may be broadcast (measured, at most QUESTION_BROADCAST_ROWS);
        # the exploded sentence side never is
        if questions.count() <= QUESTION_BROADCAST_ROWS:
            qv = F.broadcast(qv)
        scored = sv.join(qv, qid).withColumn("_cos", count_cosine(F.col("_sv"), F.col("_qv")))
        # Best max_sentences by cosine (earlier list position wins ties)
        w = Window.partitionBy(qid, rank).orderBy(F.col("_cos").desc(), F.col("_order"))
        best = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_sentences)
    folded = best.groupBy(qid, rank).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos" if order == "document" else "_order", "sentence"))),
                                 lambda s: s["sentence"]), "。").alias("_joined"))
    out = staged.join(folded, [qid, rank], "left")
    joined = F.col("_joined")
    closed = F.when((joined != "") & ~joined.endswith("。"), F.concat(joined, F.lit("。"))).otherwise(joined)
    compressed = F.when(F.col("n_sentences") <= max_sentences, F.col(text_col)).otherwise(closed)
    return (out.withColumn("compressed", compressed)
            .withColumn("before_chars", F.length(text_col).cast("long"))
            .withColumn("after_chars", F.length("compressed").cast("long"))
            .withColumn("ratio", compression_ratio("before_chars", "after_chars"))
            .drop("_ss", "_joined"))


def compression_totals(compressed: DataFrame, qid: str = "qid") -> DataFrame:
    """A2: summed lengths and overall ratio per question."""
    g = compressed.groupBy(qid).agg(F.count(F.lit(1)).alias("documents"),
                                    F.sum("before_chars").alias("before_chars"),
                                    F.sum("after_chars").alias("after_chars"))
    return g.withColumn("ratio", compression_ratio("before_chars", "after_chars"))
