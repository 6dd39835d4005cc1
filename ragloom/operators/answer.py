"""Question -> context composites (C2, C3) and query expansion.

One output row per question. The cheap checks run first and split the
table: rejected questions (validation) and short-circuited ones (routing
policy) leave early; only the rest is expanded, embedded, matched against
the index, compressed and turned into a prompt. The three parts are
re-joined with ``unionByName``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.text import clean_query
from . import cascade as cascade_ops
from . import compress as comp_ops
from . import context as ctx_ops
from . import embed as embed_ops
from . import keywords as kw_ops
from . import knn as knn_ops
from . import route as route_ops
from . import validate as val_ops

OUT_COLS = ["qid", "ok", "reason", "intent", "method", "skip_rag", "query", "n_docs",
            "reply", "prompt"]


def _generated(generator: Callable[[pd.Series], pd.Series], one: pd.Series) -> pd.Series:
    try:
        return generator(one)
    except Exception:  # this question keeps its own text
        return pd.Series([None], index=one.index, dtype=object)


def expand_queries(df: DataFrame, text_col: str = "text", out_col: str = "query",
                   generator: Callable[[pd.Series], pd.Series] | None = None,
                   enabled: bool = True) -> DataFrame:
    """Generated query, cleaned (P6); empty, failed or disabled -> the question.

    ``generator`` maps a pandas Series of expansion prompts (the question put
    into ``QUERY_EXPANSION_TEMPLATE``) to generated strings and runs as an
    Arrow-batched pandas UDF (a failure for a batch yields nulls, hence the
    original question). Without a generator the whole question is the query.
    """
    q = F.col(text_col)
    if not enabled or generator is None:
        return df.withColumn(out_col, q)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        try:
            return generator(s)
        except Exception:  # the batch failed: each question is tried on its own
            return pd.concat([_generated(generator, s.iloc[i:i + 1]) for i in range(len(s))])

    cleaned = clean_query(run(F.replace(F.lit(L.QUERY_EXPANSION_TEMPLATE), F.lit("{question}"), q)))
    return df.withColumn(out_col, F.when(cleaned.isNull() | (cleaned == ""), q).otherwise(cleaned))


def expand_by_corpus(df: DataFrame, frequencies: DataFrame, n_docs: int, text_col: str = "text", out_col: str = "query",
                     k: int = 10) -> DataFrame:
    """P7 with the default generator: a question's ``k`` keywords by weight in the corpus (P16), cleaned.

    A join with the corpus's document frequencies, no Python. A question
    without a token keeps its own text.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    found = kw_ops.corpus_keywords(rows, frequencies, n_docs, k, "_row", text_col)
    cleaned = clean_query(F.array_join("keywords", " "))
    return (rows.join(found, "_row", "left")
            .withColumn(out_col, F.when(cleaned.isNull() | (cleaned == ""), F.col(text_col)).otherwise(cleaned)).drop("_row", "keywords"))


def answer_context(questions: DataFrame, chunks: DataFrame, index: DataFrame | None = None,
                   k: int = L.RETRIEVER_K, route: bool = True, compress: bool = True,
                   expand: bool = True, generator=None,
                   terminators: str = L.SENTENCE_TERMINATORS_CJK,
                   qid: str = "qid", text_col: str = "text", retriever=None,
                   context_from_question: bool = False, model=None, mode: str = "similarity",
                   fetch_k: int = L.RETRIEVER_FETCH_K, lambda_mult: float = L.MMR_LAMBDA,
                   score_threshold: float = L.SCORE_THRESHOLD, frequencies: DataFrame | None = None) -> DataFrame:
    """C2 (``route=True, compress=True``) / C3 (both off).

    ``chunks(chunk_id, text)`` is the retrievable text; ``index(chunk_id, vec)``
    its count vectors (computed with the default embedder when omitted).
    ``expand``: questions are searched with ``generator``'s text, or without
    one with their keywords by weight in ``chunks`` (``frequencies(token, df)``
    of the chunks are computed when omitted).
    ``context_from_question`` (C3): the prompt context is retrieved with the
    question itself; the expanded-query hits are only reported (``n_docs``).
    ``retriever`` (U2) replaces the default exact cosine search: a callable
    ``(query_vectors(qid, vec), index, k) -> (qid, rank, id)``.
    ``model`` (M1) adds the classifier stage to the routing. ``mode`` is
    ``similarity``, ``mmr`` (``fetch_k`` candidates, ``lambda_mult``) or
    ``threshold`` (relevance at least ``score_threshold``).
    Output columns: ``OUT_COLS``.

    Custom steps (U3) follow the DataFrame convention: any
    ``DataFrame -> DataFrame`` function can be chained with ``df.transform(fn)``.
    """
    if mode not in ("similarity", "mmr", "threshold"):
        raise ValueError(f"unknown retrieval mode {mode!r}")
    v = val_ops.validate_questions(questions.select(qid, text_col), text_col)
    rejected = (v.filter(~F.col("ok"))
                .select(qid, "ok", "reason", F.lit(None).cast("string").alias("intent"),
                        F.lit(None).cast("string").alias("method"),
                        F.lit(None).cast("boolean").alias("skip_rag"),
                        F.lit(None).cast("string").alias("query"),
                        F.lit(0).cast("long").alias("n_docs"),
                        F.col("error").alias("reply"), F.lit(None).cast("string").alias("prompt")))
    passed = v.filter(F.col("ok")).drop("error")
    if route:
        routed = (route_ops.route_questions(passed, text_col) if model is None
                  else cascade_ops.route_with_model(passed, model, text_col))
    else:
        routed = passed.withColumns({"intent": F.lit(None).cast("string"),
                                     "confidence": F.lit(None).cast("double"),
                                     "method": F.lit(None).cast("string"),
                                     "skip_rag": F.lit(False),
                                     "response": F.lit(None).cast("string")})
    # routed questions feed four branches: materialise them once (reliable checkpoint)
    routed = routed.checkpoint(eager=True)
    skipped = (routed.filter(F.col("skip_rag"))
               .select(qid, "ok", "reason", "intent", "method", "skip_rag",
                       F.lit(None).cast("string").alias("query"), F.lit(0).cast("long").alias("n_docs"),
                       F.col("response").alias("reply"), F.lit(None).cast("string").alias("prompt")))
    go = routed.filter(~F.col("skip_rag"))
    if expand and generator is None:
        if frequencies is None:
            frequencies = kw_ops.document_frequencies(chunks).checkpoint(eager=True)
        go = expand_by_corpus(go, frequencies, chunks.count(), text_col)
    else:
        go = expand_queries(go, text_col, "query", generator, expand)
    if index is None:
        index = embed_ops.count_vectors(chunks.select("chunk_id", "text"), "text", "vec")
    def retrieve(col):
        qv = embed_ops.count_vectors(go.select(qid, F.col(col).alias("_q")), "_q", "vec") \
            .withColumnRenamed(qid, "qid")
        if retriever is not None:
            return retriever(qv, index, k)
        top = knn_ops.knn_join(qv, index, k=fetch_k if mode == "mmr" else k, q_id="qid", q_vec="vec", x_id="chunk_id",
                               x_vec="vec", metric="cosine")
        if mode == "threshold":
            return knn_ops.score_threshold(knn_ops.with_relevance(top), score_threshold).drop("relevance")
        if mode == "mmr":
            pairs = (knn_ops.join_hits(top, index.select("chunk_id", F.col("vec").alias("x_vec")))
                     .join(qv.select("qid", F.col("vec").alias("q_vec")), "qid"))
            return knn_ops.mmr(pairs, k=k, lambda_mult=lambda_mult).select("qid", F.col("mmr_rank").alias("rank"), "id")
        return top

    top = retrieve("query")
    reported = None
    if context_from_question:
        reported = top.groupBy(F.col("qid").alias(qid)).agg(F.count(F.lit(1)).alias("_reported"))
        if expand:  # otherwise the query is the question
            top = retrieve(text_col)
    hits = knn_ops.join_hits(top, chunks.select("chunk_id", "text")) \
        .select(F.col("qid").alias(qid), "rank", F.col("id").alias("chunk_id"), "text")
    if compress:
        qs = go.select(qid, F.col(text_col).alias("question"))
        hits = (comp_ops.compress_hits(hits, qs, qid=qid, terminators=terminators)
                .select(qid, "rank", F.col("compressed").alias("text")))
    ctx = ctx_ops.assemble_context(hits, go.select(qid, F.col(text_col).alias("question")), qid=qid)
    answered = go.join(ctx.drop("question"), qid, "left")
    if reported is not None:
        answered = answered.drop("n_docs").join(reported.withColumnRenamed("_reported", "n_docs"),
                                                qid, "left")
    answered = answered.select(qid, "ok", "reason", "intent", "method", "skip_rag", "query",
                               F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"),
                               F.lit(None).cast("string").alias("reply"), "prompt")
    return rejected.unionByName(skipped).unionByName(answered).select(*OUT_COLS)
