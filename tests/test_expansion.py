"""P7 with the corpus-weighted keyword generator."""

import math
import re
from collections import Counter

from ragloom.operators import answer, keywords


def plain(question, corpus, k):
    docs = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in corpus]
    tf = Counter(re.findall(r"[^\W\d_]+", question.lower()))
    score = {w: round(n * math.log(len(corpus) / max(1, sum(w in d for d in docs))), 9) for w, n in tf.items()}
    query = " ".join(sorted(score, key=lambda w: (-score[w], w))[:k])[:50].strip()
    return query or question


CORPUS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "spark joins tables", "the end", "the cat"]
QUESTIONS = [(1, "Where does the cat sit, the cat?"), (2, "How do SPARK joins work on the tables"), (3, "123 ?!"), (4, ""),
             (5, "unseen unseen words " * 4), (6, "the the the")]


def test_queries_against_plain_weights(spark):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    df = spark.createDataFrame([(q, t, "mine") for q, t in QUESTIONS], "qid long, text string, token string")
    freq = keywords.document_frequencies(corpus)
    got = answer.expand_by_corpus(df, freq, len(CORPUS), k=4)
    assert got.columns == [*df.columns, "query"]
    assert {r["qid"]: r["query"] for r in got.collect()} == {q: plain(t, CORPUS, 4) for q, t in QUESTIONS}
    assert answer.expand_by_corpus(df.where("false"), freq, 0).count() == 0
    assert answer.expand_by_corpus(df, freq.where("false"), 0).count() == len(QUESTIONS)


def test_context_comes_from_the_question_and_reports_the_expanded_hits(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(CORPUS)], "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "which tables does spark join, and where is the end?")], "qid long, text string")
    calls = []

    def retriever(qv, index, k):
        calls.append(qv)
        return qv.selectExpr("qid", "1 AS rank", "CAST(3 AS BIGINT) AS id")
    out = answer.answer_context(qs, chunks, k=2, route=False, compress=False, context_from_question=True, retriever=retriever).first()
    assert len(calls) == 2 and out["query"] != "which tables does spark join, and where is the end?"
    assert out["n_docs"] == 1 and "spark joins tables" in out["prompt"]
