"""TextRank against a direct power iteration; client IP; category metrics."""

import re

import numpy as np
from pyspark.sql import functions as F

from ragloom.functions.text import real_client_ip
from ragloom.operators import evaluate, keywords


def _textrank_brute(text, window=5, d=0.85, iters=10):
    toks = re.findall(r"[^\W\d_]+", text.lower())
    w = {}
    for i, a in enumerate(toks):
        for b in toks[i + 1:i + window]:
            if a != b:
                k = tuple(sorted((a, b)))
                w[k] = w.get(k, 0) + 1
    nodes = sorted({t for k in w for t in k})
    ix = {t: i for i, t in enumerate(nodes)}
    M = np.zeros((len(nodes), len(nodes)))
    for (a, b), c in w.items():
        M[ix[a], ix[b]] += c
        M[ix[b], ix[a]] += c
    out = M.sum(axis=1)
    r = np.ones(len(nodes))
    for _ in range(iters):
        r = (1 - d) + d * (M / out[:, None]).T @ r
    return dict(zip(nodes, r))


def test_textrank_matches_power_iteration(spark):
    text = "dogs need food and water dogs need walks cats need sleep and food every day"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    exp = _textrank_brute(text)
    for method in ("in_row", "iterative"):
        got = {r["token"]: r["weight"] for r in keywords.textrank_keywords(df, k=50, method=method).collect()}
        assert set(got) == set(exp)
        assert all(abs(got[t] - exp[t]) < 1e-9 for t in exp)


def test_real_client_ip(spark):
    rows = [(1, "1.1.1.1, 2.2.2.2", None, "9.9.9.9"), (2, None, "3.3.3.3", "9.9.9.9"),
            (3, None, None, "9.9.9.9"), (4, " , 2.2.2.2", None, "9.9.9.9")]
    df = spark.createDataFrame(rows, "id long, xff string, xr string, ra string")
    got = {r["id"]: r["ip"] for r in df.select("id", real_client_ip("xff", "xr", "ra").alias("ip")).collect()}
    assert got == {1: "1.1.1.1", 2: "3.3.3.3", 3: "9.9.9.9", 4: ""}
    untrusted = df.select(real_client_ip("xff", "xr", "ra", trust_proxy=False).alias("ip")).collect()
    assert {r["ip"] for r in untrusted} == {"9.9.9.9"}


def test_case_keywords_and_category_metrics(spark):
    q = spark.createDataFrame([(1, "Dogs need long walks", "care"), (2, "cats sleep", "care")],
                              "qid long, text string, category string")
    cases = q.select("qid", "category", evaluate.case_keywords(F.col("text"), 3).alias("keywords"))
    assert q.select(evaluate.case_keywords(F.col("text"))).first()[0] == ["walks", "Dogs", "long", "need"]
    kw = {r["qid"]: r["keywords"] for r in cases.collect()}
    assert kw[1] == ["walks", "Dogs", "long"] and kw[2] == ["sleep", "cats"]
    hits = spark.createDataFrame([(1, 1, "walks and Dogs"), (1, 2, "nothing"), (2, 1, "cats sleep")],
                                 "qid long, rank int, text string")
    m = evaluate.category_metrics(hits, cases).first()
    assert m["relevant"] == 2 and m["hits"] == 3
    assert m["found"] == 4 and m["expected"] == 5


def test_token_counts_are_not_shuffled_unless_ids_repeat(spark):
    from ragloom.operators import keywords
    rows = [(1, "a b a ß"), (1, "b Straße 中文字"), (2, None), (None, "a a"), (None, "a x"), (3, ""), (4, "B b; b-a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["token"]): r["tf"] for r in keywords.term_frequencies(docs).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (1, "ß"): 1, (1, "straße"): 1, (1, "中文"): 1, (1, "文字"): 1, (None, "a"): 3, (None, "x"): 1,
                   (4, "b"): 3, (4, "a"): 1}
    df = {r["token"]: r["df"] for r in keywords.document_frequencies(docs).collect()}
    assert df == {"a": 4, "b": 3, "ß": 1, "straße": 1, "中文": 1, "文字": 1, "x": 1}
    single = docs.where("doc_id > 1")
    assert "Exchange hash" not in keywords.term_frequencies(single)._jdf.queryExecution().executedPlan().toString()  # by (id, token) before
    tops = {(r["doc_id"], r["token"]): (r["tf"], r["df"]) for r in keywords.tfidf_keywords(docs, 5).collect()}
    assert tops[(1, "b")] == (2, 3) and tops[(None, "a")] == (3, 4) and len(tops) == 9
