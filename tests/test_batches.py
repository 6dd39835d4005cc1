"""What Python workers hold: results leave them in bounded pieces, whatever a batch of texts gives."""

import pyarrow as pa
import pytest

from ragloom.operators import chunk, embed, keywords


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXT = " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}" for k in range(30_000))


@pytest.fixture
def docs(spark):
    rows = [(1, "a", "one two one three"), (1, "b", "one two one three"), (None, "c", "x y"), (4, None, None), (5, "e", ""), (6, "f", TEXT)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)


def test_edges_leave_in_batches(docs):
    e = keywords.cooccurrence_edges(docs)
    assert "MapInArrow" in plan(e) and "ArrowEvalPython" not in plan(e)
    got = sorted((r["u"], r["v"], r["w"]) for r in e.where("doc_id = 1").collect())
    one = [("one", "three", 2.0), ("one", "two", 2.0), ("three", "two", 1.0)]
    assert got == sorted(2 * (one + [(v, u, w) for u, v, w in one]))
    assert [tuple(r) for r in e.where("doc_id is null").sort("u").collect()] == [(None, "x", "y", 1.0), (None, "y", "x", 1.0)]
    assert e.where("doc_id in (4, 5)").isEmpty()
    names, u, v, w = keywords._graph(TEXT, 5)
    assert e.where("doc_id = 6").count() == 2 * len(u)


def test_edges_of_a_struct_id(spark):
    df = spark.sql("SELECT struct(1L AS qid, 2 AS rank) AS doc_id, 'p q' AS text")
    assert [r["doc_id"].asDict() for r in keywords.cooccurrence_edges(df).collect()] == 2 * [{"qid": 1, "rank": 2}]


def test_lists_of_texts():
    got = keywords._lists(pa.array(["aab", None, ""]), lambda t: [{"gram": c, "n": k} for k, c in enumerate(t or "")], ["gram", "n"], [pa.string(), pa.int64()])
    assert got.to_pylist() == [[{"gram": "a", "n": 0}, {"gram": "a", "n": 1}, {"gram": "b", "n": 2}], [], []]


def test_chunks_leave_in_batches(docs):
    c = chunk.chunk_documents(docs)
    assert "MapInArrow" in plan(c) and "ArrowEvalPython" not in plan(c)
    got = sorted((r["doc_id"] or 0, r["source"] or "", r["chunk_no"], r["text"]) for r in c.collect())
    want = [(d or 0, s or "", k, t) for d, s, text in docs.collect() for k, t in enumerate(chunk.split_text(text or ""))]
    assert got == sorted(want)


def test_embedder_meets_bounded_batches(spark):
    class Sizes:
        dim = 1

        def embed(self, texts):
            import numpy as np
            return np.full((len(texts), 1), len(texts))

    df = spark.range(3000).selectExpr("cast(id as string) as text").coalesce(1)
    seen = {r[0][0] for r in df.select(embed.embed_col("text", Sizes)).collect()}
    assert max(seen) <= embed.BATCH == 1024
