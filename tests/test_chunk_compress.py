"""Chunker properties and compression rules."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ragloom.operators import chunk, compress, embed


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n")), min_size=0, max_size=600),
       st.integers(20, 120), st.integers(0, 15))
def test_split_text_properties(text, size, overlap):
    chunks = chunk.split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert all(c == c.strip() for c in chunks)
    # every word that fits a chunk survives whole in some chunk
    for w in text.split():
        if len(w) <= size:
            assert any(w in c for c in chunks)


def test_split_text_prefers_strong_boundaries():
    text = ("a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30)
    assert chunk.split_text(text, 70, 0) == ["a" * 30 + "\n\n" + "b" * 30, "c" * 30]


def test_split_text_overlap_carry():
    words = " ".join(f"w{i:02d}" for i in range(30))
    chunks = chunk.split_text(words, 20, 8)
    assert all(len(c) <= 20 for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        assert a.split()[-1] == b.split()[0] or a.split()[-2:] == b.split()[:2]


def test_fixed_chunks_cover_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    rows = chunk.chunk_documents_fixed(df, 800, 150).orderBy("chunk_no").collect()
    assert [len(r["text"]) for r in rows] == [800, 800, 700]
    rebuilt = rows[0]["text"] + "".join(r["text"][150:] for r in rows[1:])
    assert rebuilt == text and all(r["source"] == "s" for r in rows)


def test_fixed_chunks_of_a_long_text_take_one_pass(spark):
    import time
    line = "a line of words \U0001F600 é 中\r\n"
    df = spark.createDataFrame([(1, 700_000), (2, 0)], "doc_id long, n int").selectExpr("doc_id", f"repeat('{line}', n) AS text")
    start = time.monotonic()
    rows = chunk.chunk_documents_fixed(df, 800, 150).selectExpr("doc_id", "chunk_no", "md5(text) AS digest").collect()
    assert time.monotonic() - start < 60  # minutes when every chunk was sought from the start of the text
    text = line * 700_000
    want = [hashlib.md5(text[650 * i:650 * i + 800].encode()).hexdigest() for i in range(1 + -(-(len(text) - 800) // 650))]
    assert [(r["doc_id"], r["chunk_no"], r["digest"]) for r in sorted(rows, key=lambda r: r["chunk_no"])] == [(1, i, d) for i, d in enumerate(want)]


@pytest.mark.parametrize("n", [1, 149, 150, 650, 651, 799, 800, 801, 1450, 1451, 2100])
def test_fixed_chunks_end_where_the_text_ends(spark, n):
    text = "".join(chr(97 + i % 23) for i in range(n))
    got = chunk.chunk_documents_fixed(spark.createDataFrame([(1, text)], "doc_id long, text string"), 800, 150).collect()
    assert [r["text"] for r in got] == [text[650 * i:650 * i + 800] for i in range(1 + max(0, -(-(n - 800) // 650)))]


def test_recursive_chunks_in_spark(spark):
    text = "\n\n".join(("para %d " % i) * 30 for i in range(6))
    df = spark.createDataFrame([(7, text, "s")], "doc_id long, text string, source string")
    rows = chunk.chunk_documents(df, 300, 50).collect()
    assert rows and all(len(r["text"]) <= 300 for r in rows)
    assert [r["chunk_no"] for r in rows] == list(range(len(rows)))
    assert [r["chunk_id"] for r in rows] == [int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16) for i in range(len(rows))]


def _compress(spark, text, question, **kw):
    hits = spark.createDataFrame([(1, 1, text)], "qid long, rank int, text string")
    qs = spark.createDataFrame([(1, question)], "qid long, question string")
    return compress.compress_hits(hits, qs, **kw).first()


def test_short_text_unchanged(spark):
    t = "狗狗要喂食物。短。\n狗狗需要运动哦"
    assert _compress(spark, t, "狗狗吃什么")["compressed"] == t


def test_keeps_three_in_document_order(spark):
    sents = ["狗狗每天需要散步", "猫咪喜欢晒太阳啊", "狗狗需要吃狗粮", "鹦鹉会说很多话", "狗狗洗澡要小心"]
    r = _compress(spark, "。".join(sents) + "。", "狗狗需要")
    kept = r["compressed"].rstrip("。").split("。")
    assert len(kept) == 3 and r["compressed"].endswith("。")
    assert kept == [s for s in sents if s in kept]  # document order
    assert set(kept) <= set(sents)


def test_prefilter_order_is_score_order(spark):
    sents = [f"第{i}句没有关键字内容" for i in range(9)] + ["关键字甲在这里出现", "关键字乙也在这里", "甲乙两个都在这句"]
    hits = spark.createDataFrame([(1, 1, "。".join(sents), ["甲", "乙"])],
                                 "qid long, rank int, text string, kws array<string>")
    qs = spark.createDataFrame([(1, "甲乙")], "qid long, question string")
    r = compress.compress_hits(hits, qs, keywords_col="kws").first()
    kept = r["compressed"].rstrip("。").split("。")
    assert kept[0] == "甲乙两个都在这句"  # prefilter (score) order, not document order


def test_embedder_is_unit_norm(spark):
    df = spark.createDataFrame([("hello world",), ("",)], "text string")
    rows = embed.embed(df).collect()
    import numpy as np
    assert abs(np.linalg.norm(rows[0]["embedding"]) - 1) < 1e-5
    assert np.linalg.norm(rows[1]["embedding"]) == 0


def test_answer_context_custom_retriever(spark):
    from ragloom.operators import answer
    chunks = spark.createDataFrame([(1, "dogs eat food every day."), (2, "cats sleep a lot.")],
                                   "chunk_id long, text string")
    qs = spark.createDataFrame([(10, "what do dogs eat"), (11, "   ")], "qid long, text string")

    from ragloom.operators import knn

    def l2_blocks(qv, index, k):  # U2: another strategy (squared L2, blocked cogroup)
        return knn.knn_join(qv, index, k=k, q_id="qid", q_vec="vec", x_id="chunk_id",
                            x_vec="vec", strategy="blocks")

    out = {r["qid"]: r for r in answer.answer_context(qs, chunks, k=1, retriever=l2_blocks).collect()}
    assert not out[11]["ok"]
    assert out[10]["n_docs"] == 1 and "dogs eat food" in out[10]["prompt"]


def test_prompt_template_single_pass(spark):
    from ragloom.operators import context
    hits = spark.createDataFrame([(1, 1, "ctx mentions {question} literally")], "qid long, rank int, text string")
    qs = spark.createDataFrame([(1, "Q?")], "qid long, question string")
    r = context.assemble_context(hits, qs).first()
    assert "ctx mentions {question} literally" in r["prompt"] and "问题：Q?" in r["prompt"]
    assert r["n_docs"] == 1
