"""Values typed in by hand, and operators at the edges of their contracts."""

import datetime as dt
import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import lexicon as L
from ragloom.functions.text import words
from ragloom.operators import answer, cascade, chunk, compress, context, embed, evaluate, intent_model, keywords, knn, route
from ragloom.sources import corpus, index_store, ingest
from ragloom.streaming import jobs


def test_class_order_and_strip_class():
    assert L.INTENT_CLASSES == ["greeting", "knowledge", "politeness", "system", "chitchat", "unknown"]
    assert L.NGRAM_STRIP_CLASS == "[，。！？、；：\"\"（）【】《》 \t\n\r]+"


def test_ngrams_keep_the_apostrophe(spark):
    df = spark.createDataFrame([(1, "don't, don't")], "doc_id long, text string")
    got = {r["gram"]: r["n"] for r in keywords.ngram_keywords(df, k=50).collect()}
    assert got["n't"] == 2 and got["'t"] == 2


def test_chinese_runs_become_bigrams(spark):
    text = "知识库 Vector检索abc 好"
    want = ["知识", "识库", "vector", "检索", "abc", "好"]
    assert keywords.tokens(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(words("t")).first()[0] == want


def test_model_answers_only_what_rules_and_keywords_leave_open(spark):
    texts = [(k, t, "knowledge" if k % 2 else "chitchat") for k, t in enumerate(
        ["zzyx qqrr pplm", "mmnn bbvv ccxx", "zzyx qqrr ppll", "mmnn bbvv ccxy", "zzyx qqrs pplm", "mmnm bbvv ccxx"])]
    model = cascade.train_on_texts(spark.createDataFrame(texts, "id int, text string, intent string"), max_iter=50)
    qs = spark.createDataFrame([(1, "你好"), (2, "zzyx qqrr pplm"), (3, "mmnn bbvv ccxx"), (4, "")], "qid int, text string")
    got = {r["qid"]: r for r in cascade.route_with_model(qs, model, min_confidence=0.3).collect()}
    assert got[1]["method"] == "rule" and len(got) == 4
    assert (got[2]["method"], got[2]["intent"]) == ("ml", "chitchat")
    assert (got[3]["method"], got[3]["intent"]) == ("default", "knowledge")  # the model's own answer "knowledge" is the default


def test_answers_by_mode(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(
        ["alpha beta gamma", "alpha beta gamma", "alpha beta delta", "omega psi chi"])], "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "alpha beta gamma")], "qid long, text string")
    n = {}
    for mode in ("similarity", "mmr", "threshold"):
        r = answer.answer_context(qs, chunks, k=2, route=False, compress=False, mode=mode).first()
        n[mode] = (r["n_docs"], "omega" in r["prompt"])
    assert n["similarity"] == (2, False) and n["mmr"][0] == 2 and n["threshold"] == (2, False)
    with pytest.raises(ValueError):
        answer.answer_context(qs, chunks, mode="nearest")


def test_repeated_keyword_counts_once(spark):
    hits = spark.createDataFrame([(1, 1, 10, 0.65, "a dog here"), (1, 2, 11, 0.65, "nothing")],
                                 "qid long, rank int, chunk_id long, similarity double, text string")
    cases = spark.createDataFrame([(1, ["dog", "dog", "cat"])], "qid long, keywords array<string>")
    r = evaluate.evaluate_cases(hits, cases).first()
    # 30 (max) + 30 (mean) + 1/3 * 15 + 15 (rank 1)
    assert r["keywords_found"] == 1 and r["score"] == pytest.approx(80.0)


def test_prefilter_ignores_case(spark):
    text = ". ".join(f"Plain sentence number {i}" for i in range(12)) + ". Dogs like long walks"
    hits = spark.createDataFrame([(1, 1, text, ["dogs"])], "qid long, rank int, text string, kws array<string>")
    qs = spark.createDataFrame([(1, "Dogs like long walks")], "qid long, question string")
    got = compress.compress_hits(hits, qs, terminators="[.]+", keywords_col="kws").first()["compressed"]
    assert got.startswith("Dogs like long walks")


def test_knn_ties_are_bounded_and_go_by_id():
    q = np.ones((60, 64))
    x = np.ones((8192, 64))
    tracemalloc.start()
    qi, xi, _ = knn._cell_topk(np.arange(60), q, np.arange(8192)[::-1].copy(), x, 2, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(qi.tolist(), xi.tolist())) == [(k, j) for k in range(60) for j in (0, 1)]
    assert peak < 200 << 20


def test_knn_far_from_the_origin():
    r = np.random.default_rng(5)
    x = 1e4 + 1e-2 * r.normal(size=(400, 16))
    q = 1e4 + 1e-2 * r.normal(size=(50, 16))
    qi, xi, _ = knn._cell_topk(np.arange(50), q, np.arange(400), x, 10, False)
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    for k in range(50):
        assert [int(j) for j in xi[qi == k]] == np.lexsort((np.arange(400), d[k]))[:10].tolist()


def test_batch_embedding_equals_single_counts():
    e = embed.HashedTrigramEmbedder(64, normalise=False)
    texts = ["abc", None, "", "a", "ab", "Ünï wörds", "x" * 500, "\U0001f600abc"]
    assert (e.embed(texts) == np.stack([e.counts(t) for t in texts])).all()
    assert (e.embed([None, ""]) == 0).all()


def test_classifier_takes_its_class_count_from_the_model(spark):
    r = np.random.default_rng(1)
    centres = 3 * r.normal(size=(11, 6))
    rows = [(i, [float(v) for v in centres[i % 11] + 0.05 * r.normal(size=6)], i % 11) for i in range(220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    model = intent_model.train_intent_model(df, max_iter=30)
    got = intent_model.classify(model, df).collect()
    assert all(len(r["probabilities"]) == 11 for r in got)
    assert {r["intent"] for r in got if r["label"] == 10} == {"10"}


def test_files_to_index_and_back(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"d{k}.txt").write_text(f"document {k} " * 300, encoding="utf-8")
    docs, rejects = corpus.scan_text_corpus(spark, str(tmp_path))
    root = str(tmp_path / "index")
    v = index_store.save_index(spark, index_store.build_index(docs), root)
    idx = index_store.load_index(spark, root)
    assert v == 0 and rejects.count() == 0
    assert idx.count() == idx.select("doc_id", "chunk_no").distinct().count() == idx.select("chunk_id").distinct().count()
    pages = corpus.scan_pages(spark.createDataFrame([("s", 3, "page text " * 200)], "source string, page int, text string"))
    assert {r["page"] for r in chunk.chunk_documents(pages).collect()} == {3}


def test_unreadable_pointer_is_an_error_and_loses_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    a = spark.range(100).withColumnRenamed("id", "chunk_id")
    assert index_store.save_index(spark, a, root) == 0
    pointer = f"{root}/_pointer/p=0"
    for f in os.listdir(pointer):
        if f.endswith(".parquet"):
            with open(f"{pointer}/{f}", "wb") as out:
                out.write(b"broken")
            os.remove(f"{pointer}/.{f}.crc")
    with pytest.raises(Exception):
        index_store.load_index(spark, root)
    assert index_store.save_index(spark, a.limit(3), root) == 1
    assert spark.read.parquet(f"{root}/v=0").count() == 100 and index_store.load_index(spark, root).count() == 3
    os.makedirs(f"{root}/_pointer/p=7")  # a pointer that was never finished
    assert index_store.load_index(spark, root).count() == 3
    assert index_store.save_index(spark, a, root) == 8


SECONDS = [[61], [59], [62], [58]]


@pytest.mark.parametrize("limit", [1, 3])
def test_stream_counts_every_open_window(spark, tmp_path, limit):
    rows = [(i, s) for i, (s,) in enumerate(SECONDS)] + [(10 + i, s) for i, s in enumerate([63, 57, 64, 56, 65, 55])]
    for i, s in rows:  # one file a request: one micro-batch each
        df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 1, "a")],
                                   "event_id long, ts timestamp_ntz, user_id long, event_type string")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        f = next(x for x in os.listdir(tmp_path / f"w{i}") if x.endswith(".parquet"))
        os.rename(tmp_path / f"w{i}" / f, tmp_path / "in" / f"{i:03d}.parquet")
    stream = jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, max_files_per_trigger=1)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.stream_fixed_window_verdicts(stream, 60, limit).writeStream.format("parquet").option("path", out),
                       str(tmp_path / "ck"))
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    second = dict(rows)
    assert set(got) == set(second)
    for window in (0, 1):
        mine = [i for i in got if second[i] // 60 == window]
        assert sum(got[i] for i in mine) == min(limit, len(mine))


@pytest.mark.parametrize("limit", [1, 3])
def test_stream_moving_window_against_a_plain_walk(spark, tmp_path, limit):
    r = np.random.default_rng(limit)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=int(ms)), int(u), "a")
            for i, (ms, u) in enumerate(zip(r.integers(0, 400_000, 150), r.integers(0, 3, 150)))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.table_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.stream_moving_window_verdicts(stream, 60, limit).writeStream.format("parquet").option("path", out),
                       str(tmp_path / "ck"))
    want, accepted = {}, {}
    for i, ts, u, _ in sorted(rows, key=lambda x: (x[1], x[0])):
        recent = [a for a in accepted.setdefault(u, []) if a > ts - dt.timedelta(seconds=60)]
        want[i] = len(recent) < limit
        accepted[u] = recent + [ts] * want[i]
    assert {x["event_id"]: x["allowed"] for x in spark.read.parquet(out).collect()} == want


def test_checkpoint_folder_is_never_invented_on_a_cluster():
    from types import SimpleNamespace

    from ragloom.session import ensure_checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)


def test_pending_files_are_loaded_once(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    (inbox / "a.txt").write_text("alpha " * 400)
    (inbox / "b.txt").write_text("beta " * 400)
    assert corpus.load_pending(spark, str(inbox), root) == 2 and corpus.load_pending(spark, str(inbox), root) == 0
    first, segments = ingest.load(spark, root).count(), ingest.segments(spark, root)
    (inbox / "c.txt").write_text("gamma " * 400)
    assert corpus.load_pending(spark, str(inbox), root) == 1
    idx = ingest.load(spark, root)
    assert idx.count() > first and idx.select("source").distinct().count() == 3
    assert ingest.segments(spark, root)[:-1] == segments  # the append rewrote nothing


def test_routing_options(spark):
    qs = spark.createDataFrame([(1, "a chihuahua"), (2, "今天天气怎么样？"), (3, "who are you")], "qid int, text string")
    plain = {r["qid"]: r["intent"] for r in route.route_questions(qs).collect()}
    words_only = {r["qid"]: r["intent"] for r in route.route_questions(qs, whole_word=True).collect()}
    extended = {r["qid"]: r["intent"] for r in route.route_questions(qs, profile="extended").collect()}
    assert plain[1] == "greeting" and words_only[1] == "knowledge"
    assert plain[2] == "knowledge" and extended[2] == "chitchat" and extended[3] == "greeting"


def test_document_order(spark):
    text = "Dogs walk far. Cats sleep all day. Dogs like long walks. Birds sing songs"
    hits = spark.createDataFrame([(1, 1, text, ["dogs"])], "qid long, rank int, text string, kws array<string>")
    qs = spark.createDataFrame([(1, "Dogs like long walks")], "qid long, question string")
    got = compress.compress_hits(hits, qs, terminators="[.]+", max_sentences=2, prefilter_k=3, keywords_col="kws", order="document").first()
    assert got["compressed"] == "Dogs walk far。Dogs like long walks。"


def test_compression_methods(spark):
    text = "Dogs walk far. Cats sleep all day. Dogs like long walks with cats. Birds sing songs"
    hits = spark.createDataFrame([(1, 1, text, ["dogs", "cats"])], "qid long, rank int, text string, kws array<string>")
    qs = spark.createDataFrame([(1, "Birds sing songs")], "qid long, question string")
    options = dict(terminators="[.]+", max_sentences=1, keywords_col="kws")
    got = {m: compress.compress_hits(hits, qs, method=m, **options).first()["compressed"] for m in ("hybrid", "semantic", "textrank")}
    assert got == {"hybrid": "Birds sing songs。", "semantic": "Birds sing songs。", "textrank": "Dogs like long walks with cats。"}
    with pytest.raises(ValueError):
        compress.compress_hits(hits, qs, method="textrank")


def test_history_with_nulls(spark):
    rows = [(None, 1, "user", "ab"), (None, 2, "assistant", "c"), (1, None, "user", "x"), (1, 1, "user", None)]
    got = context.conversation_history(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(got) == 4 and {r["position"] for r in got if r["conv_id"] is None} == {1, 2}
