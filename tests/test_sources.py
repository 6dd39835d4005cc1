"""Sources and sinks on small files written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from ragloom.sources import app_log, corpus, index_store, labelled


def test_scan_text_corpus_rejects_bad_utf8(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("第一行\n第二行", encoding="utf-8")
    (tmp_path / "two.txt").write_bytes(b"ok \xff\xfe broken")
    (tmp_path / "skip.md").write_text("not a txt")
    docs, rejects = corpus.scan_text_corpus(spark, str(tmp_path))
    d = docs.collect()
    assert len(d) == 1 and d[0]["text"] == "第一行\n第二行" and d[0]["n_chars"] == 7
    assert [r["source"].endswith("two.txt") for r in rejects.collect()] == [True]


def test_pending_documents_and_ledger(spark, tmp_path):
    for n in ("a.txt", "b.pdf", "c.md"):
        (tmp_path / n).write_text(n)
    pend = corpus.pending_documents(spark, str(tmp_path), corpus.empty_ledger(spark))
    assert sorted(r["name"] for r in corpus.pending_names(pend).collect()) == ["a.txt", "b.pdf"]
    ledger = corpus.mark_loaded(pend.filter(F.col("path").endswith("a.txt")), 0)
    left = corpus.pending_documents(spark, str(tmp_path), ledger)
    assert [r["path"].endswith("b.pdf") for r in left.collect()] == [True]


def test_read_labelled_utterances(spark, tmp_path):
    f1 = tmp_path / "general.json"
    f1.write_text(json.dumps({"greeting": ["你好", "hi"], "bogus": ["x"]}, ensure_ascii=False))
    f2 = tmp_path / "domain.json"
    f2.write_text(json.dumps({"knowledge": ["狗狗吃什么"]}, ensure_ascii=False))
    rows = labelled.read_labelled_utterances(spark, [str(f1), str(f2), str(tmp_path / "missing.json")])
    assert sorted((r["intent"], r["text"]) for r in rows.collect()) == [
        ("greeting", "hi"), ("greeting", "你好"), ("knowledge", "狗狗吃什么")]
    f3 = tmp_path / "none.json"
    f3.write_text(json.dumps({"bogus": ["x"]}))
    with pytest.raises(ValueError):
        labelled.read_labelled_utterances(spark, [str(f3)])


def test_read_intent_cases(spark, tmp_path):
    p = tmp_path / "cases.json"
    case = {"text": "你好", "expected_intent": "greeting", "description": "d"}
    p.write_text(json.dumps({"test_cases": [case, case], "edge_cases": [case]}, ensure_ascii=False))
    rows = labelled.read_intent_cases(spark, str(p)).collect()
    assert sorted(r["group"] for r in rows) == ["edge_cases", "test_cases", "test_cases"]
    assert all((r["text"], r["expected_intent"], r["description"]) == ("你好", "greeting", "d") for r in rows)


def test_parse_app_log(spark, tmp_path):
    p = tmp_path / "app.log"
    p.write_text("\n".join([
        "2024-01-01 10:00:00 | INFO     | Thread-12 | module.chat:handle:88 - Performance: retrieval took 0.523s | docs=2, q=3",
        "2024-01-01 10:00:01 | ERROR    | Thread-12 | module.chat:handle:99 - boom",
        "garbage line",
    ]))
    log = app_log.parse_app_log(spark, str(p))
    rows = log.orderBy("ts").collect()
    assert len(rows) == 2
    assert rows[0]["op"] == "retrieval" and rows[0]["seconds"] == 0.523 and rows[0]["fields"] == {"docs": "2", "q": "3"}
    assert app_log.error_log_lines(log).count() == 1
    assert app_log.performance_profile(log).first()["n"] == 1


def test_index_store_versions_and_merge(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "alpha beta gamma " * 30), (2, "s", "delta " * 50)],
                                 "doc_id long, source string, text string")
    root = str(tmp_path / "idx")
    idx = index_store.load_or_build_index(spark, root, corpus=docs)
    n = idx.count()
    new = spark.createDataFrame([(3, "s", "epsilon " * 40)], "doc_id long, source string, text string")
    idx2 = index_store.load_or_build_index(spark, root, new_docs=new)
    assert index_store.current_version(spark, root) == 1 and idx2.count() > n
    again = index_store.merge_index(idx2, idx2, dedupe=True)
    assert again.count() == idx2.select("chunk_hash").distinct().count()


def test_clean_corpus_job(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "sub" / "a.txt").write_text("short\n" + "x" * 60 + "\nwww.spam.example " + "y" * 50)
    (src / "b.txt").write_bytes(b"\xff\xfe")
    stats, totals, rejects = corpus.clean_corpus_job(spark, str(src), str(tmp_path / "out"))
    t = totals.first()
    assert (t["files_processed"], t["total_lines"], t["spam_lines"], t["short_lines"]) == (1, 3, 1, 1)
    assert rejects.count() == 1
    out = spark.read.parquet(str(tmp_path / "out")).first()
    assert out["relative_path"] == "sub/a.txt" and out["clean_text"] == "x" * 60


def test_report_model_and_lexicon_sinks(spark, tmp_path):
    from ragloom.operators import intent_model as im
    lex = labelled.lexicon_tables(spark)
    assert lex["keywords"].count() == 49 and lex["rules"].count() == 12 and lex["blocklist"].count() == 36
    per_case = spark.createDataFrame([(1, 70.0)], "qid long, score double")
    hits = spark.createDataFrame([(1, r, r, 0.5, "line\n" * 40) for r in range(1, 8)],
                                 "qid long, rank int, chunk_id long, similarity double, text string")
    labelled.write_eval_report(per_case, hits, str(tmp_path / "report"))
    rep = spark.read.json(str(tmp_path / "report")).first()
    assert len(rep["top_hits"]) == 5 and "\n" not in rep["top_hits"][0]["preview"]
    assert len(rep["top_hits"][0]["preview"]) == 150
    rows = [(i, i % 2, [float(i % 2), 1.0 - i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    model = im.train_intent_model(df, max_iter=20)
    im.save_model(model, str(tmp_path / "model"), spark, ["a", "b"])
    m2, labels = im.load_model(str(tmp_path / "model"), spark)
    assert labels == ["a", "b"]
    pred = im.classify(m2, df, class_names=labels)
    assert im.accuracy(pred, "label", "predicted").first()["accuracy"] == 1.0


def test_merge_index_replace(spark):
    cur = spark.createDataFrame([(1, "a.txt", "old a"), (2, "b.txt", "b")], "chunk_id long, source string, text string")
    new = spark.createDataFrame([(3, "a.txt", "new a")], "chunk_id long, source string, text string")
    rep = {r["chunk_id"] for r in index_store.merge_index(cur, new, on_conflict="replace").collect()}
    app = {r["chunk_id"] for r in index_store.merge_index(cur, new).collect()}
    assert rep == {2, 3} and app == {1, 2, 3}


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for k in range(2000):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    docs, rejects = corpus.scan_text_corpus(spark, str(tmp_path))
    slots = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() <= corpus.SCAN_WAVES * slots < 2000 // 32 + 1  # one task for every 32 files before
    assert sorted(r[0] for r in docs.select("text").collect()) == sorted(f"text {k}" for k in range(2000)) and rejects.count() == 0


def test_texts_are_written_as_files_in_folders_listed_apart(spark, tmp_path):
    texts = [f"text {k}\nline" for k in range(95)] + ["", None, "第一行", "ende\n", "text 1\nline"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    groups = corpus.write_text_files(df, str(tmp_path / "in box"), folder_files=10, listed_files=25)
    found = [sorted(r[0] for r in corpus.scan_text_corpus(spark, g)[0].select("text").collect()) for g in groups]
    assert len(groups) >= 4 and all(0 < len(x) <= 25 for x in found)  # all files were listed at once before
    assert sorted(t for x in found for t in x) == sorted((t or "") + "\n" for t in texts)
    ids = [r[0] for g in groups for r in corpus.scan_text_corpus(spark, g)[0].select("doc_id").collect()]
    assert len(set(ids)) == len(texts)
    # Hadoop's local file system, which starts chmod for every file, leaves a sum beside each
    assert not [*tmp_path.rglob("*.crc")] and len([*tmp_path.rglob("*.txt")]) == len(texts)


def test_bytes_that_are_no_utf8_stay_and_no_texts_are_no_files(spark, tmp_path):
    bad = spark.sql("SELECT CAST(unhex('6F6BFF') AS STRING) AS text")
    groups = corpus.write_text_files(bad, str(tmp_path / "bad"))
    docs, rejects = corpus.scan_text_corpus(spark, groups[0])
    assert docs.count() == 0 and rejects.count() == 1
    groups = corpus.write_text_files(bad.where("text = 'x'"), f"file:{tmp_path / 'none'}")
    assert groups == [[f"file:{tmp_path / 'none'}"]] and corpus.scan_text_corpus(spark, groups[0])[0].count() == 0


def test_folders_are_grouped_by_their_files():
    assert corpus._listed_together([("c", 1), ("a", 9), ("b", 2)], 10) == [["a"], ["b", "c"]]
    assert corpus._listed_together([("a", 20), ("b", 20)], 10) == [["a"], ["b"]] and corpus._listed_together([], 10) == []
