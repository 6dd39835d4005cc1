import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ragloom.llm import language_id, queries
from ragloom.llm.common import scratch
from tests.llm import test_decontaminate, test_mixing, test_simhash
from tests.llm.helpers import DOCS, awkward, empty, prose

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        yield name, docs, out
        docs = out


def test_stages_on_awkward_rows(spark):
    seen = {}
    docs = awkward(spark, ("__row", "fp", "size", "hits"))
    for name, before, after in stages(spark, docs):
        after = after.cache()
        seen[name] = after
        if name != "token_files":
            assert after.columns == docs.columns
    texts = {name: Counter(r["text"] for r in df.collect()) for name, df in seen.items() if name != "token_files"}
    assert None not in texts["language_id"] and all(any(c.isalpha() for c in t) for t in texts["language_id"])
    assert max(texts["simhash_dedup"].values()) == 1
    assert set(texts["mix"]) <= set(texts["decontamination"]) <= set(texts["simhash_dedup"])
    assert seen["token_files"].count() == seen["mix"].count()


def test_stages_on_an_empty_table(spark):
    for _, _, after in stages(spark, empty(spark)):
        assert after.count() == 0


def test_run_and_registration(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
    names = __spark_entry__.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.oracles()) <= set(__spark_entry__.oracle_sql())


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.count() == docs.count() and language_id.UNKNOWN == "und"


def planted(spark):
    """The small table with exact and near copies, benchmark passages, ambiguous and letterless texts; and its rows."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    passage = " ".join(spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"].split()[:13])
    long = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    rows += [(10_000 + k, long[1], "en", "web", 1) for k in range(5)] + [(10_100 + k, long[1] + f" tail{k}", "en", "web", 1) for k in range(5)]
    rows += [(10_200, passage, "en", "web", 1), (10_201, f"{prose(1, 100)} {passage} {prose(2, 100)}", "en", "web", 1),
             (10_202, f"{prose(3, 2000)} {passage}", "en", "web", 1), (10_300, "12345 !?", "en", "web", 1), (10_301, None, "en", "web", 0),
             (10_302, "a", "en", "web", 1), (10_303, "", None, None, 0)]
    path = scratch(spark, "planted")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_every_stage_against_plain_python(spark):
    docs = planted(spark)
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
            judged = {r[0]: model.predict(r[1]) for r in rows}
            want = Counter(i for i, (lang, score) in judged.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE)
            assert not {10_300, 10_301, 10_303} & set(want) and {10_000, 10_200} <= set(want)
        elif name == "simhash_dedup":
            _, roots = test_simhash.expected(rows)
            best = {}
            for r, root in zip(rows, roots):
                best[root] = min(best.get(root, r[0]), r[0])
            want = Counter(best.values())
            assert not {10_001, 10_100} & set(want)
        elif name == "decontamination":
            want = Counter(r[0] for r in rows if not test_decontaminate.plain(r[1], benchmark)[4])
            assert 10_201 not in want and 10_202 in want
        elif name == "mix":
            size, total, target, key = test_mixing.plain(rows)
            want = Counter()
            for s in total:
                epochs, before = int(target[s] // total[s]), 0
                rest = target[s] - epochs * total[s]
                for _, i, n in sorted((key[i], rows[i][0], size[i]) for i in range(len(rows)) if rows[i][3] == s):
                    want[i] += epochs + (rest > 0 and 2 * before + n <= 2 * rest)
                    before += n
            want = +want
        else:
            whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want, start = Counter(), 0
            for d, t in sorted((r[0], r[1]) for r in rows):
                ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
                want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
                start += len(ids)
            assert Counter(map(tuple, stage(spark, docs, SF).collect())) == want
            return
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert Counter(r["doc_id"] for r in docs.collect()) == want, name
