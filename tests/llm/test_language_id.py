import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from ragloom.llm import language_id
from tests.llm.helpers import awkward, empty


def plain_bits(texts, text, size):
    """PPM method C with exclusion, one symbol at a time."""
    trees = [{}, {}, {}]
    for t in texts:
        s = language_id.symbols(t).tolist()
        for i in range(2, len(s)):
            for k in range(3):
                node = trees[k].setdefault(tuple(s[i - k:i]), {})
                node[s[i]] = node.get(s[i], 0) + 1
    s, bits = language_id.symbols(text).tolist(), 0.0
    for i in range(2, len(s)):
        p, excluded = 1.0, set()
        for k in (2, 1, 0):
            node = {c: n for c, n in trees[k].get(tuple(s[i - k:i]), {}).items() if c not in excluded}
            total, kinds = sum(node.values()), len(node)
            if not node:
                continue
            escape = kinds if size - len(excluded) > kinds else 0
            if s[i] in node:
                p *= node[s[i]] / (total + escape)
                break
            p *= escape / (total + escape)
            excluded |= set(node)
        else:
            p /= size - len(excluded)
        bits -= math.log2(p)
    return bits


def test_code_lengths_against_plain_ppm():
    texts = {"a": ["Abc abd, abe abc!", "bca ca"], "b": ["Zxy yxz", "abc xyz é è"]}
    counts = []
    for lang, ts in texts.items():
        g, n = np.unique(np.concatenate([language_id._grams(language_id.symbols(t), language_id.SYMBOLS) for t in ts]), return_counts=True)
        counts += [(lang, int(x), int(y)) for x, y in zip(g, n)]
    model = language_id.Model(counts)
    for t in ("abc abd", "xyz", "abè cab zz", "a"):
        want = [plain_bits(texts[lang], t, model.size) for lang in ("a", "b")]
        assert np.allclose(model.lengths(t), want, rtol=1e-5)
    assert np.allclose(np.exp2(-model.bits.reshape(model.size, model.size, model.size, -1)).sum(2), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 200 and np.mean([r["language"]["lang_pred"] == r["lang"] for r in held]) > 0.99
    assert all(0 <= r["language"]["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    swapped = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a = {r["doc_id"]: r["language"] for r in language_id.identify(docs).collect()}
    b = {r["doc_id"]: r["language"] for r in language_id.identify(swapped).collect()}
    assert a == b


def test_awkward_rows(spark):
    df = awkward(spark, ("language", "score"))
    got = language_id.identify(df, out="language").collect()
    assert len(got) == df.count() and got[0]["score"] == "mine"
    for r in got:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["language"]["lang_pred"] == "und") == (not letters)
        assert r["language"]["score"] == 0 if not letters else 0 < r["language"]["score"] <= 1


def test_empty(spark):
    assert language_id.identify(empty(spark)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["language"]["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
