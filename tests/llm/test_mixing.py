import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ragloom.llm import mixing
from ragloom.llm.common import scratch
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty


def plain(rows, weights=(3, 1, 2), share=1.5, cap=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(size)
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] >= cap * total[s]]
        if not over:
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * w[s] for s in open_}
    key = []
    for r in rows:
        t = r[1] or ""
        clean = len(re.sub(mixing.JUNK_CLASS, "", t)) / len(t) if t else None
        q = 1.0 if clean is None else 0.1 + 0.9 * clean * clean
        name = str(r[0]) if r[0] is not None else "" if r[1] is None else hashlib.md5(t.encode()).hexdigest()
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        key.append(-math.log(u) / q)
    return size, total, target, key


def check(rows, got):
    size, total, target, key = plain(rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter(
        (r[0], n, total[r[3]], round(float(target[r[3]]), 6)) for r, n in zip(rows, size))
    copies_of = defaultdict(list)
    for r in sorted(got, key=lambda r: r["copies"]):
        copies_of[r["doc_id"], r["size"], r["source_size"]].append(r["copies"])
    for s in total:
        mine = sorted((k, i) for i, k in enumerate(key) if rows[i][3] == s)
        epochs = int(target[s] // total[s]) if total[s] else 0
        copies = [(size[i], copies_of[rows[i][0], size[i], total[s]].pop()) for _, i in mine]  # of equal rows the most first
        sized = [c for n, c in copies if n]
        assert set(sized) <= {epochs, epochs + 1} and sized == sorted(sized, reverse=True)  # a prefix in key order
        largest = max((size[i] for _, i in mine), default=0)
        assert abs(sum(n * c for n, c in copies) - target[s]) <= largest / 2 + 1e-6
    assert all(r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] for r in got)


def test_one_repeated_document_is_split(spark):
    rows = [(7, "w " * 20, "en", "b", 1)] * 300 + [(k, "v " * 50, "en", "a", 1) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    check(rows, mixing.mix(df).collect())
    path = scratch(spark, "repeated")
    df.write.parquet(path)  # a table gives its rows in one order
    per = mixing.mixed(spark.read.parquet(path)).groupBy("source").count().collect()
    targets = {r["source_size"]: r["target"] for r in mixing.mix(df).collect()}
    assert all(abs(r["count"] - (targets[2000] / 50 if r["source"] == "a" else targets[6000] / 20)) <= 0.5 for r in per) and len(per) == 2


@pytest.mark.parametrize("buckets", [1, 4096])
def test_awkward_rows_against_plain_sampling(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    check(awkward_rows(), mixing.mix(awkward(spark, ("size", "key", "bucket", "copies"))).collect())


def test_given_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    a = mixing.mix(docs).collect()
    check(rows, a)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(mixing.mix(docs.repartition(7)).collect()) == Counter(a)


def test_mixed_rows_are_as_many_as_copies(spark):
    df = awkward(spark, ("copies", "last", "end"))
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["copies"]
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert Counter(r["doc_id"] for r in got.collect()) == +want


def test_hot_source_and_no_python(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 7) AS text", "if(id % 3 < 2, 'hot', 's' || id % 50) AS source")
    got = mixing.mix(docs)
    per = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 4 for r in per)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left = 1.5 * 1520 - 20 - 20
    assert got["a"] == 20 and got["c"] == 20 and got["d"] == 0  # weights a 3, b 1, c 2, d 3, null 1
    assert math.isclose(got["b"], left - 1000) and math.isclose(got[None], 1000)


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
