"""The inverted-file index against the full scan."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import knn
from ragloom.session import scratch_path
from ragloom.sources import ivf_index

SCHEMA = "chunk_id long, embedding array<float>"


def table(spark, n, dims=16, groups=12, seed=1, hot=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims)) * 3
    rows = [(k, [float(x) for x in centres[k % groups] + r.normal(size=dims)]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(hot)]  # many copies of one vector
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def index_of(spark, df, **options):
    root = scratch_path(spark, f"ivf-{uuid.uuid4().hex}")
    ivf_index.build(df, root, **options)
    return ivf_index.IvfIndex(spark, root, options.get("metric", "l2"))


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_probes_recall_and_exact_search(spark, metric):
    df = table(spark, 1500, hot=400)
    index = index_of(spark, df, lists=30, metric=metric)
    assert index.rows.sum() == 1900
    asked = df.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid")
    want = knn.knn_join(asked, df, k=10, metric=metric)
    probed, exact = index.search(asked, 10, probes=4), index.search(asked, 10, probes=4, exact=True)
    assert rows(exact) == rows(want)
    hit = {r[:1] + r[2:3] for r in rows(want)} & {r[:1] + r[2:3] for r in rows(probed)}
    assert len(hit) / want.count() >= 0.9


def test_scans_read_the_probed_folders_only(spark):
    df = table(spark, 600)
    index = index_of(spark, df, lists=10)
    names = [int(n) for n in index.lists[:3]]
    some = index.vectors(names)
    assert "PartitionFilters: [list" in some._jdf.queryExecution().toString()
    assert some.count() == index.rows[:3].sum() < 600
    assert some.select(F.input_file_name()).distinct().count() <= 3 < index.vectors().select(F.input_file_name()).distinct().count()
    work = index.work(df.where("chunk_id = 5"), 2, "chunk_id").first()
    assert work["lists"] == 2 and work["rows"] < 600


def test_both_strategies_give_the_same_rows(spark, monkeypatch):
    df = table(spark, 400, hot=200)
    monkeypatch.setattr(ivf_index, "FILE_ROWS", 50)
    index = index_of(spark, df, lists=8)
    asked = df.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "qid")
    want = [rows(index.search(asked, 5, probes=2, exact=e, exclude_self=True)) for e in (False, True)]
    monkeypatch.setattr(knn, "BROADCAST_MAX_ROWS", 1)
    assert [rows(index.search(asked, 5, probes=2, exact=e, exclude_self=True)) for e in (False, True)] == want
    assert want[1] == rows(knn.knn_join(asked, df, k=5, exclude_self=True, strategy="blocks"))


def test_zero_and_missing_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [-1.0, 0.5])], SCHEMA)
    index = index_of(spark, df, lists=3, metric="cosine")
    fine = df.where("size(embedding) > 0")
    asked = spark.createDataFrame([(10, [0.0, 0.0]), (11, [1.0, 0.1]), (12, None)], "qid long, embedding array<double>")
    got = index.search(asked, 3, probes=1, exact=True)
    assert rows(got) == rows(knn.knn_join(asked.where("size(embedding) > 0"), fine, k=3, metric="cosine"))


def test_empty(spark):
    index = index_of(spark, spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>")
    assert index.search(asked).count() == 0 and index.search(asked, exact=True).count() == 0
    index = index_of(spark, table(spark, 30))
    assert index.search(asked.where("false")).count() == 0


@pytest.mark.parametrize("name", ["ivf_probe_recall", "ivf_chunk_recall"])
def test_calibrated_probes_reach_recall(spark, name):
    import __spark_entry__ as E
    got = E.queries()[name](spark, "/root/testdata/sf0.01").agg(F.sum("found"), F.sum("hits"), F.max("share")).first()
    assert got[0] >= 0.9 * got[1] and got[2] < 1


def test_places_come_without_vectors_and_pieces_are_bounded(spark):
    import pandas as pd
    import numpy as np
    index = ivf_index.IvfIndex.__new__(ivf_index.IvfIndex)
    index.spark, index.metric = spark, "l2"
    index.centroids, index.lists = np.arange(5000.0)[:, None], np.arange(5000)
    asked = spark.createDataFrame([(7, [3.2]), (8, [4999.0])], "qid long, vec array<double>").coalesce(1)
    placed = index._probes(asked, 5000, place=True)
    assert placed.columns == ["qid", "list", "place"]  # a vector for every list of every question before
    near = placed.where("place < 2").orderBy("qid", "place").collect()
    assert [(r["qid"], r["list"]) for r in near] == [(7, 3), (7, 4), (8, 4999), (8, 4998)]
    assert index._probes(asked, 3).count() == 6
    big = pd.DataFrame({"x": range(2 * ivf_index.PIECE_ROWS + 1)})
    assert [len(b) for b in ivf_index._pieces([big])] == [ivf_index.PIECE_ROWS] * 2 + [1]
