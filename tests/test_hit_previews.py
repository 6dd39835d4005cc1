"""Previews of retrieved chunks reach every benchmark item, whatever its id."""

import __spark_entry__ as E

from .conftest import SF_SMALL

IDS = [0, 39, 40, 57, 199, 1_000_003]


def test_items_of_any_id(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(30)
    texts = [r["text"][:200] for r in docs.where("length(text) > 200").limit(len(IDS) - 1).collect()] + ["123"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(zip(IDS, texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = E.queries()["hit_previews"](spark, str(tmp_path))
    assert {r["item_id"] for r in got.select("item_id").distinct().collect()} == set(IDS)
    hits = E.queries()["retrieval_hits"](spark, str(tmp_path))
    assert got.select("item_id", "chunk_id").exceptAll(hits.select("qid", "chunk_id")).count() == 0 and got.count() == hits.count()
