from collections import Counter

import pytest
from pyspark.sql import functions as F

from ragloom.llm import sharding
from ragloom.llm.common import scratch
from ragloom.llm.oracles import _turns
from tests.llm.helpers import awkward, awkward_rows, empty


@pytest.mark.parametrize("n,size", [(1, 2), (3, 7), (5, 101), (16, 1009)])
def test_table_against_its_definition(n, size):
    names = [f"n{k}" for k in range(n)]
    got = sharding.lookup_table(names, size)
    assert got == _turns(names, size)
    share = Counter(got)
    assert max(share.values()) - min(share.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = [f"n{k}" for k in range(20)]
    a, b = sharding.lookup_table(names, 4099), sharding.lookup_table(names[:-1], 4099)
    kept = sum(x == y for x, y in zip(a, b) if x != 19) / sum(x != 19 for x in a)
    assert kept > 0.9


def test_refusals():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 3)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, size)


def test_awkward_rows(spark):
    got = sharding.place_documents(awkward(spark, ("slot", "shard", "key")), shards=7, size=101)
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in awkward_rows())
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(7)], 101)
    assert all(r["shard"] == table[r["slot"]] for r in rows)
    assert len({r["slot"] for r in rows if r["doc_id"] == 5}) == 1
    assert sharding.place_documents(empty(spark)).count() == 0


def test_files_hold_what_the_table_says(spark):
    path = scratch(spark, "shards")
    df = awkward(spark, ("shard",))
    names = ["a", "b", "c"]
    sharding.write_shards(df, path, F.col("doc_id").cast("string"), names, 101)
    back = spark.read.parquet(path)
    again = sharding.with_shard(back, F.col("doc_id").cast("string"), names, 101, "at")
    assert back.count() == df.count() and again.where("__shard_name <> at.name").count() == 0 and "shard" in back.columns
