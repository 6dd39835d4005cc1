"""Results do not depend on how the input is partitioned."""

import os

import pytest

import __spark_entry__ as E
from ragloom.plans.oracle import norm

from .conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables absent")


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["rate_limit_moving", "concurrency_profile", "tfidf_keywords",
                                  "conversation_history", "retrieval_hits"])
def test_independent_of_shuffle_partitions(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _rows(E.queries()[name](spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = _rows(E.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
