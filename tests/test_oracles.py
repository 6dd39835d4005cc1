"""Every registered query with an oracle equals its DuckDB statement (sf0.001)."""

import os

import pytest

import __spark_entry__ as E
from ragloom.plans.oracle import compare, duck

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, ns, nd, detail = compare(E.queries()[name](spark, SF_SMALL), con, ORACLES[name])
    assert ok, detail


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables absent")
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "neighbour_id" in df.columns


def test_every_query_is_registered_with_docs():
    for name, fn in E.queries().items():
        assert fn.__doc__, name


ROWS_ONLY = {"chunks_recursive", "intent_model_report", "intent_top_probabilities",
             "route_with_model", "ivf_probe_recall", "ivf_chunk_recall"}


def test_rows_only_set_is_pinned():
    """Every query of the catalogue has an oracle except the documented non-SQL ones."""
    from ragloom.plans import catalog
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(E.queries())
