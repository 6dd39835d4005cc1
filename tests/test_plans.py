"""Physical-plan guards: no cartesian products, partial top-k, pruned scans."""

import os
import re

import pytest

import __spark_entry__ as E
from ragloom.plans.audit import query_plans

from .conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables absent")

BATCH = [n for n in E.queries() if not n.startswith("stream_")]


def _plan(spark, name):
    """All plans of a query as one text, those of materialised steps before they ran included (AQE on)."""
    return "\n".join(query_plans(spark, E.queries()[name], SF_SMALL))


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), plan


@pytest.mark.parametrize("name", ["tfidf_keywords", "keyword_join"])
def test_top_k_is_partial_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_scans_are_pruned(spark):
    plan = _plan(spark, "clean_documents")
    schema = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schema and all("lang" not in s and "n_chars" not in s for s in schema)
    plan = _plan(spark, "latency_profile")
    assert all(s == "struct<event_type:string,value:double>" for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan))


def test_fixed_window_limit_ranks_inside_client_and_window(spark):
    plan = _plan(spark, "rate_limit_fixed")
    assert "Join" not in plan
    assert "window_start" in plan[plan.index("Exchange hashpartitioning"):][:160]


def test_audit_sees_the_plan_behind_a_checkpoint(spark):
    plans = query_plans(spark, E.queries()["knn_top10"], SF_SMALL)
    assert len(plans) > 1 and any("MapInPandas" in p or "FlatMapCoGroups" in p for p in plans[:-1])
