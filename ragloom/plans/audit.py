"""Physical plans of everything a query runs, also of what it materialises on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def captured_plans(spark: SparkSession) -> Iterator[list[str]]:
    """Collect the plan of every DataFrame that is checkpointed inside the block, before it runs."""
    plans: list[str] = []
    kind = type(spark.range(0))
    original = kind.checkpoint

    def checkpoint(self: DataFrame, *args, **kwargs) -> DataFrame:
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return original(self, *args, **kwargs)

    kind.checkpoint = checkpoint
    try:
        yield plans
    finally:
        kind.checkpoint = original


def query_plans(spark: SparkSession, query: Callable[[SparkSession, str], DataFrame], sf_dir: str) -> list[str]:
    """Plans of the materialised steps of a query, in order, and of its result; adaptive execution as the session has it."""
    with captured_plans(spark) as plans:
        result = query(spark, sf_dir)
    return [*plans, result._jdf.queryExecution().executedPlan().toString()]
