"""The query catalogue: name -> DataFrame builder, name -> SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.plans import decision_queries, flow_queries, more_queries, rule_queries, state_queries, stream_queries  # noqa: F401  they register their queries
from flowloom.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_queries.flow_order_etl(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
