"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findgrain.plans import data_queries, data_sql, health_queries, health_sql, search_queries, search_sql, window_queries, window_sql


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return search_queries.search_batch_topk(spark, sf)


def queries() -> dict:
    return search_queries.queries() | health_queries.queries() | window_queries.queries() | data_queries.queries()


def oracle_sql() -> dict[str, str]:
    return search_sql.oracle_sql() | health_sql.oracle_sql() | window_sql.oracle_sql() | data_sql.oracle_sql()
