"""All queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caresift.plans import adt_queries, fhir_queries, history_queries, late_queries, stream_queries, v2_queries

_MODULES = (v2_queries, fhir_queries, adt_queries, history_queries, late_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v2_queries.losses_by_pattern(spark, sf_dir)
