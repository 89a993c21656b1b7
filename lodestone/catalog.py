"""Name -> query and SQL for the audit and analytics operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import analytics, audit, structured, verdicts

ALL = audit.QUERIES | analytics.QUERIES | structured.QUERIES | verdicts.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.promotion_tiers(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
