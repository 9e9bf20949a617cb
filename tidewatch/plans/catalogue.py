"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import general, reports, reviews

_MODULES = (reviews, general, reports)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.flagship(spark, sf_dir)
