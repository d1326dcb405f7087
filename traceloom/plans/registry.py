"""All queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.plans import compliance, documents, records

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.QUERIES["content_alignment"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return records.QUERIES | compliance.QUERIES | documents.QUERIES


def oracle_sql() -> dict[str, str]:
    return records.ORACLE | compliance.ORACLE | documents.ORACLE
