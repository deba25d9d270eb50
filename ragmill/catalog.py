"""All registered queries of the library and their oracles, by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragmill.plans import change_data, chunking, curation, governance, monitoring, pipelines, retrieval
from ragmill.sources.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]
_MODULES: list = [curation, chunking, retrieval, change_data, governance, monitoring, pipelines]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.i4(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in _MODULES for name, sql in m.ORACLES.items()}
