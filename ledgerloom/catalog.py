"""All queries of the library by name, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import document_queries, finding_queries, gate_queries, range_queries, register_queries, text_queries  # noqa: F401  (they register their queries)
from ledgerloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run cost, by stage, and what is unpriced."""
    return QUERIES["a7_a9_stage_cost"](spark, sf_dir)
