"""All queries of the engine; importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixtura.plans import aggregate_plans, canonical_plans, last_plans, link_plans, model_plans, more_plans, temporal_plans  # noqa: F401
from fixtura.plans.registry import ORACLES, queries
from fixtura.plans.views import Tables

__all__ = ["flagship", "oracle_sql", "queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to the canonical table: scan, typed parse, triage, interval names, dedup, shootouts, score scope."""
    return canonical_plans.canonical_table(Tables(spark, sf_dir))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
