"""Registered queries: a name, what builds it over Tables, and the SQL that checks it (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.plans.views import Tables, oracle_text

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        assert name not in BUILDERS, name
        BUILDERS[name] = build
        if oracle:
            ORACLES[name] = oracle_text(oracle)
        return build

    return add


def dated(df: DataFrame) -> DataFrame:
    """df with its dates as ISO text: engines hand dates to their clients as different types."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir))) for name, build in BUILDERS.items()}
