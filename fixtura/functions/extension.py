"""Extension points: what a deployment may plug in, as plain callables over DataFrames.

A goal model maps matches to two rate columns, a signal maps matches to (match_id, signal, p0, p1, p2), a metric is a
column over a forecast's row. Registering gives them names; nothing is evaluated before it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.operators import metrics

GoalModel = Callable[[DataFrame], tuple[Column, Column]]
Signal = Callable[[DataFrame], DataFrame]

METRICS: dict[str, Callable[[], Column]] = {"log_loss": metrics.log_loss, "brier": metrics.brier, "rps": metrics.rps, "accuracy": metrics.correct}
GOAL_MODELS: dict[str, GoalModel] = {"constant": lambda _: (F.lit(1.4), F.lit(1.0)), "strength": lambda _: (1.3 * F.exp(F.col("elo_diff") / 800), 1.3 * F.exp(-F.col("elo_diff") / 800))}
SIGNALS: dict[str, Signal] = {}


def evaluate(df: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The named metrics, each the mean of its column, in one aggregate."""
    return df.groupBy(*by).agg(*[F.avg(METRICS[n]()).alias(n) for n in names])


def with_rates(df: DataFrame, model: str) -> DataFrame:
    home, away = GOAL_MODELS[model](df)
    return df.withColumns({"home_rate": home, "away_rate": away})


def all_signals(matches: DataFrame, names: list[str]) -> DataFrame:
    """The named signals in long form; one that abstains on a match gives no row for it."""
    parts = [SIGNALS[n](matches).select("match_id", F.lit(n).alias("signal"), "p0", "p1", "p2") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
