"""Sequential ratings: every match reads and writes the state of two teams, in the order (date, source_row).

The fold is the one operator here that can't be cut by team. It can be cut by connected component of the fixture
graph, whose components share no state; and a single component is one ordered pass that keeps a number per team,
streamed in Arrow batches and in stretches, so a task's memory is bounded by teams and a stretch, not by all matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.parse import first_rule
from fixtura.shared import scratch_path, settle

#: Importance multipliers by part of the tournament's name, first match wins (fixed values).
IMPORTANCE = (
    ("fifa world cup qualification", 1.25),
    ("fifa world cup", 2.0),
    ("qualification", 1.25),
    ("friendly", 0.5),
    ("uefa euro", 1.5),
    ("copa américa", 1.5),
    ("africa cup of nations", 1.5),
    ("african cup of nations", 1.5),
    ("afc asian cup", 1.5),
    ("gold cup", 1.5),
    ("confederations cup", 1.5),
)


@dataclass(frozen=True)
class EloSettings:
    initial: float = 1500.0
    scale: float = 400.0
    k: float = 20.0
    home_advantage: float = 60.0
    importance: tuple[tuple[str, float], ...] = IMPORTANCE
    default_importance: float = 1.0
    goal_difference: bool = True
    shootout_credit: float = 0.0
    recorded_fallback: bool = True


def importance(tournament: Column, settings: EloSettings = EloSettings()) -> Column:
    return first_rule(tournament, settings.importance, settings.default_importance)


def margin_multiplier(difference: Column, used: bool = True) -> Column:
    gd = F.abs(difference)
    return F.when(gd <= 1, 1.0).when(gd == 2, 1.5).otherwise((11.0 + gd) / 8.0) if used else F.lit(1.0)


def actual_score(outcome: Column, home: Column, away: Column, settings: EloSettings = EloSettings(), shootout_home: Column | None = None) -> Column:
    """The home side's result in [0, 1]; an unknown outcome falls back to the recorded score or to null."""
    recorded = F.when(home > away, 1.0).when(home < away, 0.0).when(home == away, 0.5)
    base = F.when(outcome == "home_win", 1.0).when(outcome == "draw", 0.5).when(outcome == "away_win", 0.0)
    base = base.otherwise(recorded) if settings.recorded_fallback else base
    if shootout_home is None or not settings.shootout_credit:
        return base
    return F.when((base == 0.5) & shootout_home.isNotNull(), F.when(shootout_home, 0.5 + settings.shootout_credit).otherwise(0.5 - settings.shootout_credit)).otherwise(base)


def expectation(own: Column, other: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(own - other) / scale))


def rating_steps(matches: DataFrame, settings: EloSettings = EloSettings()) -> DataFrame:
    """What a match contributes, computed in columns: everything but the state."""
    home, away = F.col("home_score"), F.col("away_score")
    bonus = F.when(F.coalesce("neutral", F.lit(False)), 0.0).otherwise(settings.home_advantage)
    weight = settings.k * importance(F.col("tournament"), settings) * margin_multiplier(home - away, settings.goal_difference)
    rows = matches.where("status = 'played'").select("match_id", "date", "source_row", "home_team", "away_team", bonus.alias("bonus"), weight.alias("weight"), actual_score(F.col("outcome"), home, away, settings).alias("actual"))
    return rows.where("actual is not null")


TIMELINE = "match_id long, date date, source_row long, home_team string, away_team string, home_elo_pre double, away_elo_pre double, expected_home double, actual_home double, delta double, home_elo_post double, away_elo_post double"


def folded(settings: EloSettings, start: dict[str, float] | None = None):
    """The fold over ordered steps, from the ratings in start (a number per team)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = dict(start or {})
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                own, other = state.get(r.home_team, settings.initial), state.get(r.away_team, settings.initial)
                expected = 1 / (1 + 10 ** (-(own + r.bonus - other) / settings.scale))
                delta = r.weight * (r.actual - expected)
                state[r.home_team], state[r.away_team] = own + delta, other - delta
                rows.append((r.match_id, r.date, r.source_row, r.home_team, r.away_team, own, other, expected, r.actual, delta, own + delta, other - delta))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TIMELINE.split(", ")])

    return fold


#: Steps that one task sorts or folds at a time.
STRETCH = 1_000_000


def elo_timeline(matches: DataFrame, settings: EloSettings = EloSettings(), stretch: int = STRETCH) -> DataFrame:
    """One row per rated match with both sides' ratings before and after: a single ordered stream, in stretches.

    Steps are dealt by ranges of (date, source_row) of about `stretch` rows, sorted on all executors and written out. The
    fold then goes from range to range and carries a rating per team, so no task ever holds more than one range."""
    spark = matches.sparkSession
    steps = settle(rating_steps(matches, settings), "steps")
    count = steps.count()
    if count <= stretch:
        return steps.repartition(1).sortWithinPartitions("date", "source_row").mapInPandas(folded(settings), TIMELINE)
    dealt = steps.repartitionByRange(-(-count // stretch), "date", "source_row").withColumn("stretch_", F.spark_partition_id())
    path, out = scratch_path(spark, "stretches"), scratch_path(spark, "timeline")
    dealt.write.partitionBy("stretch_").parquet(path)
    parts = spark.read.schema(dealt.schema).parquet(path)
    last = lambda side: F.struct(F.col(f"{side}_team").alias("team"), F.col(f"{side}_elo_post").alias("rating"))
    state: dict[str, float] = {}
    numbers = sorted(r[0] for r in parts.select("stretch_").distinct().collect())  # a number per stretch
    for k in numbers:
        ordered = parts.where(F.col("stretch_") == k).drop("stretch_").repartition(1).sortWithinPartitions("date", "source_row")
        ordered.mapInPandas(folded(settings, state), TIMELINE).write.parquet(f"{out}/part={k}")
        done = spark.read.schema(TIMELINE).parquet(f"{out}/part={k}")
        sides = done.select("date", "source_row", F.explode(F.array(last("home"), last("away"))).alias("s"))
        ends = sides.groupBy("s.team").agg(F.max_by("s.rating", F.struct("date", "source_row")).alias("rating"))
        state |= {r["team"]: r["rating"] for r in ends.collect()}  # a row per team
    return spark.read.schema(TIMELINE).parquet(*[f"{out}/part={k}" for k in numbers])


def elo_by_component(matches: DataFrame, components: DataFrame, settings: EloSettings = EloSettings()) -> DataFrame:
    """The same timeline, one ordered pass per connected component of the fixture graph (team, component)."""
    steps = rating_steps(matches, settings).join(F.broadcast(components.withColumnRenamed("team", "home_team")), "home_team")

    def run(rows):
        return next(folded(settings)(iter([rows.sort_values(["date", "source_row"])])))

    return steps.groupBy("component").applyInPandas(run, TIMELINE)


def ratings_as_of(timeline: DataFrame, cutoff: Column) -> DataFrame:
    """Each team's rating after its last match strictly before the cutoff."""
    sides = F.explode(F.array(F.struct(F.col("home_team").alias("team"), F.col("home_elo_post").alias("rating")), F.struct(F.col("away_team").alias("team"), F.col("away_elo_post").alias("rating")))).alias("s")
    past = timeline.where(F.col("date") < cutoff).select("date", "source_row", sides)
    return past.groupBy("s.team").agg(F.max_by("s.rating", F.struct("date", "source_row")).alias("rating"))
