"""Scoring of frozen forecasts against results, and what a forecast payload holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.operators import metrics, models

OUTCOMES = ("home_win", "draw", "away_win")


def scoreline_rank(scorelines: Column, home: Column, away: Column) -> Column:
    """Place of the score in an array of (home, away, p), from 1; null if it isn't there."""
    place = F.array_position(F.transform(scorelines, lambda s: F.concat_ws("-", s["home"], s["away"])), F.concat_ws("-", home, away))
    return F.when(place > 0, place)


def score_forecasts(df: DataFrame) -> DataFrame:
    """Forecasts (p0..p2, home_rate, away_rate, scorelines) beside results (home_goals, away_goals) with every measure of
    a single forecast."""
    h, a = F.col("home_goals"), F.col("away_goals")
    label = F.when(h > a, 0).when(h == a, 1).otherwise(2)
    rows = df.withColumn("label", label)
    rank = scoreline_rank(F.col("scorelines"), h, a)
    named = lambda k: F.get(F.array(*map(F.lit, OUTCOMES)), k)
    best = F.get("scorelines", F.lit(0))
    return rows.withColumns(
        {
            "actual_outcome": named(F.col("label")),
            "predicted_outcome": named(metrics.predicted()),
            "probability_of_actual": metrics.of_label(),
            "log_loss": -F.log(F.greatest(metrics.of_label(), F.lit(1e-12))),
            "brier": metrics.brier(),
            "rps": metrics.rps(),
            "outcome_correct": metrics.correct() == 1,
            "home_goal_error": F.abs(F.col("home_rate") - h),
            "away_goal_error": F.abs(F.col("away_rate") - a),
            "total_goal_error": F.abs(F.col("home_rate") + F.col("away_rate") - h - a),
            "scoreline_rank": rank,
            "stored_probability": F.get(F.transform("scorelines", lambda s: s["p"]), (rank - 1).cast("int")),
            "top_scoreline": F.concat_ws("-", best["home"], best["away"]),
            "exact_score": F.coalesce(rank == 1, F.lit(False)),
            "in_top_3": F.coalesce(rank <= 3, F.lit(False)),
        }
    )


def reconstructed(df: DataFrame, beta: Sequence[float], rho: float = 0.0, top: int = 5, most: int = 12, places: int = 4) -> DataFrame:
    """The chance of the actual score (home_goals, away_goals) where a forecast didn't keep it: from the score matrix that
    a rebuilt goal model (beta, rho) makes of the forecast's features (elo_diff, home_adv), accepted only if the model
    gives all that was stored again, to its places: home_rate, away_rate, and scorelines as its `top` likeliest in
    order. Else null. `reconstruction` says which."""
    home, away = models.expected_goals(beta, F.col("elo_diff"), F.col("home_adv"))
    made = models.likely_scores(df.withColumns({"new_home_rate": home, "new_away_rate": away}), home, away, [*df.columns, "new_home_rate", "new_away_rate"], top, most, rho, ("home_goals", "away_goals"))
    same = lambda a, b: F.coalesce(F.round(a, places) == F.round(b, places), F.lit(False))
    rates = same("new_home_rate", "home_rate") & same("new_away_rate", "away_rate")
    new = F.transform("scores", lambda s: F.struct(s["h"].alias("home"), s["a"].alias("away"), s["p"].alias("p")))
    lines = F.coalesce(rounded_lines(new, places) == rounded_lines(F.col("scorelines"), places), F.lit(False))
    why = F.when(~rates, "rates_differ").when(~lines, "scorelines_differ").when(F.col("p_actual").isNull(), "outside_grid").otherwise("validated_reconstruction")
    return made.select(*df.columns, why.alias("reconstruction"), F.when(rates & lines, F.col("p_actual")).alias("probability"))


#: What every payload says of its forecast.
LIMITATIONS = (
    "kickoff date known but not time; probabilities are regulation-time (90-minute) outcomes",
    "features limited to pre-match Elo and venue context",
)


def rounded_lines(scorelines: Column, places: int = 4) -> Column:
    return F.transform(scorelines, lambda s: F.struct(s["away"].alias("away"), s["home"].alias("home"), F.round(s["p"], places).alias("p")))


def payload(fixture: Column, match: Mapping[str, Column], p: Sequence[str], rates: Sequence[str], scorelines: str, markets: Mapping[str, Column], model: Mapping[str, Column], revision: Mapping[str, Column] | None = None, places: int = 4) -> Column:
    """The whole forecast of a fixture as JSON, keys in order, nulls kept. match has home_team, away_team, tournament and
    date; model has what the forecast was made with: data_cutoff, dataset_version, model_version. Probabilities, rates,
    scorelines and markets are rounded; revision adds fields or replaces them."""
    r = lambda c: F.round(c, places)
    fields = {
        "fixture_id": fixture,
        **{c: match[c] for c in ("home_team", "away_team", "tournament")},
        "kickoff_timestamp": F.date_format(match["date"], "yyyy-MM-dd"),
        "kickoff_time_known": F.lit(False),
        "data_cutoff": F.date_format(model["data_cutoff"], "yyyy-MM-dd"),
        **{c: model[c] for c in ("dataset_version", "model_version")},
        "home_expected_goals": r(F.col(rates[0])),
        "away_expected_goals": r(F.col(rates[1])),
        **{f"{c}_probability": r(F.col(x)) for c, x in zip(("home_win", "draw", "away_win"), p, strict=True)},
        "top_scorelines": rounded_lines(F.col(scorelines), places),
        "markets": F.struct(*[r(markets[m]).alias(m) for m in sorted(markets)]),
        "limitations": F.array(*map(F.lit, LIMITATIONS)),
        **(revision or {}),
    }
    return F.to_json(F.struct(*[fields[c].alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
