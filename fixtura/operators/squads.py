"""Squad features of teams and what they change in expected goals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.probs import clamp
from fixtura.operators import aggregates
from fixtura.operators.ranking import filled_zscores
from fixtura.shared import small


def importance_weighted(df: DataFrame, key: str, value: str, kind: str, weights: dict[str, float]) -> DataFrame:
    """key and mean of value weighted by the kind of each row; an unknown kind weighs as `other`."""
    table = small(df.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items() if k != "other"], f"{kind} string, w double"))
    rows = df.select(key, value, kind).join(table, kind, "left").withColumn("w", F.coalesce("w", F.lit(float(weights["other"]))))
    return rows.groupBy(key).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def position_group(position: Column, groups: Sequence[tuple[str, Sequence[str]]] = (("goalkeeper", ("goalkeeper", "keeper")), ("defender", ("back", "defend")), ("midfielder", ("midfield",)), ("forward", ("forward", "winger", "striker", "attack")))) -> Column:
    """The first group one of whose parts the lower-cased position contains."""
    word, value = F.lower(position), F.lit("unknown")
    for name, parts in reversed(groups):
        hit = F.lit(False)
        for p in parts:
            hit = hit | word.contains(p)
        value = F.when(hit, name).otherwise(value)
    return value


def team_features(activity: DataFrame, valuations: DataFrame, windows: Sequence[int] = (30, 90, 180, 365), stale_days: int = 365) -> DataFrame:
    """One row per team from its players' activity (team, player_id, position, local, identified, minutes_<d>d,
    starts_<d>d, days_since_last) and valuations (team, player_id, value, age_days). One shuffle by team for each
    input; what a sum of nothing knows stays null."""
    minutes = F.col("minutes_90d")
    share = lambda c: F.avg(c.cast("double"))
    cells = [share(F.col("identified")).alias("identity_coverage"), share(F.col("local")).alias("local_activity_coverage"), F.count(minutes).alias("recently_active_90d"), F.count_if(minutes.isNull()).alias("inactive_90d"), F.median("days_since_last").alias("days_since_last_median"), F.max("days_since_last").alias("days_since_last_max")]
    for d in windows:
        m = F.col(f"minutes_{d}d")
        cells += [share(m.isNotNull()).alias(f"minutes_{d}d_coverage"), F.sum(m).alias(f"minutes_{d}d_total"), F.median(m).alias(f"minutes_{d}d_median"), F.sum(f"starts_{d}d").alias(f"starts_{d}d_total")]
    teams = activity.groupBy("team").agg(*cells)
    places = activity.groupBy("team", "position").agg(share(F.col("local")).alias("local"), F.sum(minutes).alias("m"), share(minutes.isNotNull()).alias("active"))
    of = lambda p, c: F.max(F.when(F.col("position") == p, F.col(c)))
    zero = F.lit(0.0)
    wide = places.groupBy("team").agg(
        F.min("local").alias("minimum_position_local_coverage"),
        F.coalesce(of("goalkeeper", "local"), zero).alias("goalkeeper_local_coverage"),
        *[x for p in ("goalkeeper", "defender", "midfielder", "forward") for x in (of(p, "m").alias(f"{p}_minutes_90d"), F.coalesce(of(p, "active"), zero).alias(f"{p}_active_90d"))],
    )
    depth = aggregates.ranked_sums(activity, "team", "minutes_90d", {"top_11_minutes_90d": (1, 11), "top_15_minutes_90d": (1, 15), "top_23_minutes_90d": (1, 23), "next_4_minutes_90d": (12, 15), "remaining_after_15_minutes_90d": (16, 1 << 30)})
    valued = valuations.join(activity.select("team", "player_id", "minutes_90d"), ["team", "player_id"], "left").groupBy("team").agg(
        share(F.col("value").isNotNull()).alias("valuation_coverage"),
        F.sum("value").alias("valuation_total"),
        F.median("value").alias("valuation_median"),
        F.median("age_days").alias("valuation_median_age_days"),
        share(F.coalesce(F.col("age_days") > stale_days, F.lit(False))).alias("stale_valuation_proportion"),
        aggregates.weighted_mean("value", "minutes_90d").alias("valuation_minutes_weighted"),
        *[aggregates.top_sum("value", k).alias(f"valuation_top_{k}") for k in (11, 15, 23)],
    )
    return teams.join(wide, "team", "left").join(depth, "team", "left").join(valued, "team", "left")


#: Components of the squad score and the features whose z-scores they average (fixed lists of the product).
COMPONENTS = {
    "activity": ["minutes_30d_coverage", "minutes_90d_coverage", "minutes_180d_coverage", "minutes_90d_total", "recently_active_90d"],
    "starts": ["starts_30d_total", "starts_90d_total", "starts_180d_total"],
    "valuation": ["valuation_total", "valuation_median", "valuation_minutes_weighted", "valuation_top_15"],
    "positional": ["defender_minutes_90d", "midfielder_minutes_90d", "forward_minutes_90d", "minimum_position_local_coverage"],
    "goalkeeper": ["goalkeeper_minutes_90d", "goalkeeper_active_90d", "goalkeeper_local_coverage"],
    "depth": ["top_11_minutes_90d", "top_15_minutes_90d", "top_23_minutes_90d", "next_4_minutes_90d"],
}


def score_teams(features: DataFrame, weights: dict[str, float], thresholds: dict[str, float], most_missing: float = 0.6, clip: float = 2.0, strength: float = 0.05, most_adjustment: float = 0.10) -> DataFrame:
    """features with component scores, the coverage rule, and a bounded log-goal adjustment shrunk by how well a team
    is covered. A team under a threshold falls back to no adjustment."""
    columns = sorted({c for cs in COMPONENTS.values() for c in cs})
    rows = filled_zscores(features, columns)
    rows = rows.withColumns({f"score_{name}": sum((F.col(f"z_{c}") for c in cs[1:]), F.col(f"z_{cs[0]}")) / len(cs) for name, cs in COMPONENTS.items()})
    full = sum((F.col(f"score_{n}") * w for n, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    cover = list(thresholds)
    missing = 1 - F.least(*cover)
    eligible = F.lit(True)
    for c, least in thresholds.items():
        eligible = eligible & (F.col(c) >= least)
    eligible = F.coalesce(eligible & (missing <= most_missing), F.lit(False))
    ratios = [clamp(F.col(c) / least, 0.0, 1.0) for c, least in thresholds.items()] + [1 - clamp(F.col("stale_valuation_proportion"), 0.0, 1.0)]
    confidence = sum(ratios[1:], ratios[0]) / len(ratios)
    rows = rows.withColumns({"score_full": full, "coverage_eligible": eligible, "coverage_confidence": F.when(eligible, confidence).otherwise(0.0)})
    shrunk = clamp(F.col("score_full"), -clip, clip) * F.col("coverage_confidence")
    rows = rows.withColumn("score_shrunk", shrunk)
    return rows.withColumns({"log_goal_adjustment": clamp(F.col("score_shrunk") * strength, -most_adjustment, most_adjustment), "fallback_used": ~F.col("coverage_eligible")})


def adjusted_rates(home: Column, away: Column, home_adjustment: Column, away_adjustment: Column) -> tuple[Column, Column]:
    """Goal rates moved by half the difference of the adjustments each."""
    half = (home_adjustment - away_adjustment) / 2
    return home * F.exp(half), away * F.exp(-half)
