"""Bounded what-if overlays on a bracket, and comparisons of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.functions.probs import clamp


def tag_nudges(fixtures: DataFrame, tags: DataFrame, cap: float = 6.0) -> DataFrame:
    """Per (team, match_number) of fixtures: the points of the team's tags earned in strictly earlier matches, clamped."""
    met = fixtures.select("team", "match_number").join(tags.select("team", F.col("match_number").alias("earned"), "points"), "team", "left")
    total = F.sum(F.when(F.col("earned") < F.col("match_number"), F.col("points")).otherwise(0.0))
    return met.groupBy("team", "match_number").agg(clamp(total, -cap, cap).alias("nudge"))


def expert_rows(pairings: DataFrame, nudges: DataFrame, cap: float = 15.0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """pairings (match_number, team_a, team_b, baseline) moved by the difference of the sides' nudges in percentage
    points, at most by cap, into [low, high]."""
    side = lambda s: nudges.select("match_number", F.col("team").alias(f"team_{s}"), F.col("nudge").alias(f"nudge_{s}"))
    met = pairings.join(side("a"), ["match_number", "team_a"], "left").join(side("b"), ["match_number", "team_b"], "left")
    delta = clamp(F.coalesce("nudge_a", F.lit(0.0)) - F.coalesce("nudge_b", F.lit(0.0)), -cap, cap)
    p = clamp(F.col("baseline") + delta / 100, low, high)
    return met.select("match_number", "team_a", "team_b", "baseline", delta.alias("delta"), p.alias("p_a"))


def adjust_pairs(pairs: DataFrame, adjustments: DataFrame, team_cap: float = 10.0, net_cap: float = 15.0, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """pairs (match, team_a, team_b, p) moved by opinions (team, points): capped per team, then net, then clipped."""
    capped = adjustments.groupBy("team").agg(clamp(F.sum("points"), -team_cap, team_cap).alias("points"))
    side = lambda s: capped.select(F.col("team").alias(f"team_{s}"), F.col("points").alias(f"points_{s}"))
    met = pairs.join(F.broadcast(side("a")), "team_a", "left").join(F.broadcast(side("b")), "team_b", "left")  # a row per team
    net = clamp(F.coalesce("points_a", F.lit(0.0)) - F.coalesce("points_b", F.lit(0.0)), -net_cap, net_cap)
    return met.select(*pairs.columns, net.alias("net"), clamp(F.col("p") + net / 100, low, high).alias("p_adjusted"))


def walk(first: DataFrame, chances: DataFrame, results: DataFrame, rounds: int) -> DataFrame:
    """A deterministic bracket: first (match, team_a, team_b), matches 2k and 2k+1 feeding match k of the next round;
    a confirmed result (round, match, winner) overrides the more likely side. A join a round."""
    ties, out = first, None
    for r in range(1, rounds + 1):
        p = chances.select(F.col("a").alias("team_a"), F.col("b").alias("team_b"), "p")
        known = results.where(F.col("round") == r).select("match", F.col("winner").alias("confirmed"))
        met = ties.join(p, ["team_a", "team_b"], "left").join(known, "match", "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
        winner = F.coalesce("confirmed", F.when(F.col("p") >= 0.5, F.col("team_a")).otherwise(F.col("team_b")))
        played = met.select(F.lit(r).alias("round"), "match", "team_a", "team_b", "p", winner.alias("winner"), F.col("confirmed").isNotNull().alias("is_confirmed"))
        out = played if out is None else out.unionByName(played)
        half = played.select(F.floor(F.col("match") / 2).alias("match"), (F.col("match") % 2).alias("side"), "winner")
        ties = half.groupBy("match").agg(F.max(F.when(F.col("side") == 0, F.col("winner"))).alias("team_a"), F.max(F.when(F.col("side") == 1, F.col("winner"))).alias("team_b"))
    return out


def compare(runs: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per key in any run: each run's value, and its difference from the first run's."""
    names = list(runs)
    out = None
    for name, df in runs.items():
        side = df.select(key, F.col(value).alias(name))
        out = side if out is None else out.join(side, key, "full_outer")
    return out.select(key, *names, *[(F.col(n) - F.col(names[0])).alias(f"delta_{n}") for n in names[1:]])


def flips(compared: DataFrame, before: str, after: str) -> DataFrame:
    """Rows where the favourite changes."""
    return compared.where((F.col(before) >= 0.5) != (F.col(after) >= 0.5))


def biggest_movers(compared: DataFrame, key: str, columns: list[str], top: int) -> DataFrame:
    """The top changes by size over all columns, ties by name."""
    long = compared.unpivot([key], columns, "measure", "change").where("change is not null")
    return long.orderBy(F.desc(F.abs(F.round("change", 9))), key, "measure").limit(top)
