"""Grouped summaries: coverage, windows of activity, top-k sums, modes, grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def release_summary(releases: DataFrame) -> DataFrame:
    return releases.groupBy("release_date").agg(F.count_distinct("team").alias("teams"), F.min_by("team", "source_row").alias("first_team"), F.max("points").alias("top_points"), F.min("points").alias("least_points"))


def name_collisions(df: DataFrame, name: str, key: Column) -> DataFrame:
    """Normalised names that stand for more than one raw name."""
    return df.select(key.alias("key"), F.col(name).alias("raw")).distinct().groupBy("key").agg(F.count("*").alias("raw_names")).where("raw_names > 1")


def top_sum(values: str, k: int) -> Column:
    """Sum of the k largest values of a group; null for none. Groups are teams: a list per group is bounded by a squad."""
    largest = F.slice(F.sort_array(F.collect_list(values), asc=False), 1, k)
    return F.when(F.size(largest) > 0, F.aggregate(largest, F.lit(0.0), lambda s, x: s + x.cast("double")))


def ranked_sums(df: DataFrame, group: str, value: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Per group, the sums over spans of ranks (first..last, from 1) of the value, largest first; nulls have no rank."""
    ordered = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_list(F.col(value).cast("double")), asc=False).alias("v"))
    part = lambda a, b: F.aggregate(F.slice("v", a, max(0, b - a + 1)), F.lit(0.0), lambda s, x: s + x)
    return ordered.select(group, *[part(a, b).alias(n) for n, (a, b) in spans.items()])


def windowed_activity(players: DataFrame, appearances: DataFrame, cutoff: Column, windows: Sequence[int] = (30, 90, 180, 365)) -> DataFrame:
    """Per player, appearances, minutes and goals in each lookback before the cutoff: one pass over the appearances,
    conditional sums. A player without any earlier row has nulls, not zeros: nothing known is not nothing done."""
    past = appearances.where(F.col("date") < cutoff)
    within = lambda d, c: F.sum(F.when(F.col("date") >= F.date_sub(cutoff, d), c))
    cells = [x for d in windows for x in (F.count_if(F.col("date") >= F.date_sub(cutoff, d)).alias(f"appearances_{d}d"), F.coalesce(within(d, F.col("minutes")), F.lit(0)).alias(f"minutes_{d}d"), F.coalesce(within(d, F.col("goals")), F.lit(0)).alias(f"goals_{d}d"))]
    made = past.groupBy("player_id").agg(*cells, F.max("date").alias("last_date"))
    return players.join(made, "player_id", "left").withColumn("days_since_last", F.datediff(cutoff, "last_date"))


def weighted_mean(value: str, weight: str) -> Column:
    """Over the rows that have both; null for no weight."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.sum(F.when(both, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(both, F.col(weight))).cast("double"), F.lit(0.0))


def coverage_by_dimensions(df: DataFrame, dimensions: Sequence[str], covered: Column) -> DataFrame:
    """Rows and coverage overall and along each dimension, in one long table and one pass: grouping sets."""
    rows = df.withColumn("hit", covered.cast("int"))
    made = rows.groupingSets([[], *[[F.col(d)] for d in dimensions]], *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.sum("hit").alias("covered"), *[F.grouping(d).alias(f"g_{d}") for d in dimensions])
    name, value = F.lit("overall"), F.lit("all")
    for d in dimensions:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return made.select(name.alias("dimension"), value.alias("value"), "n", "covered", (F.col("covered") / F.col("n")).alias("rate"))


def coverage_rollup(df: DataFrame, outer: str, inner: str, covered: Column) -> DataFrame:
    """Coverage per (outer, inner), per outer and overall; null marks a level that is summed over."""
    rows = df.withColumn("hit", covered.cast("double"))
    return rows.rollup(outer, inner).agg(F.count("*").alias("n"), F.avg("hit").alias("coverage"), F.grouping_id().cast("long").alias("level"))


def coverage_tier(count: Column) -> Column:
    return F.when(count >= 10, "strong").when(count >= 4, "partial").when(count >= 1, "sparse").otherwise("none")


def event_totals(events: DataFrame, key: str) -> DataFrame:
    """Totals per key, split by the kind of event, in one aggregate."""
    of = lambda kind: F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)), 4)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return events.groupBy(key).agg(of("purchase").alias("purchase_value"), of("view").alias("view_value"), n("click").alias("clicks"), n("error").alias("errors"), F.round(F.sum("value"), 4).alias("total_value"))


def mode_of(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; the smallest of equals."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("o"), F.col(value)))
    return counts.groupBy(group).agg(best.alias("m")).select(group, f"m.{value}", "m.n")


def pair_frequencies(pairs: DataFrame, group: str, a: str, b: str, win: str) -> DataFrame:
    """Per group and pair: count, share of the group, and how often the first of the pair wins."""
    counts = pairs.groupBy(group, a, b).agg(F.count("*").alias("n"), F.avg(F.col(win).cast("double")).alias("win_share"))
    totals = pairs.groupBy(group).agg(F.count("*").alias("total"))
    return counts.join(totals, group).select(group, a, b, "n", (F.col("n") / F.col("total")).alias("share"), "win_share")


def appearance_shares(pairs: DataFrame, group: str, a: str, b: str, top: Sequence[str]) -> DataFrame:
    """Per group: how often each side shows up, and the share of pairs with at least one of `top`."""
    sides = pairs.select(group, F.explode(F.array(a, b)).alias("team")).groupBy(group, "team").agg(F.count("*").alias("n"))
    some = pairs.groupBy(group).agg(F.avg((F.col(a).isin(*top) | F.col(b).isin(*top)).cast("double")).alias("top_share"))
    return sides.join(some, group)


def slices(df: DataFrame, dimensions: dict[str, Column], value: Column, least: int = 30) -> DataFrame:
    """Mean of value along each dimension, slices under `least` rows left out."""
    rows = df.select(value.alias("v"), F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()])).alias("d")).select("v", "d.*")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).where(F.col("n") >= least)


def opponent_strength(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean rating of a team's opponents weighted by how often it meets them (columns home, away, n; team, rating)."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("away").alias("opponent")), F.struct(F.col("away").alias("team"), F.col("home").alias("opponent")))).alias("s"), "n").select("s.*", "n")
    met = both.join(ratings.select(F.col("team").alias("opponent"), "rating"), "opponent")
    return met.groupBy("team").agg((F.sum(F.col("n") * F.col("rating")) / F.sum("n")).alias("opponent_rating"))
