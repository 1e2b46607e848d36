"""Fixture graphs and brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.shared import settle


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """team, component (its smallest team) of a graph of edges (home, away): least labels, and labels of labels, each
    round written out; two doublings a round."""
    both = settle(edges.select(F.col("home").alias("a"), F.col("away").alias("b")).union(edges.select("away", "home")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("team")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels, both["b"] == labels["team"]).groupBy("a").agg(F.min("component").alias("near"))
        near = labels.join(seen, labels["team"] == seen["a"]).select("team", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        ahead = labels.select(F.col("team").alias("near"), F.col("component").alias("ahead"))
        moved = settle(near.join(ahead, "near").select("team", F.least("near", "ahead").alias("component"), "old"), "labels")
        done = moved.where("component <> old").limit(1).count() == 0
        labels = moved.select("team", "component")
        if done:
            return labels
    raise RuntimeError("components did not settle")


def lettered(groups: DataFrame) -> DataFrame:
    """team, component and a synthetic label G01.. in the order of the components' smallest teams."""
    order = groups.select("component").distinct().withColumn("n", F.row_number().over(Window.orderBy("component")))
    return groups.join(F.broadcast(order), "component").select("team", "component", F.format_string("G%02d", "n").alias("label"))


def group_problems(groups: DataFrame, n_groups: int, size: int) -> DataFrame:
    """What keeps the groups from being n_groups of size teams."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    wrong = sizes.where(F.col("n") != size).select(F.concat(F.lit("size:"), "component").alias("problem"))
    count = sizes.agg(F.count("*").alias("c")).where(F.col("c") != n_groups).select(F.concat(F.lit("groups:"), F.col("c").cast("string")).alias("problem"))
    return wrong.union(count)


def descendants(edges: DataFrame, starts: DataFrame, most_depth: int = 8) -> DataFrame:
    """start, node, depth: everything that (feeder, match) edges lead to. A bracket is a few levels: a join each."""
    level = starts.select(F.col("match").alias("start"), F.col("match").alias("node"), F.lit(0).alias("depth"))
    out = None
    for depth in range(1, most_depth + 1):
        level = level.join(edges.select(F.col("feeder").alias("node"), F.col("match").alias("next")), "node").select("start", F.col("next").alias("node"), F.lit(depth).alias("depth")).distinct()
        out = level if out is None else out.union(level)
    return out.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def combination_key(groups: str = "group") -> object:
    """The sorted letters of a set of groups, joined by a dash."""
    return F.array_join(F.array_sort(F.collect_list(groups)), "-")


def resolve_slots(slots: DataFrame, standings: DataFrame, thirds: DataFrame) -> DataFrame:
    """Teams of the first round: slots (match, side, kind '1'/'2'/'3', group) by standings (group, position, team) and,
    for third places, thirds (match, group) for the set of groups that qualified."""
    direct = slots.where("kind <> '3'").join(standings.select("group", F.col("position").cast("string").alias("kind"), "team"), ["group", "kind"])
    third = slots.where("kind = '3'").drop("group").join(thirds, "match").join(standings.where("position = 3").select("group", "team"), "group")
    return direct.select("match", "side", "team").union(third.select("match", "side", "team"))


def bracket_problems(matches: DataFrame, first: int, last: int) -> DataFrame:
    """Problems of a bracket (match, slot_1, slot_2): numbers missing or repeated, slots of no known form, feeders that
    come no earlier than the match they feed."""
    numbers = matches.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("match"))
    counts = matches.groupBy("match").agg(F.count("*").alias("n"))
    missing = numbers.join(counts, "match", "left").where("n is null or n > 1").select("match", F.lit("number").alias("problem"))
    long = matches.select("match", F.explode(F.array("slot_1", "slot_2")).alias("slot"))
    form = long.where(~F.col("slot").rlike(r"^([12][A-L]|THIRD|[WL][0-9]+)$")).select("match", F.lit("slot").alias("problem"))
    order = long.where(F.col("slot").rlike(r"^[WL][0-9]+$") & (F.regexp_extract("slot", r"[0-9]+", 0).cast("int") >= F.col("match"))).select("match", F.lit("order").alias("problem"))
    return missing.union(form).union(order)
