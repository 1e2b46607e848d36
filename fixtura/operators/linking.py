"""Matching records of two sources: fixtures in either order, prioritised keys, people by a cascade of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions.text import person_key


def link_fixtures(source: DataFrame, canonical: DataFrame, key: str = "source_id") -> DataFrame:
    """Class of each source row (date, home, away) against canonical rows (date, home, away, match_id): exact, reversed,
    ambiguous or unmatched, and the match. Candidates are counted per key before the join, so keys that repeat never
    multiply rows."""
    found = canonical.groupBy("date", "home", "away").agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"))
    back = found.select("date", F.col("away").alias("home"), F.col("home").alias("away"), F.col("n").alias("n_back"), F.col("match_id").alias("back_id"))
    met = source.join(found, ["date", "home", "away"], "left").join(back, ["date", "home", "away"], "left")
    kind = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "exact").when(F.col("n_back") > 1, "ambiguous").when(F.col("n_back") == 1, "reversed").otherwise("unmatched")
    met = met.withColumn("class", kind)
    return met.select(key, "class", F.when(F.col("class") == "exact", F.col("match_id")).when(F.col("class") == "reversed", F.col("back_id")).alias("match_id"))


def link_summary(links: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("class") == kind)
    linked = n("exact") + n("reversed")
    return links.agg(F.count("*").alias("total"), *[n(k).alias(k) for k in ("exact", "reversed", "ambiguous", "unmatched")], (linked / F.nullif(F.count("*"), F.lit(0))).alias("link_rate"))


def build_index(entries: DataFrame, order: str = "row_id") -> DataFrame:
    """kind ('id' or 'pair'), key, orientation (1 or -1) and value of entries (match_id, team_a, team_b, value): the
    first entry of a key stays, and one in the given order beats a reversed one."""
    forms = F.array(
        F.when(F.coalesce("match_id", F.lit("")) != "", F.struct(F.lit("id").alias("kind"), F.col("match_id").alias("key"), F.lit(1).alias("orientation"))),
        F.struct(F.lit("pair").alias("kind"), F.concat_ws("\u001f", "team_a", "team_b").alias("key"), F.lit(1).alias("orientation")),
        F.struct(F.lit("pair").alias("kind"), F.concat_ws("\u001f", "team_b", "team_a").alias("key"), F.lit(-1).alias("orientation")),
    )
    long = entries.select(order, "value", F.explode(F.array_compact(forms)).alias("f")).select(order, "value", "f.*")
    best = F.min_by(F.struct("orientation", "value"), F.struct((F.col("orientation") == -1).alias("late"), F.col(order)))
    return long.groupBy("kind", "key").agg(best.alias("b")).select("kind", "key", "b.*")


def resolve(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries (match_id, team_a, team_b) with value and orientation: by id, else by the pair; 0 for none."""
    of = lambda kind, by: index.where(F.col("kind") == kind).select(F.col("key").alias(by), F.col("value").alias(f"{kind}_value"), F.col("orientation").alias(f"{kind}_orientation"))
    met = queries.withColumn("pair_", F.concat_ws("\u001f", "team_a", "team_b")).join(of("id", "match_id"), "match_id", "left").join(of("pair", "pair_"), "pair_", "left")
    return met.select(*queries.columns, F.coalesce("id_value", "pair_value").alias("value"), F.coalesce("id_orientation", "pair_orientation", F.lit(0)).alias("orientation"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer comparison: exact, normalization_equivalent (equal but for case and spaces), substantive_discrepancy
    or missing from one side, with the columns that differ."""
    clean = lambda c: F.lower(F.trim(c.cast("string")))
    a, b = left.withColumn("in_a", F.lit(True)), right.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("in_b"))
    met = a.join(b, keys, "full_outer")
    same, alike = F.lit(True), F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
        alike = alike & clean(F.col(c)).eqNullSafe(clean(F.col(f"{c}_b")))
    kind = F.when(F.col("in_b").isNull(), "missing_from_extract").when(F.col("in_a").isNull(), "missing_from_primary").when(same, "exact").when(alike, "normalization_equivalent").otherwise("substantive_discrepancy")
    differ = F.array_compact(F.array(*[F.when(~clean(F.col(c)).eqNullSafe(clean(F.col(f"{c}_b"))), F.lit(c)) for c in columns]))
    return met.select(*keys, kind.alias("class"), F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), F.array_join(differ, ";")).otherwise("").alias("differing"))


#: Rules of the person cascade in order of trust.
RULES = ("reviewed_alias", "seed", "source_id", "name_dob", "name_nationality_club")


def link_people(squad: DataFrame, players: DataFrame, aliases: DataFrame, seeds: DataFrame) -> DataFrame:
    """Best link of each squad row (row_id, name, team, source_id, dob, nationality, club) to players (player_id, name,
    dob, nationality, club): the first rule with candidates decides; one candidate links, several are ambiguous; a
    name alone never links. A player claimed by several rows conflicts for all of them.

    aliases and seeds are (row_id, player_id). Each rule is one equi-join; candidates are counted per row and rule."""
    s = squad.withColumn("key", person_key(F.col("name")))
    p = players.select("player_id", person_key(F.col("name")).alias("key"), F.col("dob").alias("p_dob"), F.col("nationality").alias("p_nat"), F.col("club").alias("p_club"))
    ids = p.select("player_id")
    by_name = s.join(p, "key")
    candidates = [
        aliases.join(ids, "player_id").select("row_id", "player_id", F.lit(0).alias("rule")),
        seeds.join(ids, "player_id").select("row_id", "player_id", F.lit(1).alias("rule")),
        s.where("source_id is not null").join(ids, F.col("source_id") == F.col("player_id")).select("row_id", "player_id", F.lit(2).alias("rule")),
        by_name.where("dob = p_dob").select("row_id", "player_id", F.lit(3).alias("rule")),
        by_name.where("nationality = p_nat and club = p_club").select("row_id", "player_id", F.lit(4).alias("rule")),
    ]
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    per_rule = every.groupBy("row_id", "rule").agg(F.count_distinct("player_id").alias("n"), F.min("player_id").alias("player_id"))
    best = per_rule.groupBy("row_id").agg(F.min_by(F.struct("rule", "n", "player_id"), "rule").alias("b")).select("row_id", "b.*")
    named = s.join(p.select("key").distinct(), "key", "left_semi").select("row_id", F.lit(True).alias("name_known"))
    met = squad.select("row_id").join(best, "row_id", "left").join(named, "row_id", "left")
    accepted = F.when(F.col("n") == 1, F.col("player_id"))
    met = met.withColumn("accepted", accepted)
    # Rows without a link are spread by their own id: they have nothing in common.
    claims = F.count("accepted").over(Window.partitionBy(F.coalesce(F.col("accepted").cast("string"), F.concat(F.lit("row"), F.col("row_id").cast("string")))))
    status = F.when((F.col("n") == 1) & (claims > 1), "conflicting").when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").when(F.col("name_known"), "name_only").otherwise("unmatched")
    method = F.get(F.array(*map(F.lit, RULES)), F.col("rule"))
    met = met.withColumn("status", status)
    return met.select("row_id", "status", method.alias("method"), F.when(F.col("status") == "linked", F.col("accepted")).alias("player_id"))


def seed_owners(candidates: DataFrame) -> DataFrame:
    """Seed candidates (row_id, player_id, valid): the first valid row that claims a player owns it, later ones conflict."""
    first = F.min(F.when(F.col("valid"), F.col("row_id"))).over(Window.partitionBy("player_id"))
    status = F.when(~F.col("valid"), "rejected").when(F.col("row_id") == first, "accepted").otherwise("conflict")
    return candidates.withColumn("status", status)


def overlay(base: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of the results where a result has the key."""
    new = results.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return base.join(new, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def lookup_either_way(pairs: DataFrame, baseline: DataFrame, default: float = 0.5) -> DataFrame:
    """pairs (a, b) with p: the baseline's, the complement of the reversed one's, or the default (flagged)."""
    forward = baseline.select("a", "b", F.col("p").alias("p_forward"))
    back = baseline.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 - F.col("p")).alias("p_back"))
    met = pairs.join(forward, ["a", "b"], "left").join(back, ["a", "b"], "left")
    return met.select(*pairs.columns, F.coalesce("p_forward", "p_back", F.lit(default)).alias("p"), (F.col("p_forward").isNull() & F.col("p_back").isNull()).alias("defaulted"))


def both_ways(baseline: DataFrame) -> DataFrame:
    return baseline.select("a", "b", "p").union(baseline.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 - F.col("p")).alias("p")))
