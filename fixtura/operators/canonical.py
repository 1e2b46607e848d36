"""From raw match rows to the canonical table, with every row accounted for.

Each raw row gets the first exclusion reason that applies or none, so canonical rows + exclusions = raw rows;
canonical rows and all audits are read off one tagged frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions.hashing import match_identity
from fixtura.functions.parse import iso_date, knockout_capable, neutral_flag, score_bad, score_missing, score_value
from fixtura.operators.temporal import mapping_periods, resolve_names
from fixtura.shared import require_columns

RAW_COLUMNS = ("source_row", "date", "home_team", "away_team", "home_score", "away_score", "tournament", "city", "country", "neutral")


@dataclass(frozen=True)
class Policy:
    """What a deployment may set; the defaults are this package's."""

    knockout_patterns: tuple[str, ...] = ("World Cup", "Continental Cup")
    suspicious_terms: tuple[str, ...] = ("olympic", "u-23", "u23", "under-23", "youth", "b team", "reserve", "select")
    implausible_score: int = 32


def triage(raw: DataFrame, former_names: DataFrame) -> DataFrame:
    """Raw rows, typed, with current names, identity and reason (null: canonical)."""
    require_columns(raw, RAW_COLUMNS, "results")
    typed = raw.select(
        "source_row",
        iso_date(F.col("date")).alias("date"),
        F.trim("home_team").alias("home_team_raw"),
        F.trim("away_team").alias("away_team_raw"),
        *[F.trim(c).alias(c) for c in ("tournament", "city", "country")],
        neutral_flag(F.col("neutral")).alias("neutral"),
        *[score_value(F.col(f"{s}_score")).alias(f"{s}_score_recorded") for s in ("home", "away")],
        (score_missing(F.col("home_score")) | score_missing(F.col("away_score"))).alias("unplayed"),
        (score_bad(F.col("home_score")) | score_bad(F.col("away_score"))).alias("bad_score"),
    )
    named = resolve_names(typed, mapping_periods(former_names), "date", {"home_team_raw": "home_team", "away_team_raw": "away_team"})
    identity = match_identity(F.date_format("date", "yyyy-MM-dd"), F.col("home_team"), F.col("away_team"), F.col("tournament"), F.col("city"), F.col("country"))
    early = F.when(F.col("date").isNull(), "unparseable_date").when(F.col("bad_score"), "unparseable_score").when(F.col("home_team") == F.col("away_team"), "identical_teams")
    named = named.withColumn("reason", early).withColumn("canonical_match_id", F.when(F.col("reason").isNull(), identity))
    # Excluded rows have no identity; keyed by their row they don't meet in one partition.
    spread = F.coalesce("canonical_match_id", F.col("source_row").cast("string"))
    nth = F.row_number().over(Window.partitionBy(spread).orderBy("source_row"))
    named = named.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(nth > 1, "duplicate_canonical_identity"))
    return named.withColumn("status", F.when(F.col("unplayed"), "scheduled").otherwise("played")).drop("unplayed", "bad_score")


def canonical_rows(triaged: DataFrame) -> DataFrame:
    return triaged.where("reason is null").drop("reason")


def exclusions(triaged: DataFrame) -> DataFrame:
    return triaged.where("reason is not null").select("source_row", "canonical_match_id", "reason")


def duplicate_keys(matches: DataFrame) -> DataFrame:
    """All members of groups that share date and teams but not identity."""
    return matches.withColumn("n_same", F.count("*").over(Window.partitionBy("date", "home_team", "away_team"))).where("n_same > 1")


def reconcile_shootouts(shootouts: DataFrame, matches: DataFrame, former_names: DataFrame) -> DataFrame:
    """Each shootout row with its status and, where there is one, its match. The first row of a key claims it, then
    the key is looked up; a match that several rows share is ambiguous."""
    rows = shootouts.withColumn("d", iso_date(F.col("date")))
    names = {"home_team": "home", "away_team": "away", "winner": "won", "first_shooter": "first"}
    rows = resolve_names(rows, mapping_periods(former_names), "d", names).withColumn("first", F.nullif("first", F.lit("")))
    spread = F.when(F.col("d").isNull(), F.col("source_row"))
    nth = F.row_number().over(Window.partitionBy("d", "home", "away", spread).orderBy("source_row"))
    found = matches.groupBy(F.col("date").alias("d"), F.col("home_team").alias("home"), F.col("away_team").alias("away")).agg(
        F.count("*").alias("n_found"), F.min(F.struct("source_row", "canonical_match_id", "status", "home_score_recorded", "away_score_recorded")).alias("m")
    )
    met = rows.withColumn("nth", nth).join(found, ["d", "home", "away"], "left")
    uneven = (F.col("m.status") == "played") & (F.col("m.home_score_recorded") != F.col("m.away_score_recorded"))
    status = (
        F.when(F.col("d").isNull(), "unparseable_date")
        .when(F.col("nth") > 1, "duplicate_shootout")
        .when(F.col("n_found").isNull(), "unmatched")
        .when(F.col("n_found") > 1, "ambiguous_join")
        .when(~F.col("won").isin(F.col("home"), F.col("away")), "winner_not_participant")
        .when(~F.col("first").isin(F.col("home"), F.col("away")), "first_shooter_not_participant")
        .when(uneven, "matched_score_not_tied")
        .otherwise("matched")
    )
    met = met.withColumn("status", status)
    known = ~F.col("status").isin("unparseable_date", "duplicate_shootout", "unmatched", "ambiguous_join")
    return met.select("source_row", "date", "home_team", "away_team", "winner", "first_shooter", "status", F.when(known, F.col("m.canonical_match_id")).alias("canonical_match_id"), "won", "first")


def with_scope(matches: DataFrame, reconciled: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """matches with shootout and score-scope columns. A shootout hides the regulation score; a shootout on a decisive
    score makes the outcome unknown too."""
    won = reconciled.where("status in ('matched', 'matched_score_not_tied')").select("canonical_match_id", F.col("won").alias("shootout_winner"), F.col("first").alias("shootout_first_shooter"), F.lit(True).alias("shootout_played"))
    df = matches.join(won, "canonical_match_id", "left").withColumn("shootout_played", F.coalesce("shootout_played", F.lit(False)))
    played, shot = F.col("status") == "played", F.col("shootout_played")
    h, a = F.col("home_score_recorded"), F.col("away_score_recorded")
    plain = played & ~shot
    outcome = F.when(~played, "unknown").when(shot, F.when(h == a, "draw").otherwise("unknown")).when(h > a, "home_win").when(h < a, "away_win").otherwise("draw")
    return df.withColumns(
        {
            "recorded_score_scope": F.when(plain, "regulation").when(played, "unknown"),
            "regulation_home_score": F.when(plain, h),
            "regulation_away_score": F.when(plain, a),
            "regulation_score_known": plain,
            "regulation_outcome": outcome,
            "extra_time_played": F.when(plain, F.lit(False)),
            "extra_time_status_known": plain & ~knockout_capable(F.col("tournament"), policy.knockout_patterns),
            "strict_goal_model_eligible": plain,
            "strict_exclusion_reason": F.when(~played, "not_played").when(shot, "shootout_score_scope_unknown"),
        }
    )


def suspicious_scope(scoped: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Matches with at least one reason to look again; reasons joined by a semicolon, terms first."""
    h, a, played = F.col("home_score_recorded"), F.col("away_score_recorded"), F.col("status") == "played"
    terms = [F.when(F.lower("tournament").contains(t), f"tournament_term:{t}") for t in policy.suspicious_terms]
    decisive = F.when(played & ~F.col("shootout_played") & (h != a) & knockout_capable(F.col("tournament"), policy.knockout_patterns), "possible_extra_time_decisive_knockout_capable")
    wild = F.when(played & ((h >= policy.implausible_score) | (a >= policy.implausible_score)), "implausible_score")
    reasons = F.array_compact(F.array(*terms, decisive, wild))
    return scoped.withColumn("reasons", F.array_join(reasons, ";")).where("reasons <> ''").select("canonical_match_id", "date", "home_team", "away_team", "tournament", "home_score_recorded", "away_score_recorded", "reasons", "source_row")


def build(raw: DataFrame, shootouts: DataFrame, former_names: DataFrame, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """The canonical table and its audits, all lazy and all from the same tagged rows."""
    triaged = triage(raw, former_names)
    matches = canonical_rows(triaged)
    reconciled = reconcile_shootouts(shootouts, matches, former_names)
    scoped = with_scope(matches, reconciled, policy)
    return {"triaged": triaged, "matches": scoped, "exclusions": exclusions(triaged), "duplicate_identities": duplicate_keys(matches), "shootout_reconciliation": reconciled, "suspicious_scope": suspicious_scope(scoped, policy)}


def build_statistics(triaged: DataFrame, scoped: DataFrame) -> DataFrame:
    """One row of counts; teams are counted over both sides at once."""
    sides = scoped.select(F.explode(F.array("home_team", "away_team")).alias("team")).agg(F.count_distinct("team").alias("teams"))
    counts = scoped.agg(
        F.count("*").alias("canonical_matches"),
        F.count_if(F.col("status") == "played").alias("played_matches"),
        F.count_if(F.col("status") != "played").alias("scheduled_matches"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.count_distinct("tournament").alias("tournaments"),
        F.count_if("shootout_played").alias("shootouts_matched"),
        F.count_if("strict_goal_model_eligible").alias("strict_goal_model_eligible"),
    )
    raw = triaged.agg(F.count("*").alias("raw_rows"), F.count_if(F.col("reason").isNotNull()).alias("excluded_rows"))
    return counts.join(F.broadcast(sides)).join(F.broadcast(raw))  # three frames of one row
