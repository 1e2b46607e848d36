"""Hand-made signal tables: sparse columns, missing files are empty tables, the last row of a team wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.shared import DataError
from fixtura.sources.delimited import numbered, optional, scan

SCHEMAS = {
    "market_odds": "match_id string, source string, team_a string, team_b string, team_a_odds double, draw_odds double, team_b_odds double, timestamp string",
    "expert_predictions": "match_id string, team_a string, team_b string, source_model string, team_a_win_prob double, draw_prob double, team_b_win_prob double, team_a_advance_prob double, team_b_advance_prob double, confidence double, reasoning string",
    "team_styles": "team string, possession_heavy double, low_block_defense double, transition_threat double, set_piece_threat double, pressing_intensity double, chance_creation double, sterile_possession_risk double, struggles_vs_low_block double, defensive_compactness double, attacking_directness double, aerial_threat double",
    "penalties": "team string, penalty_strength double, keeper_penalty_strength double, penalty_taker_depth double, shootout_wins double, shootout_losses double, world_cup_shootout_wins double, world_cup_shootout_losses double, continental_shootout_wins double, continental_shootout_losses double, tournament_experience double, manager_continuity double",
    "recent_form": "team string, elo_adj_last5 double, elo_adj_last10 double, gf_adj double, ga_adj double, xg_diff double",
    "venue_context": "match_id string, team_a string, team_b string, stage string, host_boost double, crowd_advantage double, travel_km_a double, travel_km_b double, rest_days_a double, rest_days_b double, heat_disadvantage_a double, timezone_shift_a double, timezone_shift_b double",
    "match_context": "match_id string, team_a string, team_b string, stage string, available_at string, kickoff_at string, source string, lineup_edge double, availability_edge double, goalkeeper_edge double, fatigue_edge double, quality_edge double, tactics_edge double, weather_edge double, reason string",
    "knockout_results": "match_number int, round string, team_a string, team_b string, score_a int, score_b int, aet boolean, penalties boolean, winner string, notes string",
    "performance_tags": "team string, match_number int, tag string, points double, reason string",
}
EDGES = ("lineup_edge", "availability_edge", "goalkeeper_edge", "fatigue_edge", "quality_edge", "tactics_edge", "weather_edge")


def load(spark: SparkSession, folder: str, name: str, required: bool = False) -> DataFrame:
    """<name>.csv of the folder, else the bundled <name>.example.csv, else an empty table."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    real = f"{folder}/{name}.csv"
    path = real if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(real)) else f"{folder}/{name}.example.csv"
    return optional(spark, path, SCHEMAS[name], required)


def last_per_team(df: DataFrame, order: str) -> DataFrame:
    """The last row of each team by `order`, nulls in it included."""
    return df.where("trim(team) <> ''").groupBy(F.trim("team").alias("team_")).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def match_key(match_id: str = "match_id", a: str = "team_a", b: str = "team_b"):
    """match_id, or pair::a|b where there is none."""
    pair = F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), F.concat(F.lit("pair::"), a, F.lit("|"), b))
    return F.coalesce(F.nullif(F.trim(match_id), F.lit("")), pair)


def split_experts(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a complete triple or pair must sum to 1 within 0.05, and one of them must be there."""
    triple = F.col("team_a_win_prob") + F.col("draw_prob") + F.col("team_b_win_prob")
    pair = F.col("team_a_advance_prob") + F.col("team_b_advance_prob")
    wrong = F.when(triple.isNull() & pair.isNull(), "incomplete").when(F.abs(triple - 1) > 0.05, "triple_sum").when(F.abs(pair - 1) > 0.05, "pair_sum")
    rows = predictions.withColumn("key", match_key()).withColumn("rejected", wrong)
    return rows.where("rejected is null and key is not null").drop("rejected"), rows.where("rejected is not null")


def check_context(context: DataFrame) -> DataFrame:
    """Rows of late evidence with the rules they break: identity, times with an offset, evidence before kickoff, a
    reason for any evidence, finite numbers."""
    zoned = lambda c: F.when(F.col(c).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.col(c).try_cast("timestamp"))
    some = F.greatest(*[F.col(c).isNotNull().cast("int") for c in EDGES]) == 1
    wild = F.greatest(*[F.coalesce((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int"), F.lit(0)) for c in EDGES]) == 1
    rules = F.array_compact(F.array(
        F.when(match_key().isNull(), "identity"),
        F.when(zoned("available_at").isNull(), "available_at"),
        F.when(zoned("kickoff_at").isNull(), "kickoff_at"),
        F.when(zoned("available_at") >= zoned("kickoff_at"), "after_kickoff"),
        F.when(wild, "finite"),
        F.when(some & (F.coalesce("reason", F.lit("")) == ""), "reason"),
    ))
    return context.withColumn("key", match_key()).withColumn("broken", F.array_join(rules, ";"))


def load_context(spark: SparkSession, folder: str) -> DataFrame:
    """Valid late evidence only; any broken rule or repeated key is an error."""
    rows = check_context(load(spark, folder, "match_context"))
    if bad := rows.where("broken <> ''").limit(5).collect():
        raise DataError(f"match_context: {[(r['key'], r['broken']) for r in bad]}")
    if twice := rows.groupBy("key").count().where("count > 1").limit(5).collect():
        raise DataError(f"match_context: repeated keys {[r['key'] for r in twice]}")
    return rows.drop("broken")


KNOCKOUT_COLUMNS = ("match_number", "round", "team_a", "team_b", "score_a", "score_b", "aet", "penalties", "winner")
#: Last match number of each round; the first round starts at 73.
ROUND_ENDS = {"round_of_32": 88, "round_of_16": 96, "quarterfinal": 100, "semifinal": 102, "third_place": 103, "final": 104}
TRUE, FALSE = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f", "")
#: Cells that stand for no value.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def check_knockout(rows: DataFrame) -> DataFrame:
    """Knockout results as text with their source_row: typed, and all problems of each row. A row whose match number
    is no integer, or came before, has that one problem."""
    cell = lambda c: F.trim(F.when(F.col(c).isin(*MISSING), "").otherwise(F.col(c)))
    number = F.when(cell("match_number").rlike(r"^[+-]?[0-9]+$"), cell("match_number").try_cast("decimal(38,0)"))
    score = lambda c: F.when(cell(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cell(c).try_cast("double").try_cast("int"))
    blank = lambda c: F.lower(cell(c)).isin("", "nan")
    flag = lambda c: F.lower(cell(c)).isin(*TRUE)
    expected = F.lit(None).cast("string")
    for name, last in reversed(ROUND_ENDS.items()):
        expected = F.when((F.col("number") >= 73) & (F.col("number") <= last), name).otherwise(expected)
    nth = F.row_number().over(Window.partitionBy("number").orderBy("source_row"))
    made = rows.withColumn("number", number).withColumn("nth", F.when(F.col("number").isNotNull(), nth)).withColumn("expected", expected)
    names = [cell(c).alias(c) for c in ("round", "team_a", "team_b", "winner")]
    notes = (cell("notes") if "notes" in rows.columns else F.lit("")).alias("notes")
    flags = [flag(c).alias(c) for c in ("aet", "penalties")] + [(~F.lower(cell(c)).isin(*TRUE, *FALSE)).alias(f"odd_{c}") for c in ("aet", "penalties")]
    points = [F.when(score(c) >= 0, score(c)).alias(c) for c in ("score_a", "score_b")] + [F.when(~blank(c), F.when(score(c).isNull(), f"{c}_not_integer").when(score(c) < 0, f"{c}_negative")).alias(f"odd_{c}") for c in ("score_a", "score_b")]
    made = made.select("source_row", "number", "nth", "expected", *names, *points, *flags, notes)
    a, b, w = F.col("score_a"), F.col("score_b"), F.col("winner")
    shootout = F.col("penalties")
    by_score = F.when(a > b, F.col("team_a")).otherwise(F.col("team_b"))
    rules = F.array_compact(F.array(
        F.col("odd_score_a"),
        F.col("odd_score_b"),
        F.when(F.col("odd_aet"), "aet_not_boolean"),
        F.when(F.col("odd_penalties"), "penalties_not_boolean"),
        F.when(F.col("expected").isNull(), "number_range").when(F.col("round") != F.col("expected"), "round"),
        F.when((F.col("team_a") == "") | (F.col("team_b") == ""), "team_missing"),
        F.when(F.col("team_a") == F.col("team_b"), "same_team"),
        F.when((w != F.col("team_a")) & (w != F.col("team_b")), "winner"),
        F.when(shootout & ~F.col("aet"), "penalties_without_aet"),
        F.when(a.isNull() != b.isNull(), "one_score"),
        F.when(shootout & (a != b), "shootout_not_level"),
        F.when(~shootout & (a == b), "level_without_shootout"),
        F.when(~shootout & (a != b) & (w != by_score), "winner_contradicts_score"),
    ))
    first = F.when(F.col("number").isNull(), F.array(F.lit("number_not_integer"))).when(F.col("nth") > 1, F.array(F.lit("duplicate")))
    kept = ["source_row", F.col("number").alias("match_number"), "round", "team_a", "team_b", "score_a", "score_b", "aet", "penalties", "winner", "notes"]
    return made.select(*kept, F.array_join(F.coalesce(first, rules), ";").alias("problems"))


def scan_knockout(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the file at path, checked."""
    return check_knockout(numbered(scan(spark, path, KNOCKOUT_COLUMNS).drop("source_file"), first=1))


def load_knockout(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """Confirmed results, one row per match number; an error that names all problems of all rows if there are any. A
    missing file is an empty table unless it is required."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return optional(spark, path, SCHEMAS["knockout_results"], required)
    rows = scan_knockout(spark, path)
    if bad := rows.where("problems <> ''").select("source_row", "match_number", "problems").orderBy("source_row").collect():
        raise DataError(f"invalid knockout results: {[(r['source_row'], r['match_number'] and int(r['match_number']), r['problems']) for r in bad]}")
    return rows.drop("source_row", "problems").withColumn("match_number", F.col("match_number").cast("int"))
