"""API envelopes, nested JSON, to flat rows with their snapshot's provenance. Schemas are explicit; a field that is
absent is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = "struct<get:string,errors:string,results:int,response:array<{row}>>"
TEAM = "struct<id:long,name:string>"
ROWS = {
    "leagues": "struct<league:struct<id:long,name:string,type:string>,country:struct<name:string>,seasons:array<struct<year:int,current:boolean,coverage:struct<fixtures:struct<events:boolean,lineups:boolean>,injuries:boolean>>>>",
    "fixtures": f"struct<fixture:struct<id:long,date:string,status:struct<short:string>>,league:struct<id:long,season:int,round:string>,teams:struct<home:{TEAM},away:{TEAM}>,goals:struct<home:int,away:int>>",
    "standings": f"struct<league:struct<id:long,season:int,standings:array<array<struct<rank:int,team:{TEAM},points:int,goalsDiff:int,group:string>>>>>",
    "lineups": f"struct<team:{TEAM},formation:string,startXI:array<struct<player:struct<id:long,name:string,pos:string>>>,substitutes:array<struct<player:struct<id:long,name:string,pos:string>>>>",
    "injuries": f"struct<player:struct<id:long,name:string,type:string,reason:string>,team:{TEAM},fixture:struct<id:long,date:string>>",
    "players": f"struct<team:{TEAM},players:array<struct<player:struct<id:long,name:string>,statistics:array<struct<games:struct<minutes:int,rating:string>,goals:struct<total:int,assists:int>>>>>>",
    "events": f"struct<time:struct<elapsed:int,extra:int>,team:{TEAM},player:struct<id:long,name:string>,type:string,detail:string>",
    "predictions": "struct<predictions:struct<winner:struct<id:long,name:string>,percent:struct<home:string,draw:string,away:string>,advice:string>>",
}


def parsed(envelopes: DataFrame, kind: str, column: str = "body") -> DataFrame:
    """envelopes (snapshot_id, retrieved_at, body, ...) with the parsed body as e."""
    return envelopes.withColumn("e", F.from_json(column, ENVELOPE.format(row=ROWS[kind])))


def envelope_status(body: Column) -> Column:
    """'ok', 'plan_limit', 'rate_limit', 'auth' or 'error': a provider reports problems inside a successful answer, as
    an object or a list."""
    errors = F.lower(F.coalesce(F.get_json_object(body, "$.errors"), F.lit("[]")))
    return F.when(errors.isin("[]", "{}", "null", ""), "ok").when(errors.contains("plan"), "plan_limit").when(errors.contains("rate") | errors.contains("requests"), "rate_limit").when(errors.contains("token") | errors.contains("key"), "auth").otherwise("error")


def rows_of(envelopes: DataFrame, kind: str, fields: dict[str, str], inner: str | None = None) -> DataFrame:
    """One row per element of response (and of the array `inner` in it, if named), with provenance."""
    rows = parsed(envelopes, kind).select("snapshot_id", "retrieved_at", F.explode("e.response").alias("r"))
    if inner:
        rows = rows.select("snapshot_id", "retrieved_at", "r", F.explode_outer(f"r.{inner}").alias("x"))
    return rows.select(*[F.col(path).alias(name) for name, path in fields.items()], "snapshot_id", "retrieved_at")


def leagues(envelopes: DataFrame) -> DataFrame:
    return rows_of(envelopes, "leagues", {"league_id": "r.league.id", "league": "r.league.name", "country": "r.country.name", "season": "x.year", "has_events": "x.coverage.fixtures.events", "has_lineups": "x.coverage.fixtures.lineups", "has_injuries": "x.coverage.injuries"}, "seasons")


def fixtures(envelopes: DataFrame) -> DataFrame:
    return rows_of(envelopes, "fixtures", {"fixture_id": "r.fixture.id", "date": "r.fixture.date", "status": "r.fixture.status.short", "league_id": "r.league.id", "season": "r.league.season", "home": "r.teams.home.name", "away": "r.teams.away.name", "home_goals": "r.goals.home", "away_goals": "r.goals.away"})


def standings(envelopes: DataFrame) -> DataFrame:
    """Two arrays deep: league, then group, then team."""
    rows = parsed(envelopes, "standings").select("snapshot_id", "retrieved_at", F.explode("e.response").alias("r"))
    rows = rows.select("snapshot_id", "retrieved_at", "r.league.id", "r.league.season", F.explode(F.flatten("r.league.standings")).alias("s"))
    return rows.select(F.col("id").alias("league_id"), "season", F.col("s.group").alias("group"), F.col("s.rank").alias("rank"), F.col("s.team.name").alias("team"), F.col("s.points").alias("points"), F.col("s.goalsDiff").alias("goal_difference"), "snapshot_id", "retrieved_at")


def lineups(envelopes: DataFrame) -> DataFrame:
    """Starters and bench in one explode, tagged."""
    rows = parsed(envelopes, "lineups").select("snapshot_id", "retrieved_at", F.explode("e.response").alias("r"))
    tagged = lambda column, role: F.transform(F.coalesce(F.col(column), F.array()), lambda x: F.struct(F.lit(role).alias("role"), x["player"].alias("player")))
    every = F.explode(F.concat(tagged("r.startXI", "start"), tagged("r.substitutes", "bench"))).alias("p")
    return rows.select("r.team.name", "r.formation", every, "snapshot_id", "retrieved_at").select(F.col("name").alias("team"), "formation", "p.role", F.col("p.player.id").alias("player_id"), F.col("p.player.name").alias("player"), F.col("p.player.pos").alias("position"), "snapshot_id", "retrieved_at")


def injuries(envelopes: DataFrame) -> DataFrame:
    return rows_of(envelopes, "injuries", {"player_id": "r.player.id", "player": "r.player.name", "type": "r.player.type", "reason": "r.player.reason", "team": "r.team.name", "fixture_id": "r.fixture.id"})


def fixture_players(envelopes: DataFrame) -> DataFrame:
    """The first of each player's statistics; null where there are none."""
    rows = parsed(envelopes, "players").select("snapshot_id", "retrieved_at", F.explode("e.response").alias("r")).select("snapshot_id", "retrieved_at", F.col("r.team.name").alias("team"), F.explode("r.players").alias("p"))
    rows = rows.withColumn("s", F.get("p.statistics", F.lit(0)))
    return rows.select("team", F.col("p.player.id").alias("player_id"), F.col("p.player.name").alias("player"), F.col("s.games.minutes").alias("minutes"), F.col("s.goals.total").alias("goals"), F.col("s.goals.assists").alias("assists"), "snapshot_id", "retrieved_at")


def fixture_events(envelopes: DataFrame) -> DataFrame:
    return rows_of(envelopes, "events", {"minute": "r.time.elapsed", "extra": "r.time.extra", "team": "r.team.name", "player": "r.player.name", "type": "r.type", "detail": "r.detail"})


def predictions(envelopes: DataFrame) -> DataFrame:
    """Provider forecasts, marked as a benchmark that is never trained on."""
    share = lambda c: F.regexp_replace(F.col(c), "%", "").try_cast("double") / 100
    rows = rows_of(envelopes, "predictions", {"winner": "r.predictions.winner.name", "home": "r.predictions.percent.home", "draw": "r.predictions.percent.draw", "away": "r.predictions.percent.away", "advice": "r.predictions.advice"})
    return rows.withColumns({c: share(c) for c in ("home", "draw", "away")}).withColumn("usage", F.lit("external_benchmark"))
