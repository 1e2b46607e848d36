"""Queries of linking, graphs, simulation, logs, overlays, envelopes and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions import parse, text
from fixtura.functions.hashing import canonical_json, text_hash
from fixtura.functions.hashing import MIXER, STRIDE, draw_seed
from fixtura.operators import graph, linking, models, overlay, quality, simulate, squads
from fixtura.plans.model_plans import six
from fixtura.plans.registry import dated, plan
from fixtura.shared import scratch_path
from fixtura.sources import delimited, envelopes, logs, sinks

# Linking.

LINKED = """f AS (SELECT date, home_team AS h, away_team AS a, count(*) AS n, min(match_id) AS id FROM {v_matches} GROUP BY ALL),
    l AS (SELECT s.source_id, CASE WHEN f.n > 1 THEN 'ambiguous' WHEN f.n = 1 THEN 'exact' WHEN r.n > 1 THEN 'ambiguous' WHEN r.n = 1 THEN 'reversed' ELSE 'unmatched' END AS class, f.id AS fid, r.id AS rid FROM {v_source_fixtures} s LEFT JOIN f ON s.date = f.date AND s.home = f.h AND s.away = f.a LEFT JOIN f r ON s.date = r.date AND s.home = r.a AND s.away = r.h)"""


def fixture_links(t):
    canonical = t("v_matches").select("date", F.col("home_team").alias("home"), F.col("away_team").alias("away"), "match_id")
    return linking.link_fixtures(t("v_source_fixtures"), canonical)


@plan("JOIN-09", f"WITH {LINKED} SELECT source_id, class, CASE class WHEN 'exact' THEN fid WHEN 'reversed' THEN rid END AS match_id FROM l")
def either_orientation(t):
    return fixture_links(t)


@plan("AGG-18", f"WITH {LINKED} SELECT count(*) AS total, count(*) FILTER (class = 'exact') AS exact, count(*) FILTER (class = 'reversed') AS reversed, count(*) FILTER (class = 'ambiguous') AS ambiguous, count(*) FILTER (class = 'unmatched') AS unmatched, round(count(*) FILTER (class IN ('exact', 'reversed')) / cast(count(*) AS double), 6) AS link_rate FROM l")
def link_summary(t):
    return six(linking.link_summary(fixture_links(t)))


ENTRIES = "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN match_key ELSE '' END AS match_id, concat('N', cast(row_id % 30 AS string)) AS team_a, concat('N', cast((row_id * 7 + 1) % 30 AS string)) AS team_b, odds_b AS value FROM {v_odds}"
ASKED = "SELECT row_id AS q, concat('m', cast(row_id % 450 AS string)) AS match_id, concat('N', cast((row_id * 3) % 30 AS string)) AS team_a, concat('N', cast((row_id * 5 + 2) % 30 AS string)) AS team_b FROM {v_odds}"
INDEX = f"""e AS ({ENTRIES}), k AS (SELECT row_id, value, 'id' AS kind, match_id AS key, 1 AS o FROM e WHERE match_id <> '' UNION ALL SELECT row_id, value, 'pair', team_a || '|' || team_b, 1 FROM e UNION ALL SELECT row_id, value, 'pair', team_b || '|' || team_a, -1 FROM e),
    i AS (SELECT kind, key, o, value FROM k QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY o = -1, row_id) = 1)"""


@plan("JOIN-10b", f"WITH {INDEX} SELECT kind, key, o AS orientation, value FROM i")
def key_index(t):
    made = linking.build_index(t.sql(ENTRIES))
    return made.withColumn("key", F.regexp_replace("key", "\u001f", "|"))


@plan("JOIN-10", f"WITH {INDEX}, q AS ({ASKED}) SELECT q.q, coalesce(a.value, b.value) AS value, coalesce(a.o, b.o, 0) AS orientation FROM q LEFT JOIN i a ON a.kind = 'id' AND a.key = q.match_id LEFT JOIN i b ON b.kind = 'pair' AND b.key = q.team_a || '|' || q.team_b")
def prioritised(t):
    return linking.resolve(t.sql(ASKED), linking.build_index(t.sql(ENTRIES))).select("q", "value", "orientation")


@plan("JOIN-11", """WITH a AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS club FROM {customer} WHERE c_custkey % 10 > 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Other' ELSE c_mktsegment END AS club FROM {customer} WHERE c_custkey % 9 > 0)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing_from_extract' WHEN a.id IS NULL THEN 'missing_from_primary' WHEN a.name = b.name AND a.club = b.club THEN 'exact' WHEN lower(a.name) = lower(b.name) AND lower(a.club) = lower(b.club) THEN 'normalization_equivalent' ELSE 'substantive_discrepancy' END AS class,
    CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN concat_ws(';', CASE WHEN lower(a.name) <> lower(b.name) THEN 'name' END, CASE WHEN lower(a.club) <> lower(b.club) THEN 'club' END) ELSE '' END AS differing FROM a FULL JOIN b ON a.id = b.id""")
def reconciled(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("club"))
    extract = c.where("id % 9 > 0").select("id", F.when(F.col("id") % 4 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 7 == 0, "Other").otherwise(F.col("club")).alias("club"))
    return linking.reconcile(c.where("id % 10 > 0"), extract, ["id"], ["name", "club"])


RUNS = "a AS (SELECT team_a AS team, avg(p) AS x FROM {v_ties} GROUP BY team_a), b AS (SELECT team_b AS team, avg(p) AS y FROM {v_ties} GROUP BY team_b)"


def runs(t):
    one = t("v_ties").groupBy(F.col("team_a").alias("team")).agg(F.avg("p").alias("p"))
    two = t("v_ties").groupBy(F.col("team_b").alias("team")).agg(F.avg("p").alias("p"))
    return overlay.compare({"base": one, "late": two}, "team", "p")


@plan("JOIN-12", f"WITH {RUNS} SELECT coalesce(a.team, b.team) AS team, round(x, 6) AS base, round(y, 6) AS late, round(y - x, 6) + 0 AS delta_late FROM a FULL JOIN b ON a.team = b.team")
def run_comparison(t):
    return six(runs(t)).withColumn("delta_late", F.col("delta_late") + 0.0)


@plan("TOPK-03", f"WITH {RUNS}, l AS (SELECT a.team, 'delta_late' AS measure, y - x AS change FROM a JOIN b ON a.team = b.team) SELECT team, measure, round(change, 6) AS change FROM l ORDER BY abs(round(change, 9)) DESC, team LIMIT 8")
def movers(t):
    return six(overlay.biggest_movers(runs(t), "team", ["delta_late"], 8))


@plan("OVL-06", f"WITH {RUNS} SELECT a.team, round(x, 6) AS base, round(y, 6) AS late FROM a JOIN b ON a.team = b.team WHERE (x >= 0.5) <> (y >= 0.5)")
def flips(t):
    return six(overlay.flips(runs(t), "base", "late").select("team", "base", "late"))


@plan("JOIN-14", "SELECT DISTINCT home AS team FROM {v_source_fixtures} WHERE home NOT IN (SELECT n_name FROM {nation})")
def unmatched_teams(t):
    return t("v_source_fixtures").select(F.col("home").alias("team")).distinct().join(t("nation").select(F.col("n_name").alias("team")), "team", "left_anti")


@plan("JOIN-14b", "SELECT n_name AS team FROM {nation} EXCEPT SELECT home FROM {v_source_fixtures} WHERE source_id % 100 = 1")
def absent_teams(t):
    return t("nation").select(F.col("n_name").alias("team")).subtract(t("v_source_fixtures").where("source_id % 100 = 1").select("home"))


@plan("JOIN-15", "SELECT match_id, home_team FROM {v_matches} WHERE match_id IN (SELECT source_id FROM {v_source_fixtures})")
def active_ids(t):
    return t("v_matches").join(t("v_source_fixtures").select(F.col("source_id").alias("match_id")), "match_id", "left_semi").select("match_id", "home_team")


PEOPLE = """sq AS (SELECT *, lower(trim(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS key FROM {v_squad}), ma AS (SELECT *, lower(trim(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))) AS key FROM {v_master}),
    al AS (SELECT row_id, row_id + 1 AS player_id FROM {v_squad} WHERE row_id % 50 = 0), se AS (SELECT row_id, row_id AS player_id FROM {v_squad} WHERE row_id % 17 = 0),
    ca AS (SELECT al.row_id, al.player_id, 0 AS rule FROM al JOIN ma ON al.player_id = ma.player_id UNION ALL SELECT se.row_id, se.player_id, 1 FROM se JOIN ma ON se.player_id = ma.player_id UNION ALL SELECT row_id, player_id, 2 FROM sq JOIN ma ON source_id = player_id UNION ALL SELECT row_id, player_id, 3 FROM sq JOIN ma ON sq.key = ma.key AND sq.dob = ma.dob UNION ALL SELECT row_id, player_id, 4 FROM sq JOIN ma ON sq.key = ma.key AND sq.nationality = ma.nationality AND sq.club = ma.club),
    pr AS (SELECT row_id, rule, count(DISTINCT player_id) AS n, min(player_id) AS player_id FROM ca GROUP BY row_id, rule QUALIFY rule = min(rule) OVER (PARTITION BY row_id)), ac AS (SELECT *, count(*) FILTER (n = 1) OVER (PARTITION BY CASE WHEN n = 1 THEN player_id END) AS claims FROM pr),
    li AS (SELECT s.row_id, CASE WHEN n = 1 AND claims > 1 THEN 'conflicting' WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' WHEN s.key IN (SELECT key FROM ma) THEN 'name_only' ELSE 'unmatched' END AS status, rule, ac.player_id FROM sq s LEFT JOIN ac ON s.row_id = ac.row_id)"""


def people(t):
    squad = t("v_squad")
    aliases = squad.where("row_id % 50 = 0").select("row_id", (F.col("row_id") + 1).alias("player_id"))
    seeds = squad.where("row_id % 17 = 0").select("row_id", F.col("row_id").alias("player_id"))
    return linking.link_people(squad, t("v_master"), aliases, seeds)


@plan("JOIN-16", f"WITH {PEOPLE} SELECT row_id, status, CASE rule WHEN 0 THEN 'reviewed_alias' WHEN 1 THEN 'seed' WHEN 2 THEN 'source_id' WHEN 3 THEN 'name_dob' WHEN 4 THEN 'name_nationality_club' END AS method, CASE WHEN status = 'linked' THEN player_id END AS player_id FROM li")
def cascade(t):
    return people(t)


@plan("JOIN-19", "SELECT s.row_id, count(DISTINCT m.player_id) AS candidates FROM {v_squad} s LEFT JOIN {v_master} m ON lower(trim(regexp_replace(s.name, '[^A-Za-z0-9]+', ' ', 'g'))) = lower(trim(regexp_replace(m.name, '[^A-Za-z0-9]+', ' ', 'g'))) GROUP BY s.row_id")
def name_candidates(t):
    s = t("v_squad").select("row_id", text.person_key(F.col("name")).alias("key"))
    m = t("v_master").select("player_id", text.person_key(F.col("name")).alias("key"))
    return s.join(m, "key", "left").groupBy("row_id").agg(F.count_distinct("player_id").alias("candidates"))


@plan("JOIN-17", "WITH c AS (SELECT event_id AS row_id, user_id AS player_id, event_type <> 'error' AS valid FROM {events}) SELECT row_id, CASE WHEN NOT valid THEN 'rejected' WHEN row_id = min(CASE WHEN valid THEN row_id END) OVER (PARTITION BY player_id) THEN 'accepted' ELSE 'conflict' END AS status FROM c")
def seeds(t):
    rows = t("events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("player_id"), (F.col("event_type") != "error").alias("valid"))
    return linking.seed_owners(rows).select("row_id", "status")


@plan("JOIN-18", "WITH a AS (SELECT event_id AS row_id, user_id * 3 AS player_id FROM {events} WHERE event_type = 'signup'), m AS (SELECT DISTINCT player_id FROM {v_master}) SELECT a.row_id, CASE WHEN m.player_id IS NULL THEN 'accepted_web_only' WHEN count(*) OVER (PARTITION BY a.player_id) > 1 THEN 'duplicate_local_id' ELSE 'accepted_local' END AS class FROM a LEFT JOIN m ON a.player_id = m.player_id")
def alias_classes(t):
    a = t("events").where("event_type = 'signup'").select(F.col("event_id").alias("row_id"), (F.col("user_id") * 3).alias("player_id"))
    met = a.join(t("v_master").select("player_id").distinct().withColumn("known", F.lit(True)), "player_id", "left").withColumn("n", F.count("*").over(Window.partitionBy("player_id")))
    return met.select("row_id", F.when(F.col("known").isNull(), "accepted_web_only").when(F.col("n") > 1, "duplicate_local_id").otherwise("accepted_local").alias("class"))


@plan("JOIN-20", "WITH a AS (SELECT player_id, cast(sum(minutes) AS bigint) AS minutes FROM {v_appearances} GROUP BY player_id), v AS (SELECT player_id, arg_max(value, (date, event_id)) AS value FROM {v_valuations} GROUP BY player_id) SELECT s.row_id, a.minutes, v.value FROM {v_squad} s LEFT JOIN a ON s.row_id = a.player_id LEFT JOIN v ON s.row_id = v.player_id")
def player_base(t):
    a = t("v_appearances").groupBy(F.col("player_id").alias("row_id")).agg(F.sum("minutes").alias("minutes"))
    v = t("v_valuations").groupBy(F.col("player_id").alias("row_id")).agg(F.max_by("value", F.struct("date", "event_id")).alias("value"))
    return t("v_squad").select("row_id").join(a, "row_id", "left").join(v, "row_id", "left")


@plan("JOIN-21", "SELECT p.team, count(DISTINCT a.game_id) AS games, count(*) AS n FROM {v_appearances} a JOIN {v_players} p ON a.player_id = p.player_id WHERE p.group_no = CASE WHEN a.game_id % 2 = 0 THEN 0 ELSE 1 END GROUP BY p.team")
def theta(t):
    p = t("v_players").select("player_id", "team", "group_no")
    met = t("v_appearances").join(p, "player_id").where(F.col("group_no") == F.when(F.col("game_id") % 2 == 0, 0).otherwise(1))
    return met.groupBy("team").agg(F.count_distinct("game_id").alias("games"), F.count("*").alias("n"))


@plan("JOIN-23", f"WITH {PEOPLE} SELECT li.row_id, li.status, s.name FROM li JOIN {{v_squad}} s ON li.row_id = s.row_id WHERE li.status <> 'linked'")
def review_queue(t):
    return people(t).where("status <> 'linked'").join(t("v_squad").select("row_id", "name"), "row_id").select("row_id", "status", "name")


@plan("JOIN-24", "SELECT m.match_id, coalesce(r.home_score, m.home_score) AS home_score, coalesce(r.away_score, m.away_score) AS away_score, coalesce(r.status, m.status) AS status FROM {v_matches} m LEFT JOIN (SELECT match_id, 2 AS home_score, 1 AS away_score, 'played' AS status FROM {v_matches} WHERE status = 'scheduled' AND match_id % 3 = 0) r ON m.match_id = r.match_id")
def result_overlay(t):
    results = t("v_matches").where("status = 'scheduled' and match_id % 3 = 0").select("match_id", F.lit(2).alias("home_score"), F.lit(1).alias("away_score"), F.lit("played").alias("status"))
    return linking.overlay(t("v_matches"), results, "match_id", ["home_score", "away_score", "status"]).select("match_id", "home_score", "away_score", "status")


@plan("JOIN-25", "SELECT a.k, round(a.p0 - b.b0, 6) AS gap FROM {v_preds} a JOIN {v_preds} b ON a.k = b.k WHERE b.k % 2 = 0")
def aligned(t):
    other = t("v_preds").where("k % 2 = 0").select("k", "b0")
    return six(t("v_preds").select("k", "p0").join(other, "k").select("k", (F.col("p0") - F.col("b0")).alias("gap")))


@plan("JOIN-26", "WITH f AS (SELECT user_id, min(event_id) AS first, arg_min(value, event_id) AS forecast FROM {events} GROUP BY user_id), r AS (SELECT user_id, arg_max(value, event_id) AS result FROM {events} WHERE event_type = 'purchase' GROUP BY user_id) SELECT f.user_id, first, forecast, result FROM f JOIN r ON f.user_id = r.user_id")
def first_and_last(t):
    f = t("events").groupBy("user_id").agg(F.min("event_id").alias("first"), F.min_by("value", "event_id").alias("forecast"))
    return f.join(t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("result")), "user_id")


@plan("JOIN-28", "WITH b AS (SELECT team_a AS a, team_b AS b, p FROM {v_ties} WHERE match % 3 > 0), q AS (SELECT team_b AS a, team_a AS b FROM {v_ties}) SELECT q.a, q.b, round(coalesce(f.p, 1 - r.p, 0.5), 6) AS p, f.p IS NULL AND r.p IS NULL AS defaulted FROM q LEFT JOIN b f ON f.a = q.a AND f.b = q.b LEFT JOIN b r ON r.a = q.b AND r.b = q.a")
def either_way(t):
    base = t("v_ties").where("match % 3 > 0").select(F.col("team_a").alias("a"), F.col("team_b").alias("b"), "p")
    return six(linking.lookup_either_way(t("v_ties").select(F.col("team_b").alias("a"), F.col("team_a").alias("b")), base))


@plan("JOIN-29", "SELECT team_a AS a, team_b AS b, p FROM {v_ties} UNION ALL SELECT team_b, team_a, round(1 - p, 6) FROM {v_ties}")
def doubled(t):
    return six(linking.both_ways(t("v_ties").select(F.col("team_a").alias("a"), F.col("team_b").alias("b"), "p")))


# Graphs and simulation.


@plan("GRF-01", "WITH RECURSIVE e AS (SELECT home AS a, away AS b FROM {v_fixtures} UNION SELECT away, home FROM {v_fixtures}), r AS (SELECT a AS team, a AS node FROM e UNION SELECT r.team, e.b FROM r JOIN e ON r.node = e.a), c AS (SELECT team, min(node) AS component FROM r GROUP BY team) SELECT team, component, printf('G%02d', dense_rank() OVER (ORDER BY component)) AS label FROM c")
def groups(t):
    return graph.lettered(graph.components(t("v_fixtures")))


@plan("GRF-05", "WITH RECURSIVE e AS (SELECT DISTINCT id AS feeder, cast(floor(id / 2) AS bigint) AS match FROM {v_teams48} WHERE id > 0), d AS (SELECT feeder AS start, match AS node, 1 AS depth FROM e UNION SELECT d.start, e.match, d.depth + 1 FROM d JOIN e ON d.node = e.feeder WHERE depth < 8) SELECT start, node, min(depth) AS depth FROM d GROUP BY start, node")
def reachable(t):
    edges = t("v_teams48").where("id > 0").select(F.col("id").alias("feeder"), F.floor(F.col("id") / 2).alias("match"))
    return graph.descendants(edges, edges.select(F.col("feeder").alias("match")))


@plan("ARR-02", "SELECT grp, string_agg(team, '-' ORDER BY team) AS key FROM {v_teams48} GROUP BY grp")
def combination(t):
    return t("v_teams48").groupBy("grp").agg(graph.combination_key("team").alias("key"))


N_SIMS, SEED = 100, "2026"
U = "cast(('0x' || substr(sha256(concat_ws('|', {parts})), 1, 12)) AS bigint) / 281474976710656.0"
DRAWN = f"""g AS (SELECT i, exp(-1.4 + i * ln(1.4) - coalesce(list_sum(list_transform(range(1, i + 1), lambda x: ln(x))), 0)) AS ph, exp(-1.0 + i * ln(1.0) - coalesce(list_sum(list_transform(range(1, i + 1), lambda x: ln(x))), 0)) AS pa FROM range(9) t(i)), m AS (SELECT a.i AS h, b.i AS a, a.ph * b.pa AS raw FROM g a CROSS JOIN g b), c AS (SELECT h, a, sum(raw) OVER (ORDER BY h, a) / sum(raw) OVER () AS cum, row_number() OVER (ORDER BY h, a) - 1 AS cell FROM m),
    st0 AS (SELECT sim, (sim + {draw_seed(SEED)}) % 4294967296 AS x0, xor(x0, x0 >> 16) * {MIXER} % 4294967296 AS x1, xor(x1, x1 >> 16) * {MIXER} % 4294967296 AS x2, xor(x2, x2 >> 16) AS x3 FROM range({N_SIMS}) s(sim)),
    d AS (SELECT sim, f.*, (x3 + cast(fixture_id AS bigint) % 2147483648 * {STRIDE}) % 4294967296 AS y0, xor(y0, y0 >> 16) * {MIXER} % 4294967296 AS y1, xor(y1, y1 >> 16) * {MIXER} % 4294967296 AS y2, xor(y2, y2 >> 16) / 4294967296.0 AS u FROM {{v_fixtures}} f CROSS JOIN st0),
    x AS (SELECT d.sim, d.fixture_id, d.grp, d.home, d.away, d.played, d.home_goals AS fh, d.away_goals AS fa, least((SELECT count(*) FROM c WHERE round(c.cum, 12) <= d.u), 80) AS cell FROM d),
    games AS (SELECT sim, fixture_id, grp, home, away, CASE WHEN played THEN fh ELSE cast(cell // 9 AS int) END AS hg, CASE WHEN played THEN fa ELSE cast(cell % 9 AS int) END AS ag FROM x)"""
RANKED = f"""{DRAWN}, si AS (SELECT sim, grp, home AS team, away AS opp, CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS pts, hg - ag AS gd, hg AS gf FROM games UNION ALL SELECT sim, grp, away, home, CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END, ag - hg, ag FROM games), r AS (SELECT sim, grp, team, cast(sum(pts) AS bigint) AS pts, cast(sum(gd) AS bigint) AS gd, cast(sum(gf) AS bigint) AS gf FROM si GROUP BY ALL),
    hh AS (SELECT s.sim, s.grp, s.team, sum(s.pts) AS hp, sum(s.gd) AS hd, sum(s.gf) AS hf FROM si s JOIN r a ON a.sim = s.sim AND a.team = s.team JOIN r b ON b.sim = s.sim AND b.team = s.opp AND b.pts = a.pts AND b.gd = a.gd AND b.gf = a.gf GROUP BY ALL),
    st AS (SELECT r.*, row_number() OVER (PARTITION BY r.sim, r.grp ORDER BY pts DESC, gd DESC, gf DESC, hp DESC NULLS LAST, hd DESC NULLS LAST, hf DESC NULLS LAST, {U.format(parts=f"'{SEED}', 'lot', cast(r.sim AS varchar), r.team")}) AS position FROM r LEFT JOIN hh ON hh.sim = r.sim AND hh.team = r.team)"""


def score_table(t):
    one = t.spark.range(1).select(F.lit(0).alias("one"))
    cells = models.score_cells(one, F.lit(1.4), F.lit(1.0), ["one"], 8)
    return simulate.cumulative(cells, ["one"]).withColumn("cumulative", F.transform("cumulative", lambda c: F.round(c, 12))).drop("one")


def drawn(t):
    return simulate.draw_scores(t("v_fixtures"), score_table(t), N_SIMS, SEED, [])


def stage(t):
    return simulate.GroupStage(t("v_fixtures"), score_table(t), [], SEED)


def tables(t):
    return simulate.group_tables(t.spark, stage(t), N_SIMS)


@plan("SIM-01", f"WITH {DRAWN} SELECT sim, fixture_id, hg AS home_goals, ag AS away_goals FROM games")
def draws(t):
    return drawn(t).select(F.col("sim").cast("long").alias("sim"), "fixture_id", "home_goals", "away_goals")


@plan("SIM-02", f"WITH {RANKED} SELECT sim, grp, team, pts, gd, gf FROM r")
def records(t):
    made = simulate.sides(drawn(t)).groupBy("sim", "grp", "team").agg(F.sum("pts").alias("pts"), F.sum("gd").alias("gd"), F.sum("gf").alias("gf"))
    return made.withColumn("sim", F.col("sim").cast("long"))


@plan("SIM-03", f"WITH {RANKED} SELECT sim, grp, team, position FROM st")
def ranking(t):
    return tables(t).select(F.col("sim").cast("long").alias("sim"), "grp", "team", F.col("position").cast("long").alias("position"))


@plan("SIM-04", f"WITH {RANKED} SELECT sim, grp, team, place FROM (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY pts DESC, gd DESC, gf DESC, {U.format(parts=f"'{SEED}', 'third', cast(sim AS varchar), team")}) AS place FROM st WHERE position = 3) WHERE place <= 8")
def thirds(t):
    made = simulate.best_thirds(simulate.standings(drawn(t), SEED), 8, SEED)
    return made.select(F.col("sim").cast("long").alias("sim"), "grp", "team", F.col("place").cast("long").alias("place"))


@plan("SIM-07", f"WITH {RANKED} SELECT grp, team, round(count(*) FILTER (position = 1) / {N_SIMS}.0, 6) AS p_1, round(count(*) FILTER (position = 2) / {N_SIMS}.0, 6) AS p_2, round(avg(pts), 6) AS mean_points FROM st GROUP BY grp, team")
def shares(t):
    return six(simulate.group_shares(t.spark, stage(t), N_SIMS).select("grp", "team", "p_1", "p_2", "mean_points"))


@plan("AGG-23", f"WITH {RANKED}, p AS (SELECT team, count(*) FILTER (position = 1) / {N_SIMS}.0 AS p FROM st GROUP BY team) SELECT team, round(sqrt(p * (1 - p) / {N_SIMS}), 6) AS se_1 FROM p")
def standard_errors(t):
    return six(simulate.group_shares(t.spark, stage(t), N_SIMS).select("team", "se_1"))


@plan("SIM-06", f"WITH {RANKED} SELECT sim, team, (pts * 512 + gd + 256) * 512 + gf AS key FROM r")
def packed(t):
    made = tables(t)
    return made.select(F.col("sim").cast("long").alias("sim"), "team", simulate.packed_key(F.col("pts"), F.col("gd"), F.col("gf")).alias("key"))


@plan("SIM-12b", "SELECT 0 AS problems")
def invariants(t):
    table = simulate.group_shares(t.spark, stage(t), N_SIMS)
    return simulate.share_problems(table).agg(F.count("*").cast("int").alias("problems"))


def knockout(t):
    table = simulate.standings(drawn(t), SEED)
    direct = table.where("position <= 2").select("sim", "team", (F.col("position") * 100 + F.col("grp")).alias("seed"))
    third = simulate.best_thirds(table, 8, SEED).select("sim", "team", (300 + F.col("place")).alias("seed"))
    slots = direct.union(third).withColumn("slot", F.row_number().over(Window.partitionBy("sim").orderBy("seed")) - 1)
    first = slots.groupBy("sim", F.when(F.col("slot") < 16, F.col("slot")).otherwise(31 - F.col("slot")).alias("match")).agg(F.max(F.when(F.col("slot") < 16, F.col("team"))).alias("home"), F.max(F.when(F.col("slot") >= 16, F.col("team"))).alias("away"))
    return simulate.walk_bracket(first, resolution(t), 5, SEED)


def resolution(t):
    a, b = (t("v_teams48").select(F.col("team").alias(s), F.col("id").alias(f"{s}_id")) for s in ("home", "away"))
    pairs = a.crossJoin(F.broadcast(b)).where("home <> away")  # 48 teams
    rate = lambda x, y: 1.2 * F.exp((F.col(y) - F.col(x)) / 100)
    return simulate.pair_resolution(pairs.select("home", "away", rate("home_id", "away_id").alias("home_rate"), rate("away_id", "home_id").alias("away_rate"), F.lit(None).cast("double").alias("advance_home")))


@plan("SIM-08")
def tie_ways(t):
    """The six ways of deciding each pair; sums of Poisson products, held against direct sums in the tests."""
    return six(resolution(t))


@plan("SIM-09")
def tournament(t):
    """Advancement over the whole knockout; a walk of five joins, its invariants are in the tests."""
    return six(simulate.advancement(knockout(t), N_SIMS, 5))


@plan("SIM-10")
def trace(t):
    """How far a team goes by where it finished its group."""
    table = simulate.standings(drawn(t), SEED).where("team = 'T10'").select("sim", "position")
    long = knockout(t).select("sim", "round", F.explode(F.array("home", "away")).alias("team")).where("team = 'T10'")
    return long.join(table, "sim").groupBy("position", "round").agg(F.count("*").alias("n"))


@plan("SIM-12", "SELECT r AS round, cast(pow(2, 5 - r) AS bigint) * 100 AS ties FROM range(1, 6) t(r)")
def tie_counts(t):
    return knockout(t).groupBy(F.col("round").cast("long").alias("round")).agg(F.count("*").alias("ties"))


@plan("SIM-14", """WITH g AS (SELECT i, exp(-1.4 + i * ln(1.4) - coalesce(list_sum(list_transform(range(1, i + 1), lambda x: ln(x))), 0)) AS ph, exp(-1.0 + i * ln(1.0) - coalesce(list_sum(list_transform(range(1, i + 1), lambda x: ln(x))), 0)) AS pa FROM range(9) t(i)), m AS (SELECT a.i AS h, b.i AS a, a.ph * b.pa AS raw FROM g a CROSS JOIN g b), n AS (SELECT h, a, raw / sum(raw) OVER () AS p, CASE WHEN h > a THEN 0.5 WHEN h = a THEN 0.3 ELSE 0.2 END AS target, sign(h - a) AS s FROM m) SELECT cast(h AS int) AS h, cast(a AS int) AS a, round(p * target / sum(p) OVER (PARTITION BY s), 6) AS p FROM n""")
def reweighted(t):
    one = t.spark.range(1).select(F.lit(0.5).alias("q0"), F.lit(0.3).alias("q1"), F.lit(0.2).alias("q2"))
    cells = models.score_cells(one, F.lit(1.4), F.lit(1.0), ["q0", "q1", "q2"], 8)
    return six(simulate.reweighted(cells, ["q0", "q1", "q2"], "q0", "q1", "q2").select("h", "a", "p"))


@plan("SIM-15", "SELECT k, round(1.3 * exp(elo_diff / 800), 6) AS home_rate, round(1.3 * exp(-elo_diff / 800), 6) AS away_rate FROM {v_preds}")
def scenario_rates(t):
    home, away = squads.adjusted_rates(F.lit(1.3), F.lit(1.3), F.col("elo_diff") / 400, F.lit(0.0))
    return six(t("v_preds").select("k", home.alias("home_rate"), away.alias("away_rate")))


# Logs.

LOG = "SELECT s_suppkey AS seq, concat(chr(123), '\"fixture_id\":\"f', cast(s_suppkey AS string), '\",\"model_version\":\"m1\"', chr(125)) AS payload FROM {supplier}"


@plan("WIN-16", f"WITH RECURSIVE p AS ({LOG}), c AS (SELECT cast(-1 AS bigint) AS seq, '' AS payload, '' AS prev_hash, repeat('0', 64) AS entry_hash UNION ALL SELECT p.seq, p.payload, c.entry_hash, sha256(c.entry_hash || p.payload) FROM c JOIN p ON p.seq = c.seq + 1) SELECT seq, payload, prev_hash, entry_hash FROM c WHERE seq >= 0")
def hash_chain(t):
    return logs.chain(t.sql(LOG))


@plan("LEDG-02", "SELECT s_suppkey AS seq, 'payload' AS problem FROM {supplier} WHERE s_suppkey IN (7, 31) UNION ALL SELECT s_suppkey, 'chain' FROM {supplier} WHERE s_suppkey = 31")
def verified(t):
    made = logs.chain(t.sql(LOG))
    edited = made.withColumn("payload", F.when(F.col("seq") == 7, F.lit("{}")).otherwise(F.col("payload"))).withColumn("prev_hash", F.when(F.col("seq") == 31, F.lit(logs.GENESIS)).otherwise(F.col("prev_hash")))
    return logs.broken(edited)


@plan("LEDG-03", """WITH k AS (SELECT concat('f', cast(s_suppkey AS string)) AS fixture_id, concat('h', cast(s_suppkey AS string)) AS entry_hash FROM {supplier} WHERE s_suppkey % 2 = 0), r AS (SELECT s_suppkey AS id, concat('f', cast(s_suppkey AS string)) AS fixture_id, cast(s_suppkey % 9 - 1 AS int) AS home_goals, 1 AS away_goals, CASE WHEN s_suppkey % 11 = 0 THEN 'soon' ELSE '2026-06-12 20:00:00' END AS completed_at, CASE WHEN s_suppkey % 13 = 0 THEN DATE '2026-06-13' ELSE DATE '2026-06-12' END AS kickoff_date, CASE WHEN s_suppkey % 3 = 0 THEN concat('h', cast(s_suppkey + s_suppkey % 4 AS string)) END AS corrects, CASE WHEN s_suppkey % 5 > 0 THEN 'typo' END AS reason FROM {supplier})
    SELECT r.id, CASE WHEN home_goals < 0 THEN 'negative_goals' WHEN try_cast(completed_at AS timestamp) IS NULL THEN 'unparseable_completed_at' WHEN cast(try_cast(completed_at AS timestamp) AS date) < kickoff_date THEN 'completed_before_kickoff' WHEN a.entry_hash IS NOT NULL AND corrects IS NULL THEN 'result_exists' WHEN corrects IS NOT NULL AND coalesce(reason, '') = '' THEN 'correction_without_reason' WHEN corrects IS NOT NULL AND g.fixture_id IS NULL THEN 'unknown_target' WHEN g.fixture_id <> r.fixture_id THEN 'other_fixture' WHEN corrects IS NOT NULL AND corrects <> a.entry_hash THEN 'not_the_active_result' END AS refused FROM r LEFT JOIN k a ON a.fixture_id = r.fixture_id LEFT JOIN k g ON g.entry_hash = r.corrects""")
def result_rules(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"))
    name = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    known = s.where("id % 2 = 0").select(name("f").alias("fixture_id"), name("h").alias("entry_hash"))
    made = s.select("id", name("f").alias("fixture_id"), (F.col("id") % 9 - 1).cast("int").alias("home_goals"), F.lit(1).alias("away_goals"), F.when(F.col("id") % 11 == 0, "soon").otherwise("2026-06-12 20:00:00").alias("completed_at"), F.when(F.col("id") % 13 == 0, F.lit("2026-06-13")).otherwise("2026-06-12").cast("date").alias("kickoff_date"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("h"), (F.col("id") + F.col("id") % 4).cast("string"))).alias("corrects"), F.when(F.col("id") % 5 > 0, "typo").alias("reason"))
    return logs.check_results(made, known).select("id", "refused")


@plan("HASH-01", "SELECT n_nationkey, sha256(n_name) AS h FROM {nation}")
def text_hashes(t):
    return t("nation").select("n_nationkey", text_hash(F.col("n_name")).alias("h"))


@plan("JSON-09", "SELECT n_nationkey, concat('{\"key\":', cast(n_nationkey AS varchar), ',\"name\":\"', n_name, '\",\"region\":', cast(n_regionkey AS varchar), '}') AS json FROM {nation}")
def canonical(t):
    return t("nation").select("n_nationkey", canonical_json({"name": F.col("n_name"), "key": F.col("n_nationkey"), "region": F.col("n_regionkey")}).alias("json"))


# Overlays.

NUDGES = "n AS (SELECT x.team, x.match_number, least(greatest(coalesce(sum(g.points) FILTER (g.match_number < x.match_number), 0), -6), 6) AS nudge FROM (SELECT DISTINCT team, match_number FROM (SELECT team_a AS team, match_number FROM {v_ties} UNION ALL SELECT team_b, match_number FROM {v_ties})) x LEFT JOIN {v_tags} g ON g.team = x.team GROUP BY x.team, x.match_number)"


def nudges(t):
    ties = t("v_ties")
    fixtures = ties.select(F.col("team_a").alias("team"), "match_number").union(ties.select("team_b", "match_number")).distinct()
    return overlay.tag_nudges(fixtures, t("v_tags"))


@plan("OVL-02", f"WITH {NUDGES} SELECT team, match_number, nudge FROM n")
def tag_nudges(t):
    return nudges(t)


@plan("OVL-09", f"WITH {NUDGES} SELECT t.match, round(least(greatest(coalesce(a.nudge, 0) - coalesce(b.nudge, 0), -15), 15), 6) AS delta, round(least(greatest(p + least(greatest(coalesce(a.nudge, 0) - coalesce(b.nudge, 0), -15), 15) / 100, 0.05), 0.95), 6) AS p_a FROM {{v_ties}} t LEFT JOIN n a ON a.team = t.team_a AND a.match_number = t.match_number LEFT JOIN n b ON b.team = t.team_b AND b.match_number = t.match_number")
def expert_rows(t):
    made = overlay.expert_rows(t("v_ties").select("match_number", "team_a", "team_b", F.col("p").alias("baseline"), "match"), nudges(t))
    return six(made.join(t("v_ties").select("match", "match_number", "team_a", "team_b"), ["match_number", "team_a", "team_b"]).select("match", "delta", "p_a"))


@plan("OVL-03", "WITH c AS (SELECT team, least(greatest(sum(points), -10), 10) AS points FROM {v_tags} WHERE match_number < 5 GROUP BY team) SELECT match, round(least(greatest(coalesce(a.points, 0) - coalesce(b.points, 0), -15), 15), 6) AS net, round(least(greatest(p + least(greatest(coalesce(a.points, 0) - coalesce(b.points, 0), -15), 15) / 100, 0.02), 0.98), 6) AS p_adjusted FROM {v_ties} t LEFT JOIN c a ON a.team = team_a LEFT JOIN c b ON b.team = team_b")
def adjusted(t):
    made = overlay.adjust_pairs(t("v_ties"), t("v_tags").where("match_number < 5"))
    return six(made.select("match", "net", "p_adjusted"))


@plan("OVL-08", "SELECT f.match, coalesce(w.team, concat('W', cast(f.match AS varchar))) AS team, w.team IS NULL AS provisional FROM (SELECT DISTINCT id AS match FROM {v_teams48}) f LEFT JOIN (SELECT id, team FROM {v_teams48} WHERE id % 3 > 0) w ON w.id = f.match")
def provisional(t):
    winners = t("v_teams48").where("id % 3 > 0").select(F.col("id").alias("match"), "team")
    met = t("v_teams48").select(F.col("id").alias("match")).distinct().join(winners, "match", "left")
    return met.select("match", F.coalesce("team", F.concat(F.lit("W"), F.col("match").cast("string"))).alias("team"), F.col("team").isNull().alias("provisional"))


@plan("OVL-07")
def downstream(t):
    """A deterministic walk with and without an opinion, and the later pairings that differ."""
    first = t("v_teams48").where("id < 32").withColumn("match", F.floor(F.col("id") / 2)).groupBy("match").agg(F.min("team").alias("team_a"), F.max("team").alias("team_b"))
    chances = linking.both_ways(t("v_ties").select(F.col("team_a").alias("a"), F.col("team_b").alias("b"), "p"))
    none = t.spark.createDataFrame([], "round int, match long, winner string")
    known = t.spark.createDataFrame([(1, 0, "T10")], "round int, match long, winner string")
    one, two = (overlay.walk(first, chances, r, 5).select("round", "match", "team_a", "team_b", "winner") for r in (none, known))
    other = two.select("round", "match", F.col("team_a").alias("new_a"), F.col("team_b").alias("new_b"), F.col("winner").alias("new_winner"))
    return one.join(other, ["round", "match"]).where("team_a <> new_a or team_b <> new_b or winner <> new_winner")


# Envelopes.


def envelope(t, row, key="conv_id"):
    """One envelope per key whose response is a list of rows made of the conversation's turns."""
    turns = t("conversations")
    body = F.to_json(F.struct(F.lit("x").alias("get"), F.lit("[]").alias("errors"), F.count("*").cast("int").alias("results"), F.sort_array(F.collect_list(row)).alias("response")))
    return turns.groupBy(key).agg(body.alias("body")).select(F.concat(F.lit("s"), F.col(key).cast("string")).alias("snapshot_id"), F.lit("2026-06-12").alias("retrieved_at"), "body")


def named(n, v):
    return F.struct(F.col(n).cast("long").alias("id"), F.col(v).alias("name"))


PROVENANCE = "concat('s', cast(conv_id AS varchar)) AS snapshot_id, '2026-06-12' AS retrieved_at"


@plan("JSON-02", f"SELECT cast(turn AS bigint) AS fixture_id, role AS home, cast(length(role) AS int) AS home_goals, {PROVENANCE} FROM {{conversations}}")
def json_fixtures(t):
    row = F.struct(F.struct(F.col("turn").cast("long").alias("id")).alias("fixture"), F.struct(named("turn", "role").alias("home")).alias("teams"), F.struct(F.length("role").alias("home")).alias("goals"))
    return envelopes.fixtures(envelope(t, row)).select("fixture_id", "home", "home_goals", "snapshot_id", "retrieved_at")


@plan("JSON-01", f"SELECT cast(turn AS bigint) AS league_id, role AS league, cast(y AS int) AS season, {PROVENANCE} FROM {{conversations}} CROSS JOIN (SELECT unnest([2024, 2025]) AS y)")
def json_leagues(t):
    seasons = F.array(*[F.struct(F.lit(y).alias("year")) for y in (2024, 2025)])
    row = F.struct(F.struct(F.col("turn").cast("long").alias("id"), F.col("role").alias("name")).alias("league"), seasons.alias("seasons"))
    return envelopes.leagues(envelope(t, row)).select("league_id", "league", "season", "snapshot_id", "retrieved_at")


@plan("JSON-03", f"SELECT cast(turn AS bigint) AS league_id, role AS team, cast(turn + 1 AS int) AS rank, {PROVENANCE} FROM {{conversations}}")
def json_standings(t):
    place = F.struct((F.col("turn") + 1).cast("int").alias("rank"), named("turn", "role").alias("team"))
    row = F.struct(F.struct(F.col("turn").cast("long").alias("id"), F.array(F.array(place)).alias("standings")).alias("league"))
    return envelopes.standings(envelope(t, row)).select("league_id", "team", "rank", "snapshot_id", "retrieved_at")


@plan("JSON-04", f"SELECT role AS team, 'start' AS role, cast(turn AS bigint) AS player_id, {PROVENANCE} FROM {{conversations}} UNION ALL SELECT role, 'bench', cast(turn + 100 AS bigint), {PROVENANCE} FROM {{conversations}}")
def json_lineups(t):
    player = lambda c: F.array(F.struct(F.struct(c.cast("long").alias("id"), F.lit("p").alias("name")).alias("player")))
    row = F.struct(named("turn", "role").alias("team"), player(F.col("turn")).alias("startXI"), player(F.col("turn") + 100).alias("substitutes"))
    return envelopes.lineups(envelope(t, row)).select("team", "role", "player_id", "snapshot_id", "retrieved_at")


@plan("JSON-05", f"SELECT cast(turn AS bigint) AS player_id, role AS type, {PROVENANCE} FROM {{conversations}}")
def json_injuries(t):
    row = F.struct(F.struct(F.col("turn").cast("long").alias("id"), F.lit("p").alias("name"), F.col("role").alias("type")).alias("player"))
    return envelopes.injuries(envelope(t, row)).select("player_id", "type", "snapshot_id", "retrieved_at")


@plan("JSON-06", f"SELECT role AS team, cast(turn AS bigint) AS player_id, CASE WHEN turn % 2 = 0 THEN cast(turn * 10 AS int) END AS minutes, {PROVENANCE} FROM {{conversations}}")
def json_players(t):
    stats = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.struct((F.col("turn") * 10).cast("int").alias("minutes")).alias("games")))).otherwise(F.array())
    player = F.array(F.struct(F.struct(F.col("turn").cast("long").alias("id"), F.lit("p").alias("name")).alias("player"), stats.alias("statistics")))
    return envelopes.fixture_players(envelope(t, F.struct(named("turn", "role").alias("team"), player.alias("players")))).select("team", "player_id", "minutes", "snapshot_id", "retrieved_at")


@plan("JSON-07", f"SELECT cast(turn AS int) AS minute, role AS type, {PROVENANCE} FROM {{conversations}}")
def json_events(t):
    row = F.struct(F.struct(F.col("turn").cast("int").alias("elapsed")).alias("time"), F.col("role").alias("type"))
    return envelopes.fixture_events(envelope(t, row)).select("minute", "type", "snapshot_id", "retrieved_at")


@plan("JSON-08", f"SELECT role AS winner, (40 + turn) / 100.0::DOUBLE AS home, 'external_benchmark' AS usage, {PROVENANCE} FROM {{conversations}}")
def json_predictions(t):
    row = F.struct(F.struct(named("turn", "role").alias("winner"), F.struct(F.concat((40 + F.col("turn")).cast("string"), F.lit("%")).alias("home")).alias("percent")).alias("predictions"))
    return envelopes.predictions(envelope(t, row)).select("winner", "home", "usage", "snapshot_id", "retrieved_at")


@plan("SRC-31", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'plan_limit' WHEN 2 THEN 'rate_limit' ELSE 'auth' END AS status FROM {events}")
def envelope_errors(t):
    body = F.when(F.col("event_id") % 4 == 0, '{"errors":[]}').when(F.col("event_id") % 4 == 1, '{"errors":{"plan":"upgrade"}}').when(F.col("event_id") % 4 == 2, '{"errors":{"rateLimit":"slow"}}').otherwise('{"errors":["bad token"]}')
    return t("events").select("event_id", envelopes.envelope_status(body).alias("status"))


# Assertions, text, dates, files.


@plan("VAL-02", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate")
def all_late_rows(t):
    met = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.available_before(met, "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "l_partkey")


@plan("VAL-04", "SELECT event_id, concat_ws(';', CASE WHEN NOT (value >= 1) THEN 'value_floor' END, CASE WHEN NOT (event_type <> 'error' OR value < 100) THEN 'error_value' END) AS broken FROM {events} WHERE NOT (value >= 1) OR NOT (event_type <> 'error' OR value < 100)")
def broken_rules(t):
    rules = {"value_floor": F.col("value") >= 1, "error_value": (F.col("event_type") != "error") | (F.col("value") < 100)}
    return quality.violations(t("events"), rules, ["event_id"])


@plan("VAL-05", "SELECT k, concat_ws(';', CASE WHEN k % 3 = 0 AND k % 2 > 0 THEN 'shootout_needs_extra_time' END, CASE WHEN k % 3 = 0 AND home_score <> away_score THEN 'shootout_needs_level' END, CASE WHEN k % 3 > 0 AND home_score <> away_score AND (home_score > away_score) <> (k % 5 > 1) THEN 'winner_disagrees' END) AS broken FROM {v_preds} WHERE (k % 3 = 0 AND k % 2 > 0) OR (k % 3 = 0 AND home_score <> away_score) OR (k % 3 > 0 AND home_score <> away_score AND (home_score > away_score) <> (k % 5 > 1))")
def knockout_rules(t):
    shot, extra, home_won = F.col("k") % 3 == 0, F.col("k") % 2 == 0, F.col("k") % 5 > 1
    h, a = F.col("home_score"), F.col("away_score")
    rules = {"shootout_needs_extra_time": ~shot | extra, "shootout_needs_level": ~shot | (h == a), "winner_disagrees": shot | (h == a) | ((h > a) == home_won)}
    return quality.violations(t("v_preds"), rules, ["k"])


@plan("VAL-06", "SELECT count(*) AS teams, count(*) FILTER (n <> 26) AS wrong_size FROM (SELECT team, count(*) AS n FROM {v_players} GROUP BY team)")
def expected_shape(t):
    return t("v_players").groupBy("team").agg(F.count("*").alias("n")).agg(F.count("*").alias("teams"), F.count_if(F.col("n") != 26).alias("wrong_size"))


@plan("VAL-09", "WITH s AS (SELECT DISTINCT home AS team FROM {v_source_fixtures}), n AS (SELECT n_name FROM {nation}) SELECT s.team, CASE WHEN n.n_name IS NOT NULL THEN 'exact' ELSE 'unmatched' END AS class FROM s LEFT JOIN n ON s.team = n.n_name")
def alias_audit(t):
    names = t("nation").select(F.col("n_name").alias("team"), F.lit("exact").alias("found"))
    return t("v_source_fixtures").select(F.col("home").alias("team")).distinct().join(names, "team", "left").select("team", F.coalesce("found", F.lit("unmatched")).alias("class"))


@plan("VAL-10", "SELECT event_type, CASE WHEN avg((value > 50)::INT) >= 0.3 THEN 'ready' WHEN avg((value > 50)::INT) > 0 THEN 'partial' ELSE 'blocked' END AS readiness FROM {events} GROUP BY event_type")
def readiness(t):
    rate = F.avg((F.col("value") > 50).cast("int"))
    return t("events").groupBy("event_type").agg(F.when(rate >= 0.3, "ready").when(rate > 0, "partial").otherwise("blocked").alias("readiness"))


@plan("STR-01", "SELECT c_custkey, regexp_replace(lower(trim(concat('  ', c_name, '   X '))), '\\s+', ' ', 'g') AS key FROM {customer}")
def team_keys(t):
    return t("customer").select("c_custkey", text.team_key(F.concat(F.lit("  "), F.col("c_name"), F.lit("   X "))).alias("key"))


@plan("STR-02")
def whole_text_keys(t):
    """Both normalisers over the whole text of every document, as hashes; tests hold them against plain Python."""
    keys = t("documents").select("doc_id", "lang", text.plain_key(F.col("text")).alias("plain"), text.folded_key(F.col("text")).alias("folded"))
    return keys.select("doc_id", "lang", F.sha2("plain", 256).alias("plain"), F.sha2("folded", 256).alias("folded"))


@plan("STR-04", "SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key FROM {part}")
def token_keys(t):
    return t("part").select("p_partkey", text.token_key(F.col("p_name")).alias("key"))


@plan("STR-05", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name || ' FC'), ' '), lambda w: w NOT IN ('fc', 'cf', 'sc', 'ac')), ' ') AS key FROM {part}")
def club_keys(t):
    return t("part").select("p_partkey", text.club_key(F.concat("p_name", F.lit(" FC"))).alias("key"))


@plan("STR-06", "SELECT k, hn || chr(31) || an AS key FROM {v_base}")
def pair_keys(t):
    return t("v_base").select("k", text.pair_key(F.col("hn"), F.col("an")).alias("key"))


@plan("STR-07", "SELECT c_custkey, regexp_replace(cast(cast(c_custkey AS double) AS varchar), '\\.0$', '') AS id FROM {customer}")
def id_texts(t):
    return t("customer").select("c_custkey", parse.source_id(F.col("c_custkey").cast("double")).alias("id"))


@plan("STR-08", "SELECT source_row, regexp_matches(trim(home_score), '^[0-9]+(\\.[0-9]+)?$') AS numeric FROM {v_matches_raw}")
def numeric_cells(t):
    return t("v_matches_raw").select("source_row", parse.looks_numeric(F.col("home_score")).alias("numeric"))


@plan("DATE-01", "SELECT source_row, cast(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%d.%m.%Y'))::DATE AS varchar) AS date FROM (SELECT source_row, CASE WHEN source_row % 3 = 0 THEN strftime(try_cast(date AS date), '%d/%m/%Y') WHEN source_row % 3 = 1 THEN strftime(try_cast(date AS date), '%d.%m.%Y') ELSE date END AS d FROM {v_matches_raw})")
def many_formats(t):
    d = F.col("date").try_cast("date")
    cell = F.when(F.col("source_row") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("source_row") % 3 == 1, F.date_format(d, "dd.MM.yyyy")).otherwise(F.col("date"))
    return dated(t("v_matches_raw").select("source_row", parse.first_date(cell).alias("date")))


@plan("DATE-02", "SELECT k, year(d) AS year, cast(floor(year(d) / 10) * 10 AS int) AS decade, DATE '2001-12-31' - d AS days FROM {v_base}")
def date_parts(t):
    d = F.col("d")
    return t("v_base").select("k", F.year(d).cast("long").alias("year"), (F.floor(F.year(d) / 10) * 10).cast("int").alias("decade"), F.datediff(F.lit("2001-12-31").cast("date"), d).cast("long").alias("days"))


@plan("DATE-04", "SELECT k, cast(cast(d - INTERVAL 3 YEAR AS date) AS varchar) AS since FROM {v_base}")
def offsets(t):
    return dated(t("v_base").select("k", F.add_months("d", -36).alias("since")))


@plan("SRC-10", "SELECT p_partkey, p_brand FROM {part}")
def projected(t):
    return delimited.read_table(t.spark, t.sf_dir, "part", ["p_partkey", "p_brand"])


@plan("SRC-12", "SELECT (SELECT count(*) FROM {part}) AS part, (SELECT count(*) FROM {events}) AS events")
def row_counts(t):
    return t("part").agg(F.count("*").alias("part")).join(F.broadcast(t("events").agg(F.count("*").alias("events"))))


@plan("SRC-29", "SELECT event_id, event_type, value FROM {events}")
def json_lines(t):
    path = scratch_path(t.spark, "events-jsonl")
    t("events").select("event_id", "event_type", "value").write.json(path)
    return t.spark.read.schema("event_id long, event_type string, value double").json(path)


@plan("SNK-02", "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id")
def written_table(t):
    path = scratch_path(t.spark, "features")
    sinks.write_table(t("events").groupBy("user_id").agg(F.count("*").alias("n")), path)
    return t.spark.read.parquet(path)


@plan("ARR-01", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM {lineitem} GROUP BY l_orderkey")
def joined_arrays(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("flags"))


@plan("FLT-16", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE '%build%' THEN 'defender' WHEN lower(c_mktsegment) LIKE '%auto%' THEN 'forward' ELSE 'unknown' END AS grp FROM {customer}")
def position_groups(t):
    rules = (("defender", ("build",)), ("forward", ("auto",)))
    return t("customer").select("c_custkey", squads.position_group(F.col("c_mktsegment"), rules).alias("grp"))


@plan("FLT-10", "SELECT match_id FROM {v_matches} WHERE (lower(home_team) LIKE '%nation_1%' OR lower(away_team) LIKE '%nation_1%') AND date = DATE '1997-03-03'")
def ledger_filter(t):
    team = F.lower("home_team").contains("nation_1") | F.lower("away_team").contains("nation_1")
    return t("v_matches").where(team & (F.col("date") == F.lit("1997-03-03").cast("date"))).select("match_id")


@plan("STRM-03", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
def streamed(t):
    """A bounded stream over the events table: watermark, tumbling day windows, summed per type."""
    schema = t("events").schema
    path, out, check = (scratch_path(t.spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    t("events").write.parquet(path)
    rows = t.spark.readStream.schema(schema).parquet(path).withColumn("available_at", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("kickoff_at", F.col("available_at") + F.expr("interval 1 day"))
    from fixtura.streaming.results import timely_evidence

    counted = timely_evidence(rows).select("event_id", "event_type", "available_at")
    counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
