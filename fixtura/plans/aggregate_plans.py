"""Queries of grouped summaries, squads, signals and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtura.functions import probs
from fixtura.operators import aggregates, blend, quality, signals, squads
from fixtura.plans.model_plans import six
from fixtura.plans.registry import dated, plan

CUTOFF = "2024-01-25"


def cutoff():
    return F.lit(CUTOFF).cast("date")


@plan("AGG-04", "SELECT cast(release_date AS varchar) AS release_date, count(DISTINCT team) AS teams, arg_min(team, source_row) AS first_team, max(points) AS top_points, min(points) AS least_points FROM {v_releases} GROUP BY release_date")
def release_summary(t):
    return dated(aggregates.release_summary(t("v_releases")))


@plan("AGG-05", "WITH k AS (SELECT DISTINCT lower(substr(p_name, 1, 5)) AS key, p_name AS raw FROM {part}) SELECT key, count(*) AS raw_names FROM k GROUP BY key HAVING count(*) > 1")
def collisions(t):
    return aggregates.name_collisions(t("part"), "p_name", F.lower(F.substring("p_name", 1, 5)))


@plan("AGG-05b", "SELECT count(*) AS n, count(*) FILTER (points IS NULL) AS null_points, count(*) - count(DISTINCT (team, release_date)) AS duplicates, count(DISTINCT team) AS teams FROM {v_releases}")
def release_quality(t):
    return t("v_releases").agg(F.count("*").alias("n"), F.count_if(F.col("points").isNull()).alias("null_points"), (F.count("*") - F.count_distinct(F.struct("team", "release_date"))).alias("duplicates"), F.count_distinct("team").alias("teams"))


@plan("AGG-06", """SELECT CASE WHEN grouping(team) = 0 THEN 'team' WHEN grouping(position) = 0 THEN 'position' WHEN grouping(group_no) = 0 THEN 'group_no' ELSE 'overall' END AS dimension, coalesce(CASE WHEN grouping(team) = 0 THEN team WHEN grouping(position) = 0 THEN position WHEN grouping(group_no) = 0 THEN cast(group_no AS varchar) END, 'all') AS value,
    count(*) AS n, cast(sum((balance > 0)::INT) AS bigint) AS covered, round(avg((balance > 0)::INT), 6) AS rate FROM {v_players} GROUP BY GROUPING SETS ((), (team), (position), (group_no))""")
def coverage_sets(t):
    return six(aggregates.coverage_by_dimensions(t("v_players"), ["team", "position", "group_no"], F.col("balance") > 0))


@plan("AGG-07", "SELECT team, position, count(*) AS n, round(avg((balance > 0)::INT), 6) AS coverage, grouping_id(team, position) AS level FROM {v_players} GROUP BY ROLLUP (team, position)")
def coverage_levels(t):
    return six(aggregates.coverage_rollup(t("v_players"), "team", "position", F.col("balance") > 0))


@plan("AGG-08", "SELECT position, round(sum(CASE WHEN position = 'BUILDING' THEN NULL ELSE balance END), 2) AS total FROM {v_players} GROUP BY position")
def null_sums(t):
    return t("v_players").groupBy("position").agg(F.round(F.sum(F.when(F.col("position") != "BUILDING", F.col("balance"))), 2).alias("total"))


@plan("AGG-09", "SELECT team, round(median(balance), 4) AS median FROM {v_players} GROUP BY team")
def medians(t):
    return t("v_players").groupBy("team").agg(F.round(F.median("balance"), 4).alias("median"))


@plan("AGG-10", "SELECT team, round(sum(balance) FILTER (n <= 11), 2) AS top_11, round(sum(balance) FILTER (n <= 23), 2) AS top_23 FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY balance DESC) AS n FROM {v_players}) GROUP BY team")
def top_sums(t):
    return t("v_players").groupBy("team").agg(F.round(aggregates.top_sum("balance", 11), 2).alias("top_11"), F.round(aggregates.top_sum("balance", 23), 2).alias("top_23"))


@plan("AGG-11", "SELECT team, round(sum(balance) FILTER (n <= 11), 2) AS top_11, round(sum(balance) FILTER (n <= 15), 2) AS top_15, round(sum(balance) FILTER (n <= 23), 2) AS top_23, round(coalesce(sum(balance) FILTER (n BETWEEN 12 AND 15), 0), 2) AS next_4, round(coalesce(sum(balance) FILTER (n > 15), 0), 2) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY balance DESC) AS n FROM {v_players}) GROUP BY team")
def depth(t):
    made = aggregates.ranked_sums(t("v_players"), "team", "balance", {"top_11": (1, 11), "top_15": (1, 15), "top_23": (1, 23), "next_4": (12, 15), "rest": (16, 1 << 30)})
    return made.select("team", *[F.round(c, 2).alias(c) for c in made.columns[1:]])


ACTIVITY = ", ".join(f"CASE WHEN last IS NOT NULL THEN cast(coalesce(a{d}, 0) AS bigint) END AS appearances_{d}d, CASE WHEN last IS NOT NULL THEN cast(coalesce(m{d}, 0) AS bigint) END AS minutes_{d}d, CASE WHEN last IS NOT NULL THEN cast(coalesce(g{d}, 0) AS bigint) END AS goals_{d}d" for d in (7, 30, 90))
CELLS = ", ".join(f"count(*) FILTER (date >= DATE '{CUTOFF}' - {d}) AS a{d}, sum(minutes) FILTER (date >= DATE '{CUTOFF}' - {d}) AS m{d}, sum(goals) FILTER (date >= DATE '{CUTOFF}' - {d}) AS g{d}" for d in (7, 30, 90))


@plan("AGG-12", f"WITH w AS (SELECT player_id, max(date) AS last, {CELLS} FROM {{v_appearances}} WHERE date < DATE '{CUTOFF}' GROUP BY player_id) SELECT p.player_id, {ACTIVITY}, DATE '{CUTOFF}' - last AS days_since_last FROM {{v_players}} p LEFT JOIN w ON p.player_id = w.player_id")
def activity_windows(t):
    made = aggregates.windowed_activity(t("v_players").select("player_id"), t("v_appearances"), cutoff(), (7, 30, 90))
    return made.drop("last_date").withColumn("days_since_last", F.col("days_since_last").cast("long"))


@plan("AGG-13", "SELECT event_type, round(sum(value * minutes) / sum(minutes), 6) AS weighted FROM {v_appearances} GROUP BY event_type")
def weighted(t):
    return t("v_appearances").groupBy("event_type").agg(F.round(aggregates.weighted_mean("value", "minutes"), 6).alias("weighted"))


@plan("AGG-14", """WITH p AS (SELECT k % 500 AS match_key, greatest(least(greatest((k % 11) / 10.0, 0), 1), 1e-6) AS w, p0, p1, p2 FROM {v_preds}), m AS (SELECT match_key, sum(w * p0) / sum(w) AS a, sum(w * p1) / sum(w) AS b, sum(w * p2) / sum(w) AS c, count(*) AS n_sources FROM p GROUP BY match_key)
    SELECT match_key, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2, n_sources FROM m""")
def consensus(t):
    rows = t("v_preds").select((F.col("k") % 500).alias("match_key"), ((F.col("k") % 11) / 10).alias("confidence"), "p0", "p1", "p2")
    return six(signals.expert_consensus(rows, "match_key"))


@plan("AGG-15", "SELECT home_team AS team, round(sum(CASE competition WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 ELSE 0.5 END * home_score) / sum(CASE competition WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 ELSE 0.5 END), 6) AS form FROM {v_preds} GROUP BY home_team")
def importance_mean(t):
    weights = {"1-URGENT": 1.0, "2-HIGH": 0.8, "other": 0.5}
    return six(squads.importance_weighted(t("v_preds"), "home_team", "home_score", "competition", weights).withColumnRenamed("home_team", "team").withColumnRenamed("mean", "form"))


@plan("AGG-16", "SELECT round(avg(balance), 6) AS mean, round(stddev_pop(balance), 6) AS sd, count(balance) AS n FROM {v_players}")
def moments(t):
    return six(t("v_players").agg(F.avg("balance").alias("mean"), F.stddev_pop("balance").alias("sd"), F.count("balance").alias("n")))


@plan("AGG-17", "SELECT player_id, count(DISTINCT game_id) AS games, count(DISTINCT game_id) FILTER (date >= DATE '2024-01-20') AS recent, CASE WHEN count(DISTINCT game_id) >= 10 THEN 'strong' WHEN count(DISTINCT game_id) >= 4 THEN 'partial' ELSE 'sparse' END AS tier FROM {v_appearances} GROUP BY player_id")
def lineup_coverage(t):
    made = t("v_appearances").groupBy("player_id").agg(F.count_distinct("game_id").alias("games"), F.count_distinct(F.when(F.col("date") >= F.lit("2024-01-20").cast("date"), F.col("game_id"))).alias("recent"))
    return made.withColumn("tier", aggregates.coverage_tier(F.col("games")))


@plan("AGG-19", "SELECT position, group_no, count(*) AS n, cast(sum((player_id % 3 = 0)::INT) AS bigint) AS linked, round(avg((player_id % 3 = 0)::INT), 6) AS rate FROM {v_players} GROUP BY position, group_no")
def link_rates(t):
    made = t("v_players").withColumn("hit", (F.col("player_id") % 3 == 0).cast("int")).groupBy("position", "group_no")
    return six(made.agg(F.count("*").alias("n"), F.sum("hit").alias("linked"), F.avg("hit").alias("rate")))


@plan("AGG-20", "SELECT 'c_custkey' AS \"column\", count(*) FILTER (c_custkey IS NULL) AS nulls FROM {customer} UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL) FROM {customer} UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL) FROM {customer} UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL) FROM {customer} UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL) FROM {customer}")
def inventory(t):
    return quality.null_rates(t("customer")).select("column", "nulls")


@plan("AGG-21", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 100) AS large, cast(min(cast(ts AS date)) AS varchar) AS first, cast(max(cast(ts AS date)) AS varchar) AS last FROM {events} GROUP BY event_type")
def source_coverage(t):
    return dated(t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 100).alias("large"), F.min(F.col("ts").cast("date")).alias("first"), F.max(F.col("ts").cast("date")).alias("last")))


@plan("AGG-22", "SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS purchase_value, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 4) AS view_value, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total_value FROM {events} GROUP BY user_id")
def event_totals(t):
    return aggregates.event_totals(t("events"), "user_id")


@plan("AGG-24", "WITH c AS (SELECT competition, home_team, away_team, count(*) AS n, avg((label = 0)::INT) AS w FROM {v_preds} GROUP BY ALL) SELECT competition, home_team, away_team, n, round(n / cast(sum(n) OVER (PARTITION BY competition) AS double), 6) AS share, round(w, 6) AS win_share FROM c")
def matchups(t):
    rows = t("v_preds").withColumn("won", F.col("label") == 0)
    return six(aggregates.pair_frequencies(rows, "competition", "home_team", "away_team", "won"))


@plan("AGG-25", "WITH c AS (SELECT home_team, away_team, count(*) AS n FROM {v_preds} GROUP BY home_team, away_team) SELECT home_team AS team, away_team AS opponent, n FROM c QUALIFY row_number() OVER (PARTITION BY home_team ORDER BY n DESC, away_team) = 1")
def modal(t):
    return aggregates.mode_of(t("v_preds"), "home_team", "away_team").select(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), "n")


@plan("AGG-26", "WITH s AS (SELECT competition, home_team AS team FROM {v_preds} UNION ALL SELECT competition, away_team FROM {v_preds}), t AS (SELECT competition, avg((home_team IN ('NATION_1', 'NATION_2') OR away_team IN ('NATION_1', 'NATION_2'))::INT) AS top_share FROM {v_preds} GROUP BY competition) SELECT s.competition, team, count(*) AS n, round(any_value(top_share), 6) AS top_share FROM s JOIN t ON s.competition = t.competition GROUP BY s.competition, team")
def marginals(t):
    return six(aggregates.appearance_shares(t("v_preds"), "competition", "home_team", "away_team", ["NATION_1", "NATION_2"]))


@plan("AGG-29", "SELECT 'c_acctbal' AS \"column\", count(*) AS rows, count(c_acctbal) AS filled, round(count(c_acctbal) / cast(count(*) AS double), 6) AS rate, round(avg(c_acctbal), 4) AS mean FROM {customer} UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey), round(count(c_nationkey) / cast(count(*) AS double), 6), round(avg(c_nationkey), 4) FROM {customer}")
def feature_coverage(t):
    return quality.column_coverage(t("customer"), ["c_acctbal", "c_nationkey"]).withColumns({"rate": F.round("rate", 6), "mean": F.round("mean", 4)})


@plan("AGG-30", """WITH l AS (SELECT 'decade' AS dimension, cast(floor(year / 10) * 10 AS int)::VARCHAR AS value, p0 FROM {v_preds} UNION ALL SELECT 'neutral', CASE WHEN neutral THEN 'true' ELSE 'false' END, p0 FROM {v_preds} UNION ALL SELECT 'competition', competition, p0 FROM {v_preds}) SELECT dimension, value, count(*) AS n, round(avg(p0), 6) AS mean FROM l GROUP BY ALL HAVING count(*) >= 30""")
def regimes(t):
    return six(aggregates.slices(t("v_preds"), {"decade": (F.floor(F.col("year") / 10) * 10).cast("int"), "neutral": F.col("neutral"), "competition": F.col("competition")}, F.col("p0")))


@plan("AGG-32", "WITH p AS (SELECT home_team AS home, away_team AS away, count(*) AS n FROM {v_preds} WHERE home_team <> away_team GROUP BY ALL), r AS (SELECT n_name AS team, cast(1400 + n_nationkey * 13 AS double) AS rating FROM {nation}), b AS (SELECT home AS team, away AS opponent, n FROM p UNION ALL SELECT away, home, n FROM p) SELECT b.team, round(sum(n * rating) / sum(n), 6) AS opponent_rating FROM b JOIN r ON b.opponent = r.team GROUP BY b.team")
def opponents(t):
    pairs = t("v_preds").where("home_team <> away_team").groupBy(F.col("home_team").alias("home"), F.col("away_team").alias("away")).agg(F.count("*").alias("n"))
    ratings = t("nation").select(F.col("n_name").alias("team"), (1400 + F.col("n_nationkey") * 13).cast("double").alias("rating"))
    return six(aggregates.opponent_strength(pairs, ratings))


@plan("AGG-33", "SELECT count(DISTINCT hn) AS homes, count(DISTINCT an) AS aways, count(DISTINCT d) AS days FROM {v_base}")
def distincts(t):
    return t("v_base").agg(F.count_distinct("hn").alias("homes"), F.count_distinct("an").alias("aways"), F.count_distinct("d").alias("days"))


# Signals.


@plan("SRC-15", "SELECT row_id, match_key, odds_a, odds_draw, odds_b, quoted_at FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY quoted_at DESC, row_id DESC) AS n FROM {v_odds} WHERE odds_a > 1 AND odds_b > 1 AND (odds_draw IS NULL OR odds_draw > 1)) WHERE n = 1")
def quotes(t):
    return signals.latest_quotes(signals.usable_quotes(t("v_odds")))


@plan("SIG-01", "SELECT row_id, round(CASE WHEN odds_a > 1 THEN 1 / odds_a END, 6) AS implied_a FROM {v_odds}")
def implied(t):
    return t("v_odds").select("row_id", F.round(probs.implied(F.col("odds_a")), 6).alias("implied_a"))


PROPORTIONAL = "WITH q AS (SELECT row_id, 1 / odds_a AS a, 1 / odds_draw AS d, 1 / odds_b AS b FROM {v_odds} WHERE odds_a > 1 AND odds_b > 1 AND (odds_draw IS NULL OR odds_draw > 1)), s AS (SELECT *, a + coalesce(d, 0) + b AS s FROM q)"


@plan("SIG-02", f"{PROPORTIONAL} SELECT row_id, round(CASE WHEN d IS NOT NULL THEN a / s END, 6) AS p0, round(d / s, 6) AS p1, round(CASE WHEN d IS NOT NULL THEN b / s END, 6) AS p2, round(s - 1, 6) AS overround FROM s")
def overround(t):
    return six(signals.market_signal(signals.usable_quotes(t("v_odds"))).select("row_id", "p0", "p1", "p2", "overround"))


@plan("SIG-02-power", """WITH RECURSIVE q AS MATERIALIZED (SELECT row_id, 1 / odds_a AS a, coalesce(1 / odds_draw, 0) AS d, 1 / odds_b AS b, odds_draw IS NOT NULL AS three FROM {v_odds} WHERE odds_a > 1 AND odds_b > 1 AND (odds_draw IS NULL OR odds_draw > 1)),
    z AS (SELECT 0 AS i, row_id, a, d, b, three, cast(1e-6 AS double) AS lo, cast(1000 AS double) AS hi FROM q UNION ALL SELECT i + 1, row_id, a, d, b, three, CASE WHEN pow(a, (lo + hi) / 2) + CASE WHEN d > 0 THEN pow(d, (lo + hi) / 2) ELSE 0 END + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + CASE WHEN d > 0 THEN pow(d, (lo + hi) / 2) ELSE 0 END + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END FROM z WHERE i < 60),
    r AS (SELECT row_id, three, pow(a, (lo + hi) / 2) AS a, CASE WHEN d > 0 THEN pow(d, (lo + hi) / 2) ELSE 0 END AS d, pow(b, (lo + hi) / 2) AS b FROM z WHERE i = 60) SELECT row_id, round((a + d / 2) / (a + d + b), 5) AS advance_a FROM r""")
def power_margin(t):
    return signals.market_signal(signals.usable_quotes(t("v_odds")), "power").select("row_id", F.round("advance_a", 5).alias("advance_a"))


@plan("SIG-03", f"{PROPORTIONAL} SELECT row_id, round((a + coalesce(d, 0) / 2) / s, 6) AS advance_a FROM s")
def advance(t):
    return six(signals.market_signal(signals.usable_quotes(t("v_odds"))).select("row_id", "advance_a"))


@plan("SIG-05", "SELECT k, round(p0 + 0.5 * p1, 6) AS a, round(p2 + 0.5 * p1, 6) AS b FROM {v_preds}")
def tiebreak(t):
    a, b = probs.advance_from_outcome([F.col(f"p{i}") for i in range(3)])
    return six(t("v_preds").select("k", a.alias("a"), b.alias("b")))


SQUAD = "SELECT n_name AS team, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE cast(n_nationkey * 37 % 100 AS double) END AS attack, cast(n_nationkey * 53 % 100 AS double) AS defense, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE cast(n_nationkey * 17 % 40 AS double) END AS injuries FROM {nation}"


@plan("SIG-06", f"WITH s AS ({SQUAD}), z AS (SELECT team, (attack - avg(attack) OVER ()) / stddev_pop(attack) OVER () AS za, (defense - avg(defense) OVER ()) / stddev_pop(defense) OVER () AS zd, -(injuries - avg(injuries) OVER ()) / stddev_pop(injuries) OVER () AS zi FROM s) SELECT team, round((coalesce(1.0 * za, 0) + coalesce(0.8 * zd, 0) + coalesce(0.4 * zi, 0)) / (CASE WHEN za IS NULL THEN 0 ELSE 1.0 END + CASE WHEN zd IS NULL THEN 0 ELSE 0.8 END + CASE WHEN zi IS NULL THEN 0 ELSE 0.4 END), 6) AS score FROM z")
def strength_scores(t):
    return six(signals.weighted_score(t.sql(SQUAD), "team", {"attack": (1.0, True), "defense": (0.8, True), "injuries": (0.4, False)}))


@plan("SIG-07", f"WITH s AS ({SQUAD}), z AS (SELECT team, (attack - avg(attack) OVER ()) / stddev_pop(attack) OVER () AS za FROM s), p AS (SELECT DISTINCT home_team AS home, away_team AS away FROM {{v_preds}}), d AS (SELECT home, away, (h.za - a.za) * 40 AS x FROM p LEFT JOIN z h ON h.team = home LEFT JOIN z a ON a.team = away) SELECT home, away, round(pow(10, x / 800) / (pow(10, x / 800) + pow(10, -x / 800) + 1), 6) AS p0, round(1 / (pow(10, x / 800) + pow(10, -x / 800) + 1), 6) AS p1 FROM d")
def form_signal(t):
    scores = signals.weighted_score(t.sql(SQUAD), "team", {"attack": (1.0, True)})
    pairs = t("v_preds").select(F.col("home_team").alias("home"), F.col("away_team").alias("away")).distinct()
    return six(signals.strength_signal(pairs, scores, "team", 40.0).select("home", "away", "p0", "p1"))


VENUE = "SELECT k, CASE WHEN k % 3 = 0 THEN cast(k % 20 AS double) END AS host_boost, CASE WHEN k % 4 = 0 THEN cast(k % 10 AS double) END AS crowd_advantage, CASE WHEN k % 5 = 0 THEN cast(k % 7 AS double) END AS heat_disadvantage_a, cast(k % 3000 AS double) AS travel_km_a, CASE WHEN k % 2 = 0 THEN cast(k % 4000 AS double) END AS travel_km_b, cast(k % 6 AS double) AS rest_days_a, CASE WHEN k % 7 > 0 THEN cast(k % 5 AS double) END AS rest_days_b, cast(k % 4 AS double) AS timezone_shift_a, cast(k % 3 AS double) AS timezone_shift_b FROM {v_base}"


@plan("SIG-08", f"WITH v AS ({VENUE}) SELECT k, round(coalesce(host_boost, 0) + coalesce(crowd_advantage, 0) - coalesce(heat_disadvantage_a, 0) + coalesce(8 * (travel_km_b - travel_km_a) / 1000, 0) + coalesce(6 * (rest_days_a - rest_days_b), 0) + coalesce(3 * (timezone_shift_b - timezone_shift_a), 0), 6) AS points FROM v")
def venue(t):
    return t.sql(VENUE).select("k", F.round(signals.venue_points(), 6).alias("points"))


POINTS = "greatest(least(least(greatest(cast(k % 80 - 40 AS double), -25), 25) + least(greatest(cast(k % 60 - 30 AS double), -25), 25) + least(greatest(cast(k % 50 - 20 AS double), -25), 25), 60), -60)"


@plan("SIG-09", f"""WITH b AS (SELECT k, p0, p1, p2, {POINTS} AS pts FROM {{v_preds}}), c AS (SELECT *, p0 + p2 AS m, 1 / (1 + exp(-(ln((p0 / (p0 + p2)) / (1 - p0 / (p0 + p2))) + ln(10) * pts / 400))) AS s FROM b), h AS (SELECT *, CASE WHEN pts = 0 THEN p0 ELSE greatest(greatest(0, p0 - 0.12), least(least(1, p0 + 0.12), m * s)) END AS q0 FROM c)
    SELECT k, round(q0, 6) AS p0, round(p1, 6) AS p1, round(m - q0, 6) AS p2 FROM h""")
def context(t):
    rows = t("v_preds").withColumns({"c1": (F.col("k") % 80 - 40).cast("double"), "c2": (F.col("k") % 60 - 30).cast("double"), "c3": (F.col("k") % 50 - 20).cast("double")})
    rows = rows.withColumn("points", signals.context_points(["c1", "c2", "c3"]))
    moved = probs.shift_outcome([F.col(f"p{i}") for i in range(3)], F.col("points"))
    return six(rows.select("k", *[c.alias(f"p{i}") for i, c in enumerate(moved)]))


@plan("SIG-09b", f"WITH b AS (SELECT k, p0 + p1 / 2 AS p, {POINTS} AS pts FROM {{v_preds}}) SELECT k, round(CASE WHEN pts = 0 THEN p ELSE greatest(greatest(0, p - 0.12), least(least(1, p + 0.12), 1 / (1 + exp(-(ln(p / (1 - p)) + ln(10) * pts / 400))))) END, 6) AS advance FROM b")
def context_knockout(t):
    rows = t("v_preds").withColumns({"c1": (F.col("k") % 80 - 40).cast("double"), "c2": (F.col("k") % 60 - 30).cast("double"), "c3": (F.col("k") % 50 - 20).cast("double"), "p": F.col("p0") + F.col("p1") / 2})
    return six(rows.select("k", probs.shift_advance(F.col("p"), signals.context_points(["c1", "c2", "c3"])).alias("advance")))


STYLES = "SELECT k, true AS evidence, greatest(p0 + p1 / 2, p2 + p1 / 2) AS p_fav, " + ", ".join(f"CASE WHEN k % {m} = 0 THEN NULL ELSE cast(k * {a} % 101 AS double) END AS {c}" for c, m, a in (("und_low_block_defense", 5, 7), ("und_defensive_compactness", 6, 11), ("fav_sterile_possession_risk", 7, 13), ("und_transition_threat", 8, 17), ("fav_chance_creation", 9, 19), ("fav_struggles_vs_low_block", 10, 23), ("und_set_piece_threat", 11, 29), ("und_aerial_threat", 12, 31))) + ", cast(k % 21 AS double) / 10 - 1 AS fav_rating, CASE WHEN k % 3 > 0 THEN cast(k % 17 AS double) / 8 - 1 END AS und_rating FROM {v_preds}"


@plan("SIG-11")
def survival(t):
    """The knockout survival shift; its Skellam sums have no plain SQL form, tests hold them against direct sums."""
    return six(signals.knockout_survival(t.sql(STYLES)).select("k", "goals", "skill", "shootout", "shift", "p_final", "tags"))


PENS = "SELECT k, CASE WHEN k % 4 = 0 THEN NULL ELSE cast(k * 7 % 101 AS double) END AS penalty_strength, CASE WHEN k % 5 = 0 THEN NULL ELSE cast(k * 11 % 101 AS double) END AS keeper_penalty_strength, CASE WHEN k % 6 < 3 THEN NULL ELSE cast(k * 13 % 101 AS double) END AS penalty_taker_depth, CASE WHEN k % 4 = 0 THEN NULL ELSE cast(k * 17 % 101 AS double) END AS tournament_experience, cast(NULL AS double) AS manager_continuity, CASE WHEN k % 3 = 0 THEN NULL ELSE cast(k % 5 AS double) END AS shootout_wins, CASE WHEN k % 3 = 0 THEN NULL ELSE cast(k % 4 AS double) END AS shootout_losses, CASE WHEN k % 7 = 0 THEN cast(k % 3 AS double) END AS world_cup_shootout_wins, CASE WHEN k % 7 = 0 THEN cast(k % 2 AS double) END AS world_cup_shootout_losses, cast(NULL AS double) AS continental_shootout_wins, cast(NULL AS double) AS continental_shootout_losses FROM {v_base}"


@plan("SIG-11c", f"""WITH p AS ({PENS}), c AS (SELECT k, (coalesce((penalty_strength - 50) / 50, 0) + coalesce((keeper_penalty_strength - 50) / 50, 0) + coalesce(0.7 * (penalty_taker_depth - 50) / 50, 0) + coalesce(0.4 * (tournament_experience - 50) / 50, 0)) / nullif((penalty_strength IS NOT NULL)::INT + (keeper_penalty_strength IS NOT NULL)::INT + 0.7 * (penalty_taker_depth IS NOT NULL)::INT + 0.4 * (tournament_experience IS NOT NULL)::INT, 0) AS cur,
    (coalesce(0.5 * (2 * (shootout_wins + 3) / (shootout_wins + shootout_losses + 6) - 1), 0) + coalesce(1.0 * (2 * (world_cup_shootout_wins + 3) / (world_cup_shootout_wins + world_cup_shootout_losses + 6) - 1), 0)) / nullif(0.5 * (shootout_wins IS NOT NULL)::INT + 1.0 * (world_cup_shootout_wins IS NOT NULL)::INT, 0) AS hist FROM p)
    SELECT k, round((coalesce(0.7 * cur, 0) + coalesce(0.3 * hist, 0)) / nullif(0.7 * (cur IS NOT NULL)::INT + 0.3 * (hist IS NOT NULL)::INT, 0), 6) + 0 AS rating FROM c""")
def shootout_ratings(t):
    return t.sql(PENS).select("k", (F.round(signals.shootout_rating(), 6) + 0.0).alias("rating"))


@plan("SIG-11d", "SELECT k, round(0.5 + least(greatest(0.1 * (cast(k % 21 AS double) / 10 - 1 - coalesce(CASE WHEN k % 3 > 0 THEN cast(k % 17 AS double) / 8 - 1 END, 0)), -0.12), 0.12), 6) AS p FROM {v_base}")
def shootout_chances(t):
    rows = t("v_base").select("k", ((F.col("k") % 21) / 10 - 1).alias("a"), F.when(F.col("k") % 3 > 0, (F.col("k") % 17) / 8 - 1).alias("b"))
    return rows.select("k", F.round(signals.shootout_favourite(F.col("a"), F.col("b")), 6).alias("p"))


@plan("SIG-14", "SELECT match_id, coalesce(max(p0 + p1 / 2) FILTER (signal = 'market'), max(p0 + p1 / 2) FILTER (signal = 'squad_strength'), 0.5) AS anchor FROM (SELECT match_id, signal, round(p0, 9) AS p0, round(p1, 9) AS p1 FROM {v_signals}) GROUP BY match_id")
def anchors(t):
    rows = t("v_signals").select("match_id", "signal", (F.round("p0", 9) + F.round("p1", 9) / 2).alias("a"))
    of = lambda s: F.max(F.when(F.col("signal") == s, F.col("a")))
    return rows.groupBy("match_id").agg(signals.base_advance(of("market"), of("squad_strength")).alias("anchor"))


@plan("MATH-02", "SELECT k, coalesce(least(greatest((CASE WHEN k % 9 > 0 THEN cast(k % 130 AS double) END - 50) / 50, -1), 1), 0) AS x FROM {v_base}".replace("coalesce(least(greatest((CASE WHEN k % 9 > 0 THEN cast(k % 130 AS double) END - 50) / 50, -1), 1), 0)", "CASE WHEN k % 9 = 0 THEN cast(0 AS double) ELSE least(greatest((cast(k % 130 AS double) - 50) / 50, -1), 1) END"))
def centred(t):
    return t("v_base").select("k", F.when(F.col("k") % 9 == 0, F.lit(0.0)).otherwise(probs.centred((F.col("k") % 130).cast("double"))).alias("x"))


@plan("MATH-03", "SELECT k, round((cast(k % 5 AS double) + 3) / (k % 5 + k % 4 + 6), 6) AS rate FROM {v_base}")
def shrunk(t):
    return t("v_base").select("k", F.round(probs.shrunk_rate((F.col("k") % 5).cast("double"), (F.col("k") % 4).cast("double")), 6).alias("rate"))


@plan("MATH-04", "SELECT k, round(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(cast(k % 90 AS double) - cast(k % 45 AS double)) / 2), 2) + cos(radians(cast(k % 45 AS double))) * cos(radians(cast(k % 90 AS double))) * pow(sin(radians(cast(k % 360 AS double) - cast(k % 100 AS double)) / 2), 2), 1))), 4) AS km FROM {v_base}")
def distances(t):
    c = lambda m: (F.col("k") % m).cast("double")
    return t("v_base").select("k", F.round(probs.haversine_km(c(45), c(100), c(90), c(360)), 4).alias("km"))


# Blends.


@plan("BLD-01", "WITH w AS (SELECT * FROM (VALUES ('historical', 0.35::DOUBLE), ('market', 0.25), ('squad_strength', 0.15), ('recent_form', 0.10), ('expert', 0.10)) AS x(signal, weight)), m AS (SELECT match_id, sum(weight * p0) / sum(weight) AS a, sum(weight * p1) / sum(weight) AS b, sum(weight * p2) / sum(weight) AS c, count(*) AS n FROM {v_signals} s JOIN w ON s.signal = w.signal GROUP BY match_id) SELECT match_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2, n AS n_used, 6 - n AS n_missing FROM m")
def pool(t):
    made = blend.blend(t("v_signals"), blend.weights_table(t.spark, {"default": blend.VERSIONS["default"]}))
    return six(made.select("match_id", "p0", "p1", "p2", F.size("used").cast("long").alias("n_used"), F.size("missing").cast("long").alias("n_missing")))


PAIRS = "SELECT a.match_id, max(0.5 * (abs(a.p0 - b.p0) + abs(a.p1 - b.p1) + abs(a.p2 - b.p2))) AS worst FROM {v_signals} a JOIN {v_signals} b ON a.match_id = b.match_id GROUP BY a.match_id"


@plan("BLD-02", f"SELECT match_id, round(worst, 6) AS max_disagreement FROM ({PAIRS})")
def pairwise(t):
    return six(blend.disagreement(t("v_signals")).drop("n_signals"))


@plan("BLD-03", "SELECT s.match_id, s.signal, round(0.5 * (abs(s.p0 - r.p0) + abs(s.p1 - r.p1) + abs(s.p2 - r.p2)), 6) AS distance FROM {v_signals} s JOIN {v_signals} r ON s.match_id = r.match_id AND r.signal = 'historical' WHERE s.signal <> 'historical'")
def reference(t):
    return six(blend.against_reference(t("v_signals"), "historical"))


@plan("BLD-04", "SELECT k, round(0.5 * (abs(p0 - b0) + abs(p1 - b1) + abs(p2 - b2)), 6) AS tvd FROM {v_preds}")
def variation(t):
    return six(t("v_preds").select("k", probs.distance([F.col(f"p{i}") for i in range(3)], [F.col(f"b{i}") for i in range(3)]).alias("tvd")))


@plan("BLD-05", f"SELECT count(*) AS n, count(*) FILTER (round(worst, 9) >= 0.15) AS flagged FROM ({PAIRS})")
def flags(t):
    made = blend.disagreement(t("v_signals")).withColumn("max_disagreement", F.round("max_disagreement", 9))
    return blend.flagged(made).agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))


VERSION_ROWS = ", ".join(f"('{v}', '{s}', {float(w)}::DOUBLE)" for v, ws in blend.VERSIONS.items() for s, w in ws.items())


@plan("BLD-06", f"SELECT * FROM (VALUES {VERSION_ROWS}) AS x(version, signal, weight)")
def versions(t):
    return blend.weights_table(t.spark)


@plan("BLD-08", f"""WITH w AS (SELECT * FROM (VALUES {VERSION_ROWS}) AS x(version, signal, weight)), s AS (SELECT match_id, version, s.signal, weight, p0, p1, p2 FROM {{v_signals}} s JOIN w ON s.signal = w.signal), g AS (SELECT a.match_id, a.version, max(0.5 * (abs(a.p0 - b.p0) + abs(a.p1 - b.p1) + abs(a.p2 - b.p2))) AS worst FROM s a JOIN s b ON a.match_id = b.match_id AND a.version = b.version GROUP BY ALL),
    m AS (SELECT match_id, version, sum(weight * p0) / sum(weight) AS a, sum(weight * p1) / sum(weight) AS b, sum(weight * p2) / sum(weight) AS c, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT m.match_id, m.version, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2, m.n, label, round(worst, 9) >= 0.15 AS high, (SELECT count(*) FROM w WHERE w.version = m.version) AS k FROM m JOIN {{v_preds}} l ON l.k = m.match_id JOIN g ON g.match_id = m.match_id AND g.version = m.version)
    SELECT version, count(*) AS n_scored, round(avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1e-12)), 6) AS log_loss, round(avg(pow(p0 - (label = 0)::INT, 2) + pow(p1 - (label = 1)::INT, 2) + pow(p2 - (label = 2)::INT, 2)), 6) AS brier, round(avg(n), 6) AS mean_signals_used, round(avg(k - n), 6) AS missing_signal_rate FROM q GROUP BY version""")
def version_scores(t):
    labels = t("v_preds").select(F.col("k").alias("match_id"), "label")
    made = blend.score_versions(t("v_signals"), labels, blend.weights_table(t.spark))
    return six(made.select("version", "n_scored", "log_loss", "brier", "mean_signals_used", "missing_signal_rate"))


@plan("BLD-10", """WITH w AS (SELECT * FROM (VALUES ('historical', 'historical', 1.0::DOUBLE), ('historical+market', 'historical', 0.5), ('historical+market', 'market', 0.5)) AS x(version, signal, weight)), m AS (SELECT match_id, version, sum(weight * p0) / sum(weight) AS a, sum(weight * p1) / sum(weight) AS b, sum(weight * p2) / sum(weight) AS c FROM {v_signals} s JOIN w ON s.signal = w.signal GROUP BY ALL)
    SELECT version, count(*) AS n, round(avg(-ln(CASE label WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c) + 1e-12)), 6) AS log_loss FROM m JOIN {v_preds} l ON l.k = m.match_id GROUP BY version""")
def subsets(t):
    weights = blend.weights_table(t.spark, {"historical": {"historical": 1.0}, "historical+market": {"historical": 0.5, "market": 0.5}})
    made = blend.score_versions(t("v_signals"), t("v_preds").select(F.col("k").alias("match_id"), "label"), weights)
    return six(made.select("version", F.col("n_scored").alias("n"), "log_loss"))


@plan("AGG-28", "WITH n AS (SELECT * FROM (VALUES ('historical'), ('market'), ('squad_strength'), ('recent_form'), ('expert'), ('venue_context')) AS x(signal)), c AS (SELECT signal, count(DISTINCT match_id) AS c FROM {v_signals} GROUP BY signal), t AS (SELECT count(*) AS n_total FROM {v_preds}) SELECT n.signal, coalesce(c, 0) AS n_covered, n_total, round(coalesce(c, 0) / cast(n_total AS double), 6) AS coverage_rate, CASE WHEN coalesce(c, 0) / cast(n_total AS double) >= 0.5 THEN 'trusted' WHEN coalesce(c, 0) > 0 THEN 'experimental' ELSE 'absent' END AS status FROM n LEFT JOIN c ON n.signal = c.signal CROSS JOIN t")
def signal_coverage(t):
    return six(blend.signal_coverage(t("v_signals"), t("v_preds"), ["historical", "market", "squad_strength", "recent_form", "expert", "venue_context"]))


@plan("AGG-27", "WITH m AS (SELECT DISTINCT match_id FROM {v_signals}), n AS (SELECT * FROM (VALUES ('historical'), ('market'), ('squad_strength'), ('recent_form'), ('expert'), ('venue_context')) AS x(signal)), a AS (SELECT m.match_id, n.signal FROM m CROSS JOIN n EXCEPT SELECT match_id, signal FROM {v_signals}) SELECT signal, count(*) AS n_missing FROM a GROUP BY signal")
def missing_signals(t):
    made = blend.blend(t("v_signals"), blend.weights_table(t.spark, {"default": blend.VERSIONS["default"]}))
    return made.select(F.explode("missing").alias("signal")).groupBy("signal").agg(F.count("*").alias("n_missing"))


@plan("BLD-11")
def tuned(t):
    """Weights lowered in loss by multiplicative rounds; tests hold the loss against that of equal weights."""
    weights = blend.tune_weights(t("v_signals"), t("v_preds").select(F.col("k").alias("match_id"), "label"), ["historical", "market", "squad_strength"], 10)
    return t.spark.createDataFrame([(s, round(w, 4)) for s, w in weights.items()], "signal string, weight double")
