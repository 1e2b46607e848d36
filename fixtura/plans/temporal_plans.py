"""Queries in time: as-of joins, rolling features, rankings, cutoffs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.operators import features, ranking, ratings, temporal
from fixtura.plans.registry import dated, plan

#: Feature columns and the SQL that checks each, over history rows h with a window per team.
FRAME = "OVER (PARTITION BY team ORDER BY date, source_row ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def form(t, *columns):
    """The chosen features, floats to six places."""
    made = features.rolling_form(t("v_history"))
    kinds = dict(made.dtypes)
    return made.select("match_id", "is_home", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) for c in columns])


def mean_last(n: int, value: str, name: str) -> str:
    return f"round(avg(cast({value} AS double)) {FRAME.format(n=n)}, 6) AS {name}"


@plan("WIN-03", f"""SELECT match_id, is_home, {mean_last(3, 'points', 'ppm_last3')}, {mean_last(5, 'points', 'ppm_last5')}, {mean_last(10, 'points', 'ppm_last10')}, {mean_last(10, 'CASE WHEN points = 3 THEN 1 ELSE 0 END', 'winrate_last10')},
    {mean_last(10, 'goals_for', 'gf_per_match_last10')}, {mean_last(10, 'goals_against', 'ga_per_match_last10')}, {mean_last(10, 'goals_for - goals_against', 'gd_per_match_last10')}, {mean_last(10, 'CASE WHEN goals_against = 0 THEN 1 ELSE 0 END', 'clean_sheet_rate_last10')},
    {mean_last(10, 'CASE WHEN goals_for = 0 THEN 1 ELSE 0 END', 'fts_rate_last10')}, {mean_last(10, 'CASE points WHEN 3 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END - expected', 'opp_adj_points_last10')},
    {mean_last(10, 'goals_for - 2.6 * expected', 'attack_resid_last10')}, {mean_last(10, 'goals_against - 2.6 * (1 - expected)', 'defense_resid_last10')} FROM {{v_history}}""")
def row_frames(t):
    return form(t, "ppm_last3", "ppm_last5", "ppm_last10", "winrate_last10", "gf_per_match_last10", "ga_per_match_last10", "gd_per_match_last10", "clean_sheet_rate_last10", "fts_rate_last10", "opp_adj_points_last10", "attack_resid_last10", "defense_resid_last10")


@plan("WIN-04", f"""SELECT match_id, is_home, round(CASE WHEN count(*) {FRAME.format(n=10)} > 1 THEN stddev_pop(goals_for - goals_against) {FRAME.format(n=10)} END, 6) AS gd_volatility_last10 FROM {{v_history}}""")
def volatility(t):
    return form(t, "gd_volatility_last10")


@plan("WIN-05", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, source_row) AS i FROM {v_history})
    SELECT a.match_id, a.is_home, round(sum(b.points * pow(0.5, (a.date - b.date) / 365.0)) / sum(pow(0.5, (a.date - b.date) / 365.0)), 6) AS recency_wpoints FROM h a LEFT JOIN h b ON a.team = b.team AND b.i < a.i GROUP BY a.match_id, a.is_home""")
def decay(t):
    return form(t, "recency_wpoints")


@plan("WIN-06", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, source_row) AS i FROM {v_history}),
    l AS (SELECT match_id, is_home, list(points) FILTER (lower(tournament) NOT LIKE '%friendly%') OVER (PARTITION BY team ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM h)
    SELECT match_id, is_home, round(list_avg(x[greatest(1, len(x) - 9):len(x)]), 6) AS ppm_comp_last10 FROM l""")
def matching_rows(t):
    return form(t, "ppm_comp_last10")


@plan("WIN-07", """WITH h AS (SELECT *, date - lag(date) OVER (PARTITION BY team ORDER BY date, source_row) AS gap FROM {v_history})
    SELECT match_id, is_home, CASE WHEN gap IS NOT NULL THEN cast(least(gap, 1825) AS double) END AS days_since_prev, CASE WHEN gap > 365 THEN cast(1 AS double) WHEN gap IS NOT NULL THEN cast(0 AS double) END AS long_inactivity FROM h""")
def rest_days(t):
    return form(t, "days_since_prev", "long_inactivity")


@plan("WIN-08", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, source_row) AS i FROM {v_history})
    SELECT a.match_id, a.is_home, count(b.i) FILTER (a.date - b.date <= 7) AS matches_prev_7d, count(b.i) FILTER (a.date - b.date <= 14) AS matches_prev_14d, count(b.i) FILTER (a.date - b.date <= 30) AS matches_prev_30d
    FROM h a LEFT JOIN h b ON a.team = b.team AND b.i < a.i AND a.date - b.date <= 30 GROUP BY a.match_id, a.is_home""")
def congestion(t):
    return form(t, "matches_prev_7d", "matches_prev_14d", "matches_prev_30d")


@plan("WIN-09", """SELECT match_id, is_home, cast(date - max(CASE WHEN lower(tournament) NOT LIKE '%friendly%' THEN date END) OVER (PARTITION BY team ORDER BY date, source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS double) AS days_since_prev_competitive FROM {v_history}""")
def since_matching(t):
    return form(t, "days_since_prev_competitive")


@plan("WIN-10", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, source_row) AS i FROM {v_history})
    SELECT a.match_id, a.is_home, 1 + count(b.i) AS tournament_seq FROM h a LEFT JOIN h b ON a.team = b.team AND a.tournament = b.tournament AND b.i < a.i AND a.date - b.date <= 60 GROUP BY a.match_id, a.is_home""")
def tournament_sequence(t):
    return form(t, "tournament_seq")


@plan("WIN-11", "SELECT match_id, is_home, row_number() OVER (PARTITION BY team ORDER BY date, source_row) - 1 AS n_prior, CASE WHEN row_number() OVER (PARTITION BY team ORDER BY date, source_row) > 1 THEN cast(1 AS double) ELSE cast(0 AS double) END AS form_available FROM {v_history}")
def ordinals(t):
    return form(t, "n_prior", "form_available")


@plan("WIN-12", "SELECT team, cast(release_date AS varchar) AS release_date, points - lag(points, 1) OVER w AS change_1, points - lag(points, 3) OVER w AS change_3 FROM {v_releases} WINDOW w AS (PARTITION BY team ORDER BY release_date)")
def momentum(t):
    return dated(ranking.release_changes(t("v_releases")).select("team", "release_date", "change_1", "change_3"))


@plan("WIN-01", "SELECT team, cast(release_date AS varchar) AS release_date, CASE WHEN points IS NOT NULL THEN rank() OVER (PARTITION BY release_date ORDER BY points DESC NULLS LAST) END AS rank FROM {v_releases}")
def competition_rank(t):
    ranked = ranking.release_ranks(t("v_releases")).select("team", "release_date", F.col("rank").cast("long").alias("rank"))
    return dated(ranked)


@plan("WIN-02", """WITH r AS (SELECT hn AS team, cast(sum(k % 1000) AS double) AS points, cast(count(*) AS double) AS elo FROM {v_base} GROUP BY hn), z AS (SELECT *, rank() OVER (ORDER BY points DESC) AS points_rank, rank() OVER (ORDER BY elo DESC) AS elo_rank,
    (points - min(points) OVER ()) / (max(points) OVER () - min(points) OVER ()) AS scaled, (points - avg(points) OVER ()) / stddev_pop(points) OVER () AS z FROM r) SELECT team, points_rank, elo_rank, round(scaled, 6) AS scaled, round(z, 6) AS z FROM z""")
def compared_ranks(t):
    totals = t("v_base").groupBy(F.col("hn").alias("team")).agg(F.sum(F.col("k") % 1000).cast("double").alias("points"), F.count("*").cast("double").alias("elo"))
    return ranking.compare(totals).select("team", F.col("points_rank").cast("long").alias("points_rank"), F.col("elo_rank").cast("long").alias("elo_rank"), F.round("scaled", 6).alias("scaled"), F.round("z", 6).alias("z"))


@plan("MET-15", """WITH r AS (SELECT hn AS team, cast(sum(k % 1000) AS double) AS points, cast(count(*) AS double) AS elo FROM {v_base} GROUP BY hn), z AS (SELECT *, cast(rank() OVER (ORDER BY points) AS double) + (count(*) OVER (PARTITION BY points) - 1) / 2.0 AS a, cast(rank() OVER (ORDER BY elo) AS double) + (count(*) OVER (PARTITION BY elo) - 1) / 2.0 AS b FROM r) SELECT round(corr(a, b), 6) AS spearman, round(corr(points, elo), 6) AS pearson FROM z""")
def correlations(t):
    totals = t("v_base").groupBy(F.col("hn").alias("team")).agg(F.sum(F.col("k") % 1000).cast("double").alias("points"), F.count("*").cast("double").alias("elo"))
    return ranking.correlation(totals, "points", "elo").select(F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"))


@plan("JOIN-01", "SELECT m.match_id, round(t.home_elo_pre - t.away_elo_pre, 6) AS elo_diff, CASE WHEN coalesce(m.neutral, false) THEN cast(0 AS double) ELSE cast(1 AS double) END AS home_adv, CASE m.outcome WHEN 'home_win' THEN 0 WHEN 'draw' THEN 1 WHEN 'away_win' THEN 2 ELSE -1 END AS label FROM {v_matches} m JOIN {v_timeline} t ON m.match_id = t.match_id WHERE m.status = 'played'")
def model_rows(t):
    return features.match_frame(t("v_matches"), t("v_timeline")).select("match_id", F.round("elo_diff", 6).alias("elo_diff"), "home_adv", "label")


@plan("FLT-17", "SELECT outcome, CASE outcome WHEN 'home_win' THEN 0 WHEN 'draw' THEN 1 WHEN 'away_win' THEN 2 ELSE -1 END AS label, count(*) AS n FROM {v_matches} WHERE status = 'played' GROUP BY outcome")
def labels(t):
    return features.match_frame(t("v_matches"), t("v_timeline")).groupBy("outcome", "label").agg(F.count("*").alias("n"))


@plan("JOIN-02", "SELECT team, count(*) AS matches, cast(sum(points) AS bigint) AS points, cast(sum(goals_for) AS bigint) AS gf, cast(sum(goals_against) AS bigint) AS ga FROM {v_history} GROUP BY team")
def history_totals(t):
    rows = features.team_history(t("v_matches"), t("v_timeline")).where("points is not null")
    return rows.groupBy("team").agg(F.count("*").alias("matches"), F.sum("points").alias("points"), F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"))


ASOF = """
    states AS (SELECT team, release_date, points, points - lag(points, 1) OVER w AS c1, points - lag(points, 3) OVER w AS c3 FROM {v_releases} WINDOW w AS (PARTITION BY team ORDER BY release_date)),
    seen AS (SELECT m.match_id, m.date, t.home_elo_pre, t.away_elo_pre, h.points AS hp, h.c1 AS h1, h.c3 AS h3, h.release_date AS hd, m.away_team FROM {v_matches} m JOIN {v_timeline} t ON m.match_id = t.match_id ASOF LEFT JOIN states h ON h.team = m.home_team AND m.date > h.release_date WHERE m.status = 'played'),
    both_seen AS (SELECT s.*, a.points AS ap, a.c1 AS a1, a.c3 AS a3, a.release_date AS ad, s.date - hd AS h_age, s.date - a.release_date AS a_age FROM seen s ASOF LEFT JOIN states a ON a.team = s.away_team AND s.date > a.release_date),
    ready AS (SELECT *, coalesce(h_age <= 450, false) AS h_ok, coalesce(a_age <= 450, false) AS a_ok, coalesce(h_age <= 450, false) AND coalesce(a_age <= 450, false) AND hp IS NOT NULL AND ap IS NOT NULL AS ok FROM both_seen)
"""


@plan("JOIN-05", f"""WITH {ASOF} SELECT match_id, cast(ok AS double) AS fifa_available, cast(coalesce(h_age > 400, false) OR coalesce(a_age > 400, false) AS double) AS fifa_stale, CASE WHEN ok THEN hp END AS home_fifa_points, CASE WHEN ok THEN ap END AS away_fifa_points,
    CASE WHEN h_ok THEN h_age END AS home_days_since_fifa_release, CASE WHEN a_ok THEN a_age END AS away_days_since_fifa_release, CASE WHEN h_ok THEN cast(hd AS varchar) END AS home_fifa_release_date, CASE WHEN a_ok THEN cast(ad AS varchar) END AS away_fifa_release_date, CASE WHEN ok THEN hp - ap END AS fifa_points_diff,
    CASE WHEN ok THEN greatest(h_age, a_age) END AS fifa_release_age_days, CASE WHEN ok THEN h1 END AS home_fifa_points_change_1, CASE WHEN ok THEN h3 END AS home_fifa_points_change_3, CASE WHEN ok THEN a1 END AS away_fifa_points_change_1, CASE WHEN ok THEN a3 END AS away_fifa_points_change_3,
    CASE WHEN ok THEN cast(sign(home_elo_pre - away_elo_pre) <> 0 AND sign(hp - ap) <> 0 AND sign(home_elo_pre - away_elo_pre) <> sign(hp - ap) AS double) END AS favorite_disagree FROM ready""")
def ranking_as_of(t):
    frame = features.match_frame(t("v_matches"), t("v_timeline"))
    return dated(features.ranking_features(frame, t("v_releases")))


@plan("JOIN-05b", "SELECT team, arg_max(points, release_date) AS points, cast(max(release_date) AS varchar) AS release_date FROM {v_releases} WHERE release_date < DATE '1998-06-10' GROUP BY team")
def latest_release(t):
    return dated(temporal.latest_at(t("v_releases"), "team", "release_date", F.lit("1998-06-10").cast("date"), ["points"], "source_row", inclusive=False))


@plan("JOIN-05c", "SELECT team, arg_max(points, release_date) AS points, cast(max(release_date) AS varchar) AS release_date FROM {v_releases} WHERE release_date <= DATE '1998-06-01' GROUP BY team")
def latest_release_inclusive(t):
    return dated(temporal.latest_at(t("v_releases"), "team", "release_date", F.lit("1998-06-01").cast("date"), ["points"], "source_row"))


@plan("JOIN-06", "SELECT p.player_id, v.value, cast(v.date AS varchar) AS date, DATE '2024-01-20' - v.date AS age_days FROM {v_players} p LEFT JOIN (SELECT player_id, arg_max(value, (date, event_id)) AS value, max(date) AS date FROM {v_valuations} WHERE date <= DATE '2024-01-20' GROUP BY player_id) v ON p.player_id = v.player_id")
def valuations_at(t):
    last = temporal.latest_at(t("v_valuations"), "player_id", "date", F.lit("2024-01-20").cast("date"), ["value"], "event_id")
    return dated(t("v_players").select("player_id").join(last, "player_id", "left").withColumn("age_days", F.datediff(F.lit("2024-01-20").cast("date"), "date").cast("long")))


@plan("JOIN-07", """WITH o AS (SELECT * FROM (VALUES ('Cup 1996', DATE '1996-06-08'), ('Cup 1998', DATE '1998-06-10'), ('Cup 2000', DATE '2000-06-10')) AS x(cup, opening)), p AS (SELECT cup, opening, n_name AS team, 1 + (n_nationkey * 7) % 25 AS published FROM o CROSS JOIN {nation}),
    r AS (SELECT team, release_date, rank() OVER (PARTITION BY release_date ORDER BY points DESC) AS rank FROM {v_releases}), j AS (SELECT p.*, r.rank FROM p ASOF LEFT JOIN r ON p.team = r.team AND p.opening > r.release_date)
    SELECT cup, team, published, rank AS reconstructed, CASE WHEN rank IS NULL THEN 'unmatched' WHEN rank = published THEN 'exact' WHEN abs(rank - published) <= 2 THEN 'small' WHEN abs(rank - published) <= 5 THEN 'medium' ELSE 'large' END AS class FROM j""")
def published_ranks(t):
    cups = t.spark.createDataFrame([("Cup 1996", "1996-06-08"), ("Cup 1998", "1998-06-10"), ("Cup 2000", "2000-06-10")], "cup string, opening string").withColumn("opening", F.col("opening").cast("date"))
    published = cups.crossJoin(F.broadcast(t("nation"))).select("cup", "opening", F.col("n_name").alias("team"), (1 + (F.col("n_nationkey") * 7) % 25).alias("published"))
    return ranking.validate_published(published, t("v_releases")).select("cup", "team", F.col("published").cast("long").alias("published"), F.col("reconstructed").cast("long").alias("reconstructed"), "class")


@plan("WIN-14", """WITH s AS (SELECT date, source_row, home_team AS team, cast(source_row % 997 AS double) AS rating FROM {v_matches} WHERE status = 'played' UNION ALL SELECT date, source_row, away_team, cast(source_row % 991 AS double) FROM {v_matches} WHERE status = 'played') SELECT team, arg_max(rating, (date, source_row)) AS rating FROM s WHERE date < DATE '1999-01-01' GROUP BY team""")
def ratings_at(t):
    rows = t("v_matches").where("status = 'played'").select("date", "source_row", "home_team", "away_team", (F.col("source_row") % 997).cast("double").alias("home_elo_post"), (F.col("source_row") % 991).cast("double").alias("away_elo_post"))
    return ratings.ratings_as_of(rows, F.lit("1999-01-01").cast("date"))


@plan("WIN-15", """SELECT match_id, CASE WHEN lower(tournament) LIKE '%qualification%' THEN cast(1.25 AS double) WHEN lower(tournament) LIKE '%friendly%' THEN cast(0.5 AS double) ELSE cast(1 AS double) END AS importance, CASE WHEN abs(home_score - away_score) <= 1 THEN cast(1 AS double) WHEN abs(home_score - away_score) = 2 THEN cast(1.5 AS double) ELSE (11 + abs(home_score - away_score)) / 8.0 END AS margin,
    CASE outcome WHEN 'home_win' THEN cast(1 AS double) WHEN 'draw' THEN cast(0.5 AS double) WHEN 'away_win' THEN cast(0 AS double) ELSE CASE WHEN home_score > away_score THEN cast(1 AS double) WHEN home_score < away_score THEN cast(0 AS double) ELSE cast(0.5 AS double) END END AS actual FROM {v_matches} WHERE status = 'played'""")
def rating_terms(t):
    m = t("v_matches").where("status = 'played'")
    home, away = F.col("home_score"), F.col("away_score")
    return m.select("match_id", ratings.importance(F.col("tournament")).alias("importance"), ratings.margin_multiplier(home - away).alias("margin"), ratings.actual_score(F.col("outcome"), home, away).alias("actual"))


@plan("WIN-15d", "SELECT k, round(1 / (1 + pow(10, -elo_diff / 400)), 6) AS expected FROM {v_preds}")
def expectations(t):
    return t("v_preds").select("k", F.round(ratings.expectation(F.col("elo_diff"), F.lit(0.0)), 6).alias("expected"))


@plan("WIN-13")
def elo(t):
    """Sequential ratings over every played match: no set-based SQL; tests hold it against a plain fold."""
    made = ratings.elo_timeline(t("v_matches"))
    return dated(made.select("match_id", "date", "home_team", "away_team", *[F.round(c, 6).alias(c) for c in ("home_elo_pre", "away_elo_pre", "expected_home", "delta", "home_elo_post", "away_elo_post")]))


@plan("TOPK-06", "SELECT team, points, place FROM (SELECT hn AS team, cast(sum(k % 1000) AS bigint) AS points, row_number() OVER (ORDER BY sum(k % 1000) DESC, hn) AS place FROM {v_base} GROUP BY hn) WHERE place <= 20")
def rating_table(t):
    totals = t("v_base").groupBy(F.col("hn").alias("team")).agg(F.sum(F.col("k") % 1000).alias("points"))
    return totals.orderBy(F.desc("points"), "team").limit(20).withColumn("place", F.row_number().over(Window.orderBy(F.desc("points"), "team")).cast("long"))


@plan("TOPK-05", "WITH r AS (SELECT hn AS team, cast(sum(k % 1000) AS bigint) AS points FROM {v_base} GROUP BY hn) (SELECT team, points FROM r ORDER BY points DESC, team LIMIT 8) UNION (SELECT team, points FROM r ORDER BY points, team LIMIT 8)")
def extremes(t):
    totals = t("v_base").groupBy(F.col("hn").alias("team")).agg(F.sum(F.col("k") % 1000).alias("points"))
    return totals.orderBy(F.desc("points"), "team").limit(8).union(totals.orderBy("points", "team").limit(8)).distinct()


@plan("WIN-18", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM {events}) WHERE n = 1")
def latest_revision(t):
    return temporal.latest_per_key(t("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@plan("WIN-19", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM {events} GROUP BY user_id")
def active_result(t):
    return t("events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@plan("WIN-20", """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS x FROM {customer}), m AS (SELECT median(x) AS med FROM b), f AS (SELECT id, coalesce(x, med) AS y FROM b CROSS JOIN m)
    SELECT id, round(CASE WHEN stddev_pop(y) OVER () > 0 THEN (y - avg(y) OVER ()) / stddev_pop(y) OVER () ELSE 0 END, 5) AS z FROM f""")
def filled_z(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("x"))
    return ranking.filled_zscores(rows, ["x"]).select("id", F.round("z_x", 5).alias("z"))


@plan("JOIN-03")
def wide_table(t):
    """The wide feature table, all columns; its parts have oracles of their own (WIN-03 to WIN-12, JOIN-05)."""
    return dated(features.feature_table(t("v_matches"), t("v_timeline"), t("v_releases"), places=6))


@plan("FLT-07", """SELECT f.year AS fold, CASE WHEN d < make_date(cast(f.year - 2 AS int), 1, 1) THEN 'train' WHEN d < make_date(cast(f.year AS int), 1, 1) THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM {v_base} CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS year) f WHERE d < make_date(cast(f.year + 1 AS int), 1, 1) GROUP BY ALL""")
def fold_sizes(t):
    from fixtura.operators.models import with_folds

    return with_folds(t("v_base"), "d", [1998, 1999, 2000], 2).groupBy("fold", "part").agg(F.count("*").alias("n"))


@plan("FLT-09", "SELECT player_id, count(*) AS n, cast(sum(minutes) AS bigint) AS minutes FROM {v_appearances} WHERE date < DATE '2024-01-20' AND game_id <> 77 GROUP BY player_id")
def before_cutoff(t):
    rows = t("v_appearances").where((F.col("date") < F.lit("2024-01-20").cast("date")) & (F.col("game_id") != 77))
    return rows.groupBy("player_id").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))
