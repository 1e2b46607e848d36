"""Queries of the canonical build: parsing, triage, name resolution, reconciliation, scope, audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions import parse
from fixtura.functions.hashing import match_identity
from fixtura.operators import canonical, quality, temporal
from fixtura.plans.registry import dated, plan
from fixtura.sources import delimited
from fixtura.shared import scratch_path

#: The triage in SQL, shared by the oracles below: raw rows with typed columns, names, identity and reason.
TRIAGE = """
    typed AS (
        SELECT source_row, try_cast(trim(date) AS date) AS d, trim(home_team) AS hr, trim(away_team) AS ar, trim(tournament) AS tournament, trim(city) AS city, trim(country) AS country,
            CASE WHEN lower(trim(neutral)) IN ('true', '1') THEN true WHEN lower(trim(neutral)) IN ('false', '0') THEN false END AS neutral,
            CASE WHEN try_cast(trim(home_score) AS int) >= 0 THEN try_cast(trim(home_score) AS int) END AS hs, CASE WHEN try_cast(trim(away_score) AS int) >= 0 THEN try_cast(trim(away_score) AS int) END AS aws,
            trim(home_score) IN ('', 'NA', 'NaN', 'nan') AS hm, trim(away_score) IN ('', 'NA', 'NaN', 'nan') AS am
        FROM {v_matches_raw}
    ), periods AS (
        SELECT trim(former) AS former, trim(current_name) AS cur, try_cast(start_date AS date) AS s, try_cast(end_date AS date) AS e FROM {v_former_names}
        WHERE trim(former) <> '' AND trim(current_name) <> '' AND try_cast(start_date AS date) <= try_cast(end_date AS date)
    ), named AS (
        SELECT t.*, coalesce((SELECT arg_min(cur, (s, e, cur)) FROM periods p WHERE p.former = t.hr AND t.d BETWEEN p.s AND p.e), t.hr) AS h,
            coalesce((SELECT arg_min(cur, (s, e, cur)) FROM periods p WHERE p.former = t.ar AND t.d BETWEEN p.s AND p.e), t.ar) AS a FROM typed t
    ), early AS (
        SELECT *, CASE WHEN d IS NULL THEN 'unparseable_date' WHEN (hs IS NULL AND NOT hm) OR (aws IS NULL AND NOT am) THEN 'unparseable_score' WHEN h = a THEN 'identical_teams' END AS why,
            sha256(concat_ws('|', strftime(d, '%Y-%m-%d'), lower(h), lower(a), lower(tournament), lower(city), lower(country))) AS sha FROM named
    ), triaged AS (
        SELECT *, CASE WHEN why IS NULL THEN sha END AS id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL, CASE WHEN why IS NULL THEN sha END ORDER BY source_row) > 1 THEN 'duplicate_canonical_identity' END) AS reason,
            CASE WHEN hm OR am THEN 'scheduled' ELSE 'played' END AS status FROM early
    ), kept AS (SELECT * FROM triaged WHERE reason IS NULL)
"""

RECONCILED = """
    shots AS (
        SELECT s.*, try_cast(trim(date) AS date) AS d FROM {v_shootouts} s
    ), shot_names AS (
        SELECT s.*, coalesce((SELECT arg_min(cur, (p.s, p.e, cur)) FROM periods p WHERE p.former = trim(home_team) AND s.d BETWEEN p.s AND p.e), trim(home_team)) AS h,
            coalesce((SELECT arg_min(cur, (p.s, p.e, cur)) FROM periods p WHERE p.former = trim(away_team) AND s.d BETWEEN p.s AND p.e), trim(away_team)) AS a,
            coalesce((SELECT arg_min(cur, (p.s, p.e, cur)) FROM periods p WHERE p.former = trim(winner) AND s.d BETWEEN p.s AND p.e), trim(winner)) AS w,
            nullif(coalesce((SELECT arg_min(cur, (p.s, p.e, cur)) FROM periods p WHERE p.former = trim(first_shooter) AND s.d BETWEEN p.s AND p.e), trim(first_shooter)), '') AS f FROM shots s
    ), shot_nth AS (
        SELECT *, CASE WHEN d IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY d, h, a ORDER BY source_row) END AS nth FROM shot_names
    ), found AS (
        SELECT d, h, a, count(*) AS n, min(id) AS id, min(status) AS status, min(hs) AS hs, min(aws) AS aws FROM kept GROUP BY d, h, a
    ), reconciled AS (
        SELECT x.source_row, x.date, x.home_team, x.away_team, x.winner, x.first_shooter, x.w, x.f,
            CASE WHEN x.d IS NULL THEN 'unparseable_date' WHEN nth > 1 THEN 'duplicate_shootout' WHEN m.n IS NULL THEN 'unmatched' WHEN m.n > 1 THEN 'ambiguous_join'
                WHEN x.w NOT IN (x.h, x.a) THEN 'winner_not_participant' WHEN x.f NOT IN (x.h, x.a) THEN 'first_shooter_not_participant'
                WHEN m.status = 'played' AND m.hs <> m.aws THEN 'matched_score_not_tied' ELSE 'matched' END AS status, m.id
        FROM shot_nth x LEFT JOIN found m ON x.d = m.d AND x.h = m.h AND x.a = m.a
    )
"""

SCOPED = """
    won AS (SELECT id, w, f FROM reconciled WHERE status IN ('matched', 'matched_score_not_tied')),
    scoped AS (
        SELECT k.*, won.id IS NOT NULL AS shot, won.w, k.status = 'played' AND won.id IS NULL AS plain,
            CASE WHEN k.status <> 'played' THEN 'unknown' WHEN won.id IS NOT NULL THEN CASE WHEN hs = aws THEN 'draw' ELSE 'unknown' END WHEN hs > aws THEN 'home_win' WHEN hs < aws THEN 'away_win' ELSE 'draw' END AS outcome,
            lower(tournament) NOT LIKE '%qualif%' AND (tournament LIKE '%World Cup%' OR tournament LIKE '%Continental Cup%') AS knockout
        FROM kept k LEFT JOIN won ON k.id = won.id
    )
"""


def built(t):
    return canonical.build(t("v_matches_raw"), t("v_shootouts"), t("v_former_names"))


@plan("SRC-01", "SELECT source_row, coalesce(date, '') AS date, home_team, away_team, home_score, away_score, tournament, city, country, neutral FROM {v_matches_raw}")
def csv_scan(t):
    """A CSV file of all-text cells, written and scanned with provenance."""
    path = scratch_path(t.spark, "results-csv")
    t("v_matches_raw").write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.scan(t.spark, path, canonical.RAW_COLUMNS).select(F.col("source_row").cast("long"), *canonical.RAW_COLUMNS[1:])


@plan("FLT-01", """SELECT source_row, CASE WHEN try_cast(trim(home_score) AS int) >= 0 THEN try_cast(trim(home_score) AS int) END AS value, trim(home_score) IN ('', 'NA', 'NaN', 'nan') AS is_missing,
    trim(home_score) NOT IN ('', 'NA', 'NaN', 'nan') AND coalesce(try_cast(trim(home_score) AS int), -1) < 0 AS is_bad FROM {v_matches_raw}""")
def score_cells(t):
    cell = F.col("home_score")
    return t("v_matches_raw").select("source_row", parse.score_value(cell).alias("value"), parse.score_missing(cell).alias("is_missing"), parse.score_bad(cell).alias("is_bad"))


@plan("FLT-02", "SELECT source_row, CASE WHEN lower(neutral) IN ('true', '1') THEN true WHEN lower(neutral) IN ('false', '0') THEN false END AS flag FROM {v_matches_raw}")
def neutral_cells(t):
    return t("v_matches_raw").select("source_row", parse.neutral_flag(F.col("neutral")).alias("flag"))


@plan("FLT-03", "SELECT tournament, count(*) AS n, lower(tournament) NOT LIKE '%qualif%' AND (tournament LIKE '%World Cup%' OR tournament LIKE '%Continental Cup%') AS capable FROM {v_matches_raw} GROUP BY tournament")
def knockout_capable(t):
    return t("v_matches_raw").groupBy("tournament").agg(F.count("*").alias("n")).withColumn("capable", parse.knockout_capable(F.col("tournament"), canonical.Policy().knockout_patterns))


@plan("FLT-04", f"WITH {TRIAGE} SELECT source_row, id AS canonical_match_id, reason FROM triaged WHERE reason IS NOT NULL")
def triage_reasons(t):
    return canonical.exclusions(canonical.triage(t("v_matches_raw"), t("v_former_names")))


@plan("FLT-05", f"""WITH {TRIAGE}, {RECONCILED}, {SCOPED}, why AS (SELECT *, concat_ws(';', CASE WHEN lower(tournament) LIKE '%under-23%' THEN 'tournament_term:under-23' END, CASE WHEN lower(tournament) LIKE '%select%' THEN 'tournament_term:select' END,
    CASE WHEN plain AND hs <> aws AND knockout THEN 'possible_extra_time_decisive_knockout_capable' END, CASE WHEN status = 'played' AND (hs >= 32 OR aws >= 32) THEN 'implausible_score' END) AS reasons FROM scoped)
    SELECT id AS canonical_match_id, cast(d AS varchar) AS date, h AS home_team, a AS away_team, tournament, hs AS home_score_recorded, aws AS away_score_recorded, reasons, source_row FROM why WHERE reasons <> ''""")
def suspicious(t):
    return dated(built(t)["suspicious_scope"])


@plan("JOIN-04", f"WITH {TRIAGE} SELECT source_row, h AS home_team, a AS away_team FROM named WHERE d IS NOT NULL")
def interval_names(t):
    rows = canonical.triage(t("v_matches_raw"), t("v_former_names"))
    return rows.where("date is not null").select("source_row", "home_team", "away_team")


@plan("JOIN-08", f"WITH {TRIAGE}, {RECONCILED} SELECT source_row, date, home_team, away_team, winner, first_shooter, status, CASE WHEN status NOT IN ('unparseable_date', 'duplicate_shootout', 'unmatched', 'ambiguous_join') THEN id END AS canonical_match_id FROM reconciled")
def shootout_reconciliation(t):
    return built(t)["shootout_reconciliation"].drop("won", "first")


@plan("CANON", f"""WITH {TRIAGE}, {RECONCILED}, {SCOPED} SELECT id AS canonical_match_id, cast(d AS varchar) AS date, h AS home_team, a AS away_team, hr AS home_team_raw, ar AS away_team_raw, tournament, city, country, neutral, status, hs AS home_score_recorded, aws AS away_score_recorded, source_row,
    shot AS shootout_played, w AS shootout_winner, CASE WHEN plain THEN 'regulation' WHEN status = 'played' THEN 'unknown' END AS recorded_score_scope, CASE WHEN plain THEN hs END AS regulation_home_score, CASE WHEN plain THEN aws END AS regulation_away_score, plain AS regulation_score_known,
    outcome AS regulation_outcome, CASE WHEN plain THEN false END AS extra_time_played, plain AND NOT knockout AS extra_time_status_known, plain AS strict_goal_model_eligible, CASE WHEN status <> 'played' THEN 'not_played' WHEN shot THEN 'shootout_score_scope_unknown' END AS strict_exclusion_reason FROM scoped""")
def canonical_table(t):
    return dated(built(t)["matches"].drop("shootout_first_shooter"))


@plan("AGG-01", f"""WITH {TRIAGE}, {RECONCILED}, {SCOPED} SELECT count(*) AS canonical_matches, count(*) FILTER (status = 'played') AS played_matches, count(*) FILTER (status <> 'played') AS scheduled_matches, cast(min(d) AS varchar) AS date_min, cast(max(d) AS varchar) AS date_max,
    count(DISTINCT tournament) AS tournaments, count(*) FILTER (shot) AS shootouts_matched, count(*) FILTER (plain) AS strict_goal_model_eligible, (SELECT count(DISTINCT x) FROM (SELECT h AS x FROM scoped UNION ALL SELECT a FROM scoped)) AS teams,
    (SELECT count(*) FROM triaged) AS raw_rows, (SELECT count(*) FROM triaged WHERE reason IS NOT NULL) AS excluded_rows FROM scoped""")
def build_statistics(t):
    parts = built(t)
    return dated(canonical.build_statistics(parts["triaged"], parts["matches"]))


@plan("AGG-03", f"WITH {TRIAGE}, {RECONCILED} SELECT 'exclusion' AS kind, reason AS value, count(*) AS n FROM triaged WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'reconciliation', status, count(*) FROM reconciled GROUP BY status")
def value_counts(t):
    parts = built(t)
    one = parts["exclusions"].groupBy(F.lit("exclusion").alias("kind"), F.col("reason").alias("value")).agg(F.count("*").alias("n"))
    return one.unionByName(parts["shootout_reconciliation"].groupBy(F.lit("reconciliation").alias("kind"), F.col("status").alias("value")).agg(F.count("*").alias("n")))


@plan("AGG-02", """WITH e AS (SELECT date, home_team, away_team, count(*) AS n FROM {v_raw_once} WHERE source_row % 3 = 0 GROUP BY date, home_team, away_team), m AS (SELECT r.*, coalesce(e.n, 0) AS events FROM {v_raw_once} r LEFT JOIN e ON r.date = e.date AND r.home_team = e.home_team AND r.away_team = e.away_team WHERE try_cast(r.date AS date) IS NOT NULL)
    SELECT year(cast(date AS date)) AS year, count(*) AS matches, count(*) FILTER (events > 0) AS covered, cast(sum(events) AS bigint) AS events, round(count(*) FILTER (events > 0) / cast(nullif(count(*), 0) AS double), 4) AS share FROM m GROUP BY year(cast(date AS date))""")
def yearly_coverage(t):
    return quality.event_coverage(t("v_raw_once"), t("v_raw_once").where("source_row % 3 = 0"))


@plan("JOIN-13", """WITH e AS (SELECT date, home_team, away_team, count(*) AS n FROM {v_raw_once} WHERE source_row % 3 = 0 GROUP BY date, home_team, away_team) SELECT r.source_row, coalesce(e.n, 0) AS events FROM {v_raw_once} r LEFT JOIN e ON r.date = e.date AND r.home_team = e.home_team AND r.away_team = e.away_team""")
def zero_filled_counts(t):
    return quality.with_event_counts(t("v_raw_once"), t("v_raw_once").where("source_row % 3 = 0")).select("source_row", "events")


@plan("HASH-02", "SELECT source_row, sha256(concat_ws('|', lower(trim(date)), lower(trim(home_team)), lower(trim(away_team)), lower(trim(tournament)), lower(trim(city)), lower(trim(country)))) AS identity FROM {v_matches_raw}")
def identities(t):
    return t("v_matches_raw").select("source_row", match_identity(*[F.col(c) for c in ("date", "home_team", "away_team", "tournament", "city", "country")]).alias("identity"))


@plan("WIN-17", """WITH p AS (SELECT source_row, trim(current_name) AS c, trim(former) AS f, try_cast(start_date AS date) AS s, try_cast(end_date AS date) AS e FROM {v_former_names}), k AS (SELECT *, CASE WHEN c = '' OR f = '' THEN 'empty_name' WHEN s IS NULL OR e IS NULL THEN 'invalid_dates' WHEN s > e THEN 'inverted_period' END AS kind FROM p),
    g AS (SELECT * FROM k WHERE kind IS NULL), o AS (SELECT f, lead(s) OVER w <= e AND lead(c) OVER w <> c AS clash FROM g WINDOW w AS (PARTITION BY f ORDER BY s, e, c))
    SELECT kind, cast(source_row AS varchar) AS subject FROM k WHERE kind IS NOT NULL UNION ALL SELECT 'overlapping_mapping', f FROM o WHERE clash UNION ALL SELECT DISTINCT 'chained_mapping', f FROM g WHERE f IN (SELECT c FROM g)""")
def mapping_issues(t):
    return temporal.mapping_issues(t("v_former_names"))


@plan("DEDUP", f"WITH {TRIAGE} SELECT id AS canonical_match_id, source_row, count(*) OVER (PARTITION BY d, h, a) AS n_same FROM kept QUALIFY count(*) OVER (PARTITION BY d, h, a) > 1")
def key_duplicates(t):
    return built(t)["duplicate_identities"].select("canonical_match_id", "source_row", "n_same")


@plan("SET-01", "SELECT match_id, team, is_home, goals_for, goals_against, points FROM {v_history}")
def both_sides(t):
    from fixtura.operators.features import team_history

    return team_history(t("v_matches"), t("v_timeline")).where("points is not null").select("match_id", "team", "is_home", "goals_for", "goals_against", "points")


@plan("SET-03", "SELECT home_team AS team FROM {v_matches} UNION SELECT away_team FROM {v_matches}")
def all_teams(t):
    m = t("v_matches")
    return m.select(F.col("home_team").alias("team")).union(m.select("away_team")).distinct()


@plan("SET-04", "SELECT hn AS team FROM {v_base} EXCEPT SELECT team FROM {v_releases} WHERE release_date < DATE '1995-03-01'")
def unmatched_teams(t):
    return t("v_base").select(F.col("hn").alias("team")).subtract(t("v_releases").where("release_date < date'1995-03-01'").select("team"))


@plan("SET-06", """WITH a AS (SELECT hn FROM {v_base} GROUP BY hn ORDER BY count(*) DESC, hn LIMIT 10), b AS (SELECT an FROM {v_base} GROUP BY an ORDER BY count(*) DESC, an LIMIT 10) SELECT count(*) AS overlap FROM (SELECT hn FROM a INTERSECT SELECT an FROM b)""")
def top_overlap(t):
    top = lambda c: t("v_base").groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(10).select(F.col(c).alias("team"))
    return top("hn").intersect(top("an")).agg(F.count("*").alias("overlap"))


@plan("SET-07", "SELECT count(*) = 0 AS equal FROM ((SELECT home_team AS t FROM {v_matches} EXCEPT SELECT n_name FROM {nation}) UNION ALL (SELECT n_name FROM {nation} EXCEPT SELECT home_team FROM {v_matches}))")
def same_teams(t):
    home, nation = t("v_matches").select(F.col("home_team").alias("t")), t("nation").select(F.col("n_name").alias("t"))
    return home.subtract(nation).union(nation.subtract(home)).agg((F.count("*") == 0).alias("equal"))


@plan("SET-08", "SELECT match_id, signal, p0 FROM {v_signals} WHERE signal <> 'expert' UNION ALL SELECT match_id, 'expert' AS signal, p0 FROM {v_signals} WHERE signal = 'market' AND match_id % 4 = 0")
def replace_by_key(t):
    s = t("v_signals").select("match_id", "signal", "p0")
    fresh = s.where("signal = 'market' and match_id % 4 = 0").withColumn("signal", F.lit("expert"))
    return quality.replace_rows(s, F.col("signal") == "expert", fresh)


@plan("VAL-01", f"WITH {TRIAGE}, {RECONCILED}, {SCOPED} SELECT (SELECT count(*) FROM triaged) = (SELECT count(*) FROM kept) + (SELECT count(*) FROM triaged WHERE reason IS NOT NULL) AS all_accounted, count(*) AS matches, count(*) FILTER (shot) AS shootouts, count(*) FILTER (outcome = 'unknown') AS unknown_outcomes FROM scoped")
def quality_report(t):
    parts = built(t)
    return quality.build_report(parts["triaged"], parts["matches"])


@plan("FLT-14", "SELECT tournament, CASE WHEN lower(tournament) LIKE '%qualif%' THEN 'qualification' WHEN lower(tournament) = 'friendly' THEN 'friendly' WHEN lower(tournament) LIKE '%world cup%' THEN 'world_cup' ELSE 'other' END AS bucket, count(*) AS n FROM {v_matches} GROUP BY tournament")
def buckets(t):
    return t("v_matches").groupBy("tournament").agg(F.count("*").alias("n")).withColumn("bucket", parse.competition_bucket(F.col("tournament")))


@plan("FLT-06", "SELECT match_id, lower(tournament) NOT LIKE '%friendly%' AS competitive FROM {v_matches}")
def competitive(t):
    return t("v_matches").select("match_id", parse.competitive(F.col("tournament")).alias("competitive"))


@plan("TOPK-08", "SELECT match_id, row_number() OVER (ORDER BY date, source_row) AS place FROM {v_matches} ORDER BY date, source_row LIMIT 100")
def ordered_rows(t):
    first = t("v_matches").orderBy("date", "source_row").limit(100)
    return first.select("match_id", F.row_number().over(Window.orderBy("date", "source_row")).cast("long").alias("place"))
