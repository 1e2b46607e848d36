"""Deterministic domain views over the driver's tables, in SQL that Spark and DuckDB both run.

Placeholders in braces name base tables or other views. Integer arithmetic on keys stands in for the match data
that the engine is for: orders are matches, nations are teams, months of orders are ranking releases, customers
are players and events their appearances.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_lines": """
        SELECT l_orderkey, min(l_suppkey) AS s, cast(sum(cast(l_quantity AS int)) AS bigint) AS q, min(l_partkey) AS pk
        FROM {lineitem} GROUP BY l_orderkey""",
    "v_base": """
        SELECT o.o_orderkey AS k, cast(o.o_orderdate AS date) AS d, hn.n_name AS hn, an.n_name AS an, v.q AS q, v.pk AS pk,
            o.o_orderpriority AS pr, o.o_orderstatus AS st, hn.n_nationkey AS hk, an.n_nationkey AS ak
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} hn ON c.c_nationkey = hn.n_nationkey
            JOIN {v_lines} v ON v.l_orderkey = o.o_orderkey JOIN {supplier} s ON v.s = s.s_suppkey JOIN {nation} an ON s.s_nationkey = an.n_nationkey""",
    "v_raw_once": """
        SELECT k AS source_row,
            CASE WHEN k % 97 = 0 THEN 'not-a-date' ELSE cast(d AS string) END AS date,
            CASE WHEN k % 13 = 0 THEN concat(' ', hn, ' ') ELSE hn END AS home_team, an AS away_team,
            CASE WHEN st = 'O' THEN 'NA' WHEN k % 89 = 0 THEN 'bad' WHEN k % 79 = 0 THEN '-1' WHEN k % 83 = 0 THEN '00' WHEN k % 1009 = 0 THEN '40' ELSE cast(q % 5 AS string) END AS home_score,
            CASE WHEN st = 'O' THEN 'NA' ELSE cast(pk % 4 AS string) END AS away_score,
            CASE pr WHEN '1-URGENT' THEN 'World Cup' WHEN '2-HIGH' THEN 'World Cup qualification' WHEN '3-MEDIUM' THEN 'Continental Cup' WHEN '4-NOT SPECIFIED' THEN 'Friendly' ELSE 'Under-23 Select Games' END AS tournament,
            concat('City ', cast(k % 50 AS string)) AS city,
            CASE WHEN k % 3 = 0 THEN concat('NATION_', cast(k % 25 AS string)) ELSE hn END AS country,
            CASE k % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'False' WHEN 2 THEN '0' ELSE '' END AS neutral
        FROM {v_base}""",
    "v_matches_raw": """
        SELECT source_row, date, home_team, away_team, home_score, away_score, tournament, city, country, neutral FROM {v_raw_once}
        UNION ALL
        SELECT source_row + 10000000 AS source_row, date, home_team, away_team, '1' AS home_score, away_score, tournament, city, country, neutral FROM {v_raw_once} WHERE source_row % 101 = 0""",
    "v_former_names": """
        SELECT * FROM (VALUES
            (2, 'NATION_2', 'NATION_1', '1995-01-01', '1996-06-30'), (3, 'NATION_3', 'NATION_1', '1996-01-01', '1997-12-31'),
            (4, 'NATION_4', 'NATION_5', '1998-01-01', '1997-01-01'), (5, 'NATION_6', 'NATION_10', 'bad', '1999-01-01'),
            (6, '', 'NATION_8', '1995-01-01', '1999-01-01'), (7, 'NATION_7', 'NATION_9', '1995-01-01', '2001-12-31'),
            (8, 'NATION_11', 'NATION_7', '2000-01-01', '2001-12-31'), (9, 'NATION_12', 'NATION_13', '1997-05-05', '1997-05-05')
        ) AS t(source_row, current_name, former, start_date, end_date)""",
    "v_shootouts": """
        SELECT source_row, date, home_team, away_team, CASE WHEN source_row % 2 = 0 THEN home_team ELSE away_team END AS winner,
            CASE WHEN source_row % 5 = 0 THEN '' WHEN source_row % 13 = 0 THEN 'NATION_24' ELSE home_team END AS first_shooter
        FROM {v_raw_once} WHERE source_row % 7 = 0 AND home_score <> 'NA' AND (home_score = away_score OR source_row % 3 = 0)
        UNION ALL
        SELECT source_row + 20000000 AS source_row, date, home_team, away_team, 'NATION_0' AS winner, '' AS first_shooter FROM {v_raw_once} WHERE source_row % 35 = 0
        UNION ALL
        SELECT source_row + 30000000 AS source_row, '2030-01-01' AS date, home_team, away_team, home_team AS winner, '' AS first_shooter FROM {v_raw_once} WHERE source_row % 701 = 0
        UNION ALL
        SELECT source_row + 40000000 AS source_row, date, home_team, away_team, 'Nobody' AS winner, '' AS first_shooter FROM {v_raw_once} WHERE source_row % 71 = 1""",
    "v_matches": """
        SELECT k AS match_id, k AS source_row, d AS date, hn AS home_team, an AS away_team,
            CASE pr WHEN '1-URGENT' THEN 'World Cup' WHEN '2-HIGH' THEN 'World Cup qualification' WHEN '3-MEDIUM' THEN 'Continental Cup' WHEN '4-NOT SPECIFIED' THEN 'Friendly' ELSE 'Regional Games' END AS tournament,
            CASE WHEN k % 3 = 0 THEN concat('NATION_', cast(k % 25 AS string)) ELSE hn END AS country,
            CASE WHEN k % 7 = 0 THEN cast(NULL AS boolean) ELSE k % 3 = 0 END AS neutral,
            CASE WHEN st = 'O' THEN 'scheduled' ELSE 'played' END AS status,
            CASE WHEN st = 'O' THEN NULL ELSE cast(q % 5 AS int) END AS home_score,
            CASE WHEN st = 'O' THEN NULL ELSE cast(pk % 4 AS int) END AS away_score,
            CASE WHEN st = 'O' OR k % 61 = 0 THEN 'unknown' WHEN q % 5 > pk % 4 THEN 'home_win' WHEN q % 5 < pk % 4 THEN 'away_win' ELSE 'draw' END AS outcome
        FROM {v_base} WHERE hn <> an""",
    "v_timeline": """
        SELECT match_id, cast(1400 + (match_id * 7919) % 301 AS double) AS home_elo_pre, cast(1400 + (match_id * 104729) % 301 AS double) AS away_elo_pre,
            1 / (1 + power(cast(10 AS double), (cast((match_id * 104729) % 301 AS double) - cast((match_id * 7919) % 301 AS double)) / 400)) AS expected_home
        FROM {v_matches} WHERE status = 'played'""",
    "v_history": """
        SELECT m.match_id, m.date, m.source_row, m.home_team AS team, m.away_team AS opponent, true AS is_home, m.tournament, m.home_score AS goals_for, m.away_score AS goals_against,
            t.home_elo_pre AS elo_own, t.away_elo_pre AS elo_opp, t.expected_home AS expected, CASE m.outcome WHEN 'home_win' THEN 3 WHEN 'draw' THEN 1 WHEN 'away_win' THEN 0 END AS points
        FROM {v_matches} m JOIN {v_timeline} t ON m.match_id = t.match_id WHERE m.status = 'played' AND m.outcome <> 'unknown'
        UNION ALL
        SELECT m.match_id, m.date, m.source_row, m.away_team AS team, m.home_team AS opponent, false AS is_home, m.tournament, m.away_score AS goals_for, m.home_score AS goals_against,
            t.away_elo_pre AS elo_own, t.home_elo_pre AS elo_opp, 1 - t.expected_home AS expected, CASE m.outcome WHEN 'home_win' THEN 0 WHEN 'draw' THEN 1 WHEN 'away_win' THEN 3 END AS points
        FROM {v_matches} m JOIN {v_timeline} t ON m.match_id = t.match_id WHERE m.status = 'played' AND m.outcome <> 'unknown'""",
    "v_releases": """
        SELECT hn AS team, cast(date_trunc('month', d) AS date) AS release_date, cast(sum(k % 1000) AS double) AS points, min(k) AS source_row
        FROM {v_base} WHERE NOT (hk % 5 = 0 AND k % 2 = 0) GROUP BY hn, cast(date_trunc('month', d) AS date)""",
    "v_preds": """
        SELECT k, extract(year FROM d) AS year, hn AS home_team, an AS away_team, pr AS competition, k % 3 = 0 AS neutral, cast(q % 5 AS int) AS home_score, cast(pk % 4 AS int) AS away_score,
            CASE WHEN q % 5 > pk % 4 THEN 0 WHEN q % 5 = pk % 4 THEN 1 ELSE 2 END AS label,
            cast(1 + k % 7 AS double) / (3 + k % 7 + k % 5 + k % 3) AS p0, cast(1 + k % 5 AS double) / (3 + k % 7 + k % 5 + k % 3) AS p1, cast(1 + k % 3 AS double) / (3 + k % 7 + k % 5 + k % 3) AS p2,
            cast(1 + k % 4 AS double) / (3 + k % 4 + k % 6 + k % 2) AS b0, cast(1 + k % 6 AS double) / (3 + k % 4 + k % 6 + k % 2) AS b1, cast(1 + k % 2 AS double) / (3 + k % 4 + k % 6 + k % 2) AS b2,
            cast((k * 7919) % 601 AS double) - 300 AS elo_diff
        FROM {v_base}""",
    "v_signals": """
        SELECT k AS match_id, 'historical' AS signal, p0, p1, p2 FROM {v_preds}
        UNION ALL SELECT k AS match_id, 'market' AS signal, b0 AS p0, b1 AS p1, b2 AS p2 FROM {v_preds} WHERE k % 2 = 0
        UNION ALL SELECT k AS match_id, 'squad_strength' AS signal, p1 AS p0, p2 AS p1, p0 AS p2 FROM {v_preds} WHERE k % 3 = 0
        UNION ALL SELECT k AS match_id, 'recent_form' AS signal, b2 AS p0, b0 AS p1, b1 AS p2 FROM {v_preds} WHERE k % 5 = 0
        UNION ALL SELECT k AS match_id, 'expert' AS signal, p2 AS p0, p0 AS p1, p1 AS p2 FROM {v_preds} WHERE k % 11 = 0""",
    "v_odds": """
        SELECT p_partkey AS row_id, concat('m', cast(p_partkey % 400 AS string)) AS match_key, CASE WHEN p_partkey % 17 = 0 THEN cast(0.9 AS double) ELSE cast(1.05 AS double) + cast(p_size % 30 AS double) / 10 END AS odds_a,
            CASE WHEN p_partkey % 4 = 0 THEN cast(NULL AS double) ELSE cast(2.5 AS double) + cast(p_partkey % 20 AS double) / 10 END AS odds_draw, cast(1.2 AS double) + cast(p_partkey % 23 AS double) / 10 AS odds_b,
            concat('2026-0', cast(1 + p_partkey % 9 AS string), '-01T00:00:00Z') AS quoted_at
        FROM {part}""",
    "v_players": """
        SELECT c.c_custkey AS player_id, n.n_name AS team, n.n_nationkey % 4 AS group_no, c.c_mktsegment AS position, c.c_name AS name, c.c_acctbal AS balance
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "v_appearances": """
        SELECT event_id, user_id AS player_id, cast(ts AS date) AS date, event_id % 700 AS game_id, event_type, value, cast(event_id % 91 AS bigint) AS minutes, event_id % 2 AS goals
        FROM {events}""",
    "v_teams48": """
        SELECT c_custkey AS id, concat('T', cast(10 + c_custkey AS string)) AS team, c_custkey % 12 AS grp FROM {customer} WHERE c_custkey < 48""",
    "v_fixtures": """
        SELECT a.id * 100 + b.id AS fixture_id, a.grp AS grp, a.team AS home, b.team AS away, (a.id + b.id) % 5 = 0 AS played, cast(a.id % 3 AS int) AS home_goals, cast(b.id % 2 AS int) AS away_goals
        FROM {v_teams48} a JOIN {v_teams48} b ON a.grp = b.grp AND a.id < b.id""",
    "v_source_fixtures": """
        SELECT match_id AS source_id, date, CASE WHEN match_id % 4 = 0 THEN away_team ELSE home_team END AS home, CASE WHEN match_id % 4 = 0 THEN home_team ELSE away_team END AS away
        FROM {v_matches} WHERE match_id % 9 > 0
        UNION ALL SELECT match_id + 50000000 AS source_id, date, 'Nobody' AS home, away_team AS away FROM {v_matches} WHERE match_id % 31 = 0""",
    "v_tags": """
        SELECT concat('T', cast(10 + event_id % 48 AS string)) AS team, cast(event_id % 20 AS int) AS match_number, cast(event_id % 7 - 3 AS double) AS points FROM {events} WHERE event_type = 'view'""",
    "v_ties": """
        SELECT a.id * 100 + b.id AS match, cast(a.id % 20 AS int) AS match_number, a.team AS team_a, b.team AS team_b, cast(1 + (a.id * 7 + b.id * 3) % 9 AS double) / 10 AS p
        FROM {v_teams48} a JOIN {v_teams48} b ON a.id < b.id""",
    "v_squad": """
        SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN concat('  ', upper(c_name)) ELSE c_name END AS name, n_name AS nationality, c_mktsegment AS club,
            CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS source_id, CASE WHEN c_custkey % 4 > 0 THEN concat('19', cast(70 + c_custkey % 30 AS string), '-01-02') END AS dob
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_master": """
        SELECT c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Elsewhere' ELSE n_name END AS nationality, c_mktsegment AS club,
            CASE WHEN c_custkey % 6 > 0 THEN concat('19', cast(70 + c_custkey % 30 AS string), '-01-02') END AS dob
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 11 > 0""",
    "v_valuations": """
        SELECT user_id AS player_id, cast(ts AS date) AS date, value, event_id FROM {events} WHERE event_type = 'purchase'""",
}

# Forecasts with what else is known of their fixtures.
VIEWS["v_fixture_preds"] = VIEWS["v_preds"].replace(
    "SELECT k,",
    """SELECT k, d AS date,
            CASE pr WHEN '1-URGENT' THEN 'FIFA World Cup' WHEN '2-HIGH' THEN 'FIFA World Cup qualification' WHEN '3-MEDIUM' THEN 'Continental Cup' WHEN '4-NOT SPECIFIED' THEN 'Friendly' ELSE 'Regional Games' END AS tournament,""",
)


def names_in(sql: str) -> list[str]:
    """Base tables and views that a text names in braces."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Base tables and views of one folder of Parquet files, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.known: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in VIEWS:
                self.known[name] = self.sql(VIEWS[name])
            else:
                self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.known[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in names_in(text)})


def oracle_text(sql: str) -> str:
    """One statement: the views that sql names in braces as leading common table expressions, then sql."""
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in names_in(text):
            if name in VIEWS and name not in ordered:
                add(VIEWS[name])
                ordered.append(name)

    add(sql)
    plain = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", plain, re.I))
    rest = re.sub(r"^WITH(\s+RECURSIVE)?\b", "", plain, flags=re.I) if re.match(r"WITH\b", plain, re.I) else None
    parts = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n]).strip()})" for n in ordered]
    if not parts:
        return plain
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return f"{head},\n{rest.strip()}" if rest is not None else f"{head}\n{plain}"
