"""Queries of the remaining sources, sinks, scalars, scenario steps and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions import extension, hashing, parse, probs, text
from fixtura.operators import backtest, blend, feedback, graph, metrics, models, overlay, quality, ratings, signals, simulate, squads, temporal
from fixtura.plans import link_plans
from fixtura.plans.model_plans import CELLS, TAU, goal_rows, six
from fixtura.plans.registry import dated, plan
from fixtura.plans.views import TABLES
from fixtura.shared import scratch_path
from fixtura.sources import delimited, logs, manual, sinks

# Sources.


def as_csv(df, name, header=True):
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


@plan("SRC-02", "SELECT 'nation' AS name, count(*) AS n FROM {nation} UNION ALL SELECT 'part', count(*) FROM {part}")
def bundle(t):
    tables = {n: delimited.read_table(t.spark, t.sf_dir, n) for n in ("nation", "part")}
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in tables.items()]
    return counts[0].union(counts[1])


@plan("SRC-03", "SELECT cast(n_nationkey AS varchar) AS id, n_name AS name FROM {nation}")
def marked_csv(t):
    path = scratch_path(t.spark, "bom")
    lines = t("nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    head = t.spark.createDataFrame([("﻿id,name",)], "value string")
    gathered = lines.agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("v"))  # 25 nations
    head.join(gathered).select(F.concat_ws("\n", "value", "v").alias("value")).write.text(path)
    return delimited.scan(t.spark, path, ["id", "name"]).select("id", "name")


@plan("SRC-04", "SELECT cast(c_custkey AS varchar) AS id, trim(c_name) AS name, c_name AS raw_name FROM {customer}")
def raw_copies(t):
    path = as_csv(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "squads")
    rows = delimited.scan(t.spark, path, ["id", "name"])
    return rows.select("id", F.trim("name").alias("name"), F.col("name").alias("raw_name"))


@plan("SRC-05", "SELECT cast(s_suppkey AS varchar) AS id, s_name AS name FROM {supplier}")
def second_extract(t):
    path = as_csv(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "extract")
    return delimited.scan(t.spark, path, ["id", "name"]).select("id", "name")


@plan("SRC-06", "SELECT n_name AS alias, n_nationkey AS id FROM {nation} WHERE false")
def absent_aliases(t):
    return delimited.optional(t.spark, scratch_path(t.spark, "absent"), "alias string, id int")


@plan("SRC-07", "SELECT team, cast(release_date AS varchar) AS release_date, points, rank() OVER (PARTITION BY release_date ORDER BY points DESC) AS rank FROM {v_releases}")
def ranking_timeline(t):
    from fixtura.operators.ranking import release_ranks

    path = as_csv(t("v_releases").select("team", "release_date", "points"), "rankings")
    rows = delimited.scan(t.spark, path, ["team", "release_date", "points"]).select("team", F.col("release_date").try_cast("date").alias("release_date"), F.col("points").try_cast("double").alias("points"))
    return dated(release_ranks(rows).select("team", "release_date", "points", F.col("rank").cast("long").alias("rank")))


@plan("SRC-08", "SELECT team AS nation, cast(points AS varchar) AS total, cast(NULL AS varchar) AS rank FROM {v_releases}")
def mapped_columns(t):
    path = as_csv(t("v_releases").select("team", F.col("points").cast("string").alias("points")), "mapped")
    return delimited.scan(t.spark, path, columns={"team": "nation", "points": "total", "rank_missing": "rank"}).drop("source_file")


@plan("SRC-11", f"SELECT unnest({sorted(TABLES)!r}) AS name")
def table_list(t):
    return t.spark.createDataFrame([(n,) for n in delimited.table_names(t.spark, t.sf_dir) if n in TABLES], "name string")


@plan("SRC-13")
def file_hashes(t):
    """Hashes of the source files; DuckDB doesn't read bytes of files here."""
    return delimited.file_hashes(t.spark, f"{t.sf_dir}/nation.parquet")


@plan("SRC-14", "SELECT event_id, event_type, cast(regexp_extract(props, '[0-9]+') AS int) AS k FROM {events}")
def nested_json(t):
    return t("events").select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


EXPERTS = "SELECT k, concat('m', cast(k % 200 AS string)) AS match_id, hn AS team_a, an AS team_b, CASE WHEN k % 7 > 0 THEN cast(5 + k % 5 AS double) / 10 END AS team_a_win_prob, cast(0.3 AS double) AS draw_prob, cast(0.2 AS double) AS team_b_win_prob, CASE WHEN k % 3 = 0 THEN cast(0.6 AS double) END AS team_a_advance_prob, CASE WHEN k % 3 = 0 THEN cast(0.4 AS double) + cast(k % 2 AS double) / 5 END AS team_b_advance_prob FROM {v_base}"


@plan("SRC-16", f"WITH e AS ({EXPERTS}) SELECT k, CASE WHEN team_a_win_prob IS NULL AND team_a_advance_prob IS NULL THEN 'incomplete' WHEN abs(team_a_win_prob + draw_prob + team_b_win_prob - 1) > 0.05 THEN 'triple_sum' ELSE 'pair_sum' END AS rejected FROM e WHERE (team_a_win_prob IS NULL AND team_a_advance_prob IS NULL) OR abs(team_a_win_prob + draw_prob + team_b_win_prob - 1) > 0.05 OR abs(team_a_advance_prob + team_b_advance_prob - 1) > 0.05")
def rejected_experts(t):
    return manual.split_experts(t.sql(EXPERTS))[1].select("k", "rejected")


@plan("SRC-17", "SELECT team, arg_max(balance, player_id) AS balance, max(player_id) AS player_id FROM {v_players} GROUP BY team")
def last_rows(t):
    return manual.last_per_team(t("v_players").select("team", "balance", "player_id"), "player_id")


@plan("SRC-18", "SELECT k, CASE WHEN k % 3 = 0 THEN concat('m', cast(k AS varchar)) ELSE concat('pair::', hn, '|', an) END AS key FROM {v_base}")
def venue_keys(t):
    rows = t("v_base").select("k", F.when(F.col("k") % 3 == 0, F.concat(F.lit("m"), F.col("k").cast("string"))).otherwise("").alias("match_id"), F.col("hn").alias("team_a"), F.col("an").alias("team_b"))
    return rows.select("k", manual.match_key().alias("key"))


@plan("SRC-19", "SELECT event_id, concat_ws(';', CASE WHEN event_id % 5 = 0 THEN 'available_at' END, CASE WHEN event_id % 5 > 0 AND event_id % 4 = 0 THEN 'after_kickoff' END, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'reason' END) AS broken FROM {events}")
def context_rules(t):
    i = F.col("event_id")
    cells = {c: F.lit(None).cast("double") for c in manual.EDGES} | {"lineup_edge": F.when(i % 3 == 0, 5.0)}
    late = F.when(i % 5 == 0, "2026-06-12 10:00:00").when(i % 4 == 0, "2026-06-12T21:00:00Z").otherwise("2026-06-12T10:00:00Z")
    rows = t("events").select("event_id", F.concat(F.lit("m"), i.cast("string")).alias("match_id"), F.lit("a").alias("team_a"), F.lit("b").alias("team_b"), late.alias("available_at"), F.lit("2026-06-12T20:00:00Z").alias("kickoff_at"), F.when(i % 2 > 0, "late").alias("reason"), *[c.cast("double").alias(n) for n, c in cells.items()])
    return manual.check_context(rows).select("event_id", "broken")


CONVENTIONS = (("home_win", "draw", "away_win"), ("p_home", "p_draw", "p_away"), ("p0", "p1", "p2"))


@plan("SRC-21", "SELECT k, round(p0, 6) AS home, round(p1, 6) AS draw, round(p2, 6) AS away FROM {v_preds}")
def column_conventions(t):
    df = t("v_preds")
    names = next(c for c in CONVENTIONS if set(c) <= set(df.columns))
    return six(df.select("k", *[F.col(old).alias(new) for old, new in zip(names, ("home", "draw", "away"), strict=True)]))


@plan("SRC-20", "SELECT match_id, home_team, away_team FROM {v_matches} WHERE status = 'scheduled'")
def match_list(t):
    return t("v_matches").where("status = 'scheduled'").select("match_id", "home_team", "away_team")


@plan("SRC-23")
def manual_inputs(t):
    """Every manual table of an empty folder: empty, with its columns."""
    folder = scratch_path(t.spark, "manual")
    rows = [(n, len(df.columns), df.count()) for n in sorted(manual.SCHEMAS) for df in [manual.load(t.spark, folder, n)]]
    return t.spark.createDataFrame(rows, "name string, columns int, rows long")


TAGS = {"upset_win": (0.0, 6.0), "poor_performance": (-6.0, 0.0), "fatigue": (-3.0, 0.0)}


@plan("SRC-25", "SELECT event_id, concat_ws(';', CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN 'unknown_tag' END, CASE WHEN (event_type = 'view' AND NOT (value BETWEEN 0 AND 6)) OR (event_type = 'click' AND NOT (value - 6 BETWEEN -6 AND 0)) OR (event_type = 'error' AND NOT (value - 6 BETWEEN -3 AND 0)) THEN 'points' END) AS broken FROM {events}")
def tag_rules(t):
    tag = F.when(F.col("event_type") == "view", "upset_win").when(F.col("event_type") == "click", "poor_performance").when(F.col("event_type") == "error", "fatigue").otherwise("other")
    points = F.when(F.col("event_type") == "view", F.col("value")).otherwise(F.col("value") - 6)
    limits = t.spark.createDataFrame([(n, a, b) for n, (a, b) in TAGS.items()], "tag string, low double, high double")
    met = t("events").select("event_id", tag.alias("tag"), points.alias("points")).join(F.broadcast(limits), "tag", "left")
    rules = F.array_compact(F.array(F.when(F.col("low").isNull(), "unknown_tag"), F.when(~F.col("points").between(F.col("low"), F.col("high")), "points")))
    return met.select("event_id", F.array_join(rules, ";").alias("broken"))


@plan("SRC-27", "SELECT event_type AS label, arg_max(event_id, (ts, event_id)) AS newest FROM {events} GROUP BY event_type")
def newest_runs(t):
    return t("events").groupBy(F.col("event_type").alias("label")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


# Sinks.


@plan("SNK-01", "SELECT 'nation' AS name, count(*) AS n FROM {nation} UNION ALL SELECT 'region', count(*) FROM {region}")
def audit_bundle(t):
    folder = scratch_path(t.spark, "audit")
    sinks.write_audit({n: t(n) for n in ("nation", "region")}, folder)
    counts = [t.spark.read.option("header", True).csv(f"{folder}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("nation", "region")]
    return counts[0].union(counts[1])


@plan("SNK-03", "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey")
def partitioned(t):
    path = scratch_path(t.spark, "artifact")
    sinks.write_table(t("nation"), path, partition_by=["n_regionkey"])
    return t.spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@plan("SNK-05", "SELECT 1 AS written")
def manifest(t):
    path = scratch_path(t.spark, "manifest")
    for _ in range(2):
        sinks.write_manifest(t.spark, {"source": "x", "rows": 3}, path)
    return t.spark.read.text(path).agg(F.count("*").cast("int").alias("written"))


@plan("SNK-08", "SELECT * FROM (VALUES ('a', 0.75::DOUBLE), ('b', 0.25)) AS x(signal, weight)")
def written_weights(t):
    path = scratch_path(t.spark, "weights")
    sinks.write_table(t.spark.createDataFrame([("a", 0.75), ("b", 0.25)], "signal string, weight double"), path)
    return t.spark.read.parquet(path)


@plan("LEDG-01", f"WITH RECURSIVE p AS ({link_plans.LOG}), c AS (SELECT cast(-1 AS bigint) AS seq, repeat('0', 64) AS entry_hash UNION ALL SELECT p.seq, sha256(c.entry_hash || p.payload) FROM c JOIN p ON p.seq = c.seq + 1) SELECT seq, entry_hash FROM c WHERE seq >= 0")
def appended(t):
    rows = t.sql(link_plans.LOG).withColumn("fixture_id", F.get_json_object("payload", "$.fixture_id")).withColumn("model_version", F.get_json_object("payload", "$.model_version")).withColumn("order", F.col("seq"))
    first = logs.append(t.spark.createDataFrame([], logs.CHAIN), rows.where("seq < 50").drop("seq"), ["fixture_id", "model_version"])
    path = scratch_path(t.spark, "ledger")
    first.write.parquet(path)
    old = t.spark.read.parquet(path)
    return old.unionByName(logs.append(old, rows.where("seq >= 50").drop("seq"), ["fixture_id", "model_version"])).select("seq", "entry_hash")


@plan("LEDG-04", "SELECT 0 AS problems")
def intact(t):
    return logs.broken(logs.chain(t.sql(link_plans.LOG))).agg(F.count("*").cast("int").alias("problems"))


@plan("LEDG-05", f"WITH RECURSIVE p AS ({link_plans.LOG}), c AS (SELECT cast(-1 AS bigint) AS seq, repeat('0', 64) AS entry_hash UNION ALL SELECT p.seq, sha256(c.entry_hash || p.payload) FROM c JOIN p ON p.seq = c.seq + 1) SELECT sha256(string_agg(entry_hash, '' ORDER BY seq)) AS hash FROM c WHERE seq >= 0")
def store_hash(t):
    return t.spark.createDataFrame([(logs.log_hash(logs.chain(t.sql(link_plans.LOG))),)], "hash string")


# Filters, sets, scalars.


@plan("FLT-08", "SELECT f.year AS fold, CASE WHEN d < make_date(cast(f.year - 2 AS int), 1, 1) THEN 'train' WHEN d < make_date(cast(f.year AS int), 1, 1) THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM {v_base} CROSS JOIN (SELECT unnest([1996, 1999]) AS year) f WHERE d < make_date(cast(f.year + 1 AS int), 1, 1) GROUP BY ALL HAVING count(*) >= 50")
def kept_folds(t):
    return models.with_folds(t("v_base"), "d", [1996, 1999], 2).groupBy("fold", "part").agg(F.count("*").alias("n")).where("n >= 50")


@plan("FLT-11", "SELECT weight FROM (VALUES ('a', 1), ('b', 2)) AS x(version, weight) WHERE version = 'b'")
def by_version(t):
    return t.spark.createDataFrame([("a", 1), ("b", 2)], "version string, weight int").where("version = 'b'").select("weight")


@plan("FLT-12", "SELECT s_suppkey FROM {supplier} WHERE sha256(s_name) LIKE (SELECT substr(sha256(s_name), 1, 12) || '%' FROM {supplier} WHERE s_suppkey = 3)")
def unique_prefix(t):
    rows = t("supplier").select("s_suppkey", hashing.text_hash(F.col("s_name")).alias("entry_hash"), F.lit("{}").alias("payload"))
    prefix = rows.where("s_suppkey = 3").first()["entry_hash"][:12]
    return logs.find_by_prefix(rows, prefix).select("s_suppkey")


@plan("FLT-15", "SELECT * FROM (VALUES ('fifa_available', true), ('home_long_inactivity', true), ('elo_diff', false)) AS x(name, indicator)")
def indicators(t):
    rows = t.spark.createDataFrame([(n,) for n in ("fifa_available", "home_long_inactivity", "elo_diff")], "name string")
    return rows.withColumn("indicator", F.col("name").rlike(r"(available|stale|known|inactivity|disagree|^is_|_indicator$|at_home)"))


@plan("FLT-18", "SELECT event_id, cast(regexp_extract(props, '[0-9]+') AS int) AS k, event_type || '/' || cast(user_id AS varchar) AS who FROM {events}")
def flattened(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("who"))


@plan("SET-02", "SELECT fold, count(*) AS n FROM (SELECT 1998 AS fold FROM {v_preds} WHERE year = 1998 UNION ALL SELECT 1999 FROM {v_preds} WHERE year = 1999) GROUP BY fold")
def union_of_folds(t):
    parts = [t("v_preds").where(f"year = {y}").select(F.lit(y).alias("fold")) for y in (1998, 1999)]
    return parts[0].unionByName(parts[1]).groupBy("fold").agg(F.count("*").alias("n"))


@plan("SET-05", "SELECT n_name AS team FROM {nation} EXCEPT SELECT home_team FROM {v_matches}")
def not_simulated(t):
    return t("nation").select(F.col("n_name").alias("team")).subtract(t("v_matches").select("home_team"))


@plan("SET-09", "SELECT match_number FROM {v_ties} INTERSECT SELECT match_number FROM {v_tags}")
def common_matches(t):
    return t("v_ties").select("match_number").intersect(t("v_tags").select("match_number"))


@plan("STR-03", "SELECT c_custkey, lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS key FROM {customer}")
def person_keys(t):
    turned = F.concat_ws(", ", F.regexp_extract("c_name", "#(.*)$", 1), F.regexp_extract("c_name", "^(.*)#", 1))
    return t("customer").select("c_custkey", text.person_key(turned).alias("key"))


@plan("STR-09", "SELECT k, cast(d AS varchar) AS noted FROM {v_base}")
def noted(t):
    return dated(t("v_base").select("k", parse.noted_date(F.concat(F.lit("born "), F.col("d").cast("string"), F.lit("; checked"))).alias("noted")))


@plan("STR-10", "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE n_name END AS name FROM {nation}")
def aliased(t):
    table = F.create_map(*[F.lit(x) for x in ("NATION_1", "First", "NATION_2", "Second")])
    return t("nation").select("n_nationkey", F.coalesce(F.try_element_at(table, F.col("n_name")), F.col("n_name")).alias("name"))


@plan("STR-11", "SELECT k, CASE WHEN k % 2 = 0 THEN cast(d AS varchar) END AS born, CASE WHEN k % 2 = 0 THEN hn ELSE an END AS club FROM {v_base}")
def shifted_fields(t):
    """A date in the club's cell and a club in the date's: each goes where it belongs."""
    rows = t("v_base").select("k", F.when(F.col("k") % 2 == 0, F.col("hn")).otherwise("").alias("a"), F.when(F.col("k") % 2 == 0, F.col("d").cast("string")).otherwise(F.col("an")).alias("b"))
    a, b = parse.iso_date(F.col("a")), parse.iso_date(F.col("b"))
    club = F.when(b.isNotNull(), F.col("a")).when(a.isNotNull(), F.col("b")).otherwise(F.coalesce(F.nullif("a", F.lit("")), F.col("b")))
    return dated(rows.select("k", F.coalesce(a, b).alias("born"), club.alias("club")))


@plan("DATE-03", "SELECT user_id, DATE '2024-02-01' - max(cast(ts AS date)) AS days FROM {events} GROUP BY user_id")
def days_since(t):
    return t("events").groupBy("user_id").agg(F.datediff(F.lit("2024-02-01").cast("date"), F.max(F.col("ts").cast("date"))).cast("long").alias("days"))


@plan("DATE-05", "SELECT k, k % 2 = 0 AS zoned FROM {v_base}")
def zoned(t):
    cell = F.when(F.col("k") % 2 == 0, "2026-06-12T10:00:00+02:00").otherwise("2026-06-12T10:00:00")
    return t("v_base").select("k", parse.zoned_timestamp(cell).isNotNull().alias("zoned"))


@plan("DATE-06", "SELECT k, d <= DATE '1998-06-10' AS available FROM {v_base}")
def available(t):
    return t("v_base").select("k", (F.col("d") <= F.lit("1998-06-10").cast("date")).alias("available"))


@plan("MATH-01", "SELECT k, least(greatest(elo_diff, -100), 100) AS clamped FROM {v_preds}".replace("-100)", "cast(-100 AS double))").replace(", 100)", ", cast(100 AS double))"))
def clamped(t):
    return t("v_preds").select("k", probs.clamp(F.col("elo_diff"), -100.0, 100.0).alias("clamped"))


@plan("MATH-05", "SELECT s_suppkey, round(s_acctbal - 1000, 4) AS delta FROM {supplier}")
def deltas(t):
    return t("supplier").select("s_suppkey", F.round(F.col("s_acctbal") - 1000, 4).alias("delta"))


@plan("MATH-07", "SELECT p_partkey, round(exp(-2.5 + (p_size % 9) * ln(2.5) - coalesce(list_sum(list_transform(range(1, p_size % 9 + 1), lambda x: ln(x))), 0)), 8) AS p FROM {part}")
def poisson(t):
    return t("part").select("p_partkey", F.round(models.poisson_pmf(F.col("p_size") % 9, F.lit(2.5)), 8).alias("p"))


@plan("MATH-08", "SELECT match_id, round(2.6 * expected_home, 6) AS home, round(2.6 * (1 - expected_home), 6) AS away FROM {v_timeline}")
def split_goals(t):
    from fixtura.operators.features import split_goals as split

    home, away = split(F.col("expected_home"))
    return six(t("v_timeline").select("match_id", home.alias("home"), away.alias("away")))


@plan("MATH-09", "SELECT k, round(greatest(1.3 * exp(elo_diff / 400), 0.05), 6) AS fav, round(greatest(1.3 * exp(-elo_diff / 400), 0.05), 6) AS und FROM {v_preds}")
def skill_split(t):
    a, b = signals.goal_split(F.lit(2.6), F.col("elo_diff") / 400)
    return six(t("v_preds").select("k", a.alias("fav"), b.alias("und")))


@plan("MAP-01", "SELECT match_id, round(sum(CASE signal WHEN 'historical' THEN 0.35 WHEN 'market' THEN 0.25 WHEN 'squad_strength' THEN 0.15 END), 6) AS total FROM {v_signals} WHERE signal IN ('historical', 'market', 'squad_strength') GROUP BY match_id")
def restricted_weights(t):
    weights = F.create_map(*[F.lit(x) for kv in (("historical", 0.35), ("market", 0.25), ("squad_strength", 0.15)) for x in kv])
    have = t("v_signals").groupBy("match_id").agg(F.collect_set("signal").alias("have"))
    kept = F.map_filter(weights, lambda k, v: F.array_contains("have", k))
    return have.select("match_id", F.round(F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@plan("MAP-02", "SELECT match_id, CASE WHEN lower(tournament) LIKE '%qualification%' THEN cast(1.25 AS double) WHEN lower(tournament) LIKE '%friendly%' THEN cast(0.5 AS double) ELSE cast(1 AS double) END AS importance FROM {v_matches}")
def ordered_rules(t):
    return t("v_matches").select("match_id", ratings.importance(F.col("tournament")).alias("importance"))


@plan("WIN-15b", "SELECT l_orderkey, CASE WHEN q % 8 <= 1 THEN cast(1 AS double) WHEN q % 8 = 2 THEN cast(1.5 AS double) ELSE (11 + q % 8) / cast(8 AS double) END AS m FROM {v_lines}")
def margins(t):
    return t("v_lines").select("l_orderkey", ratings.margin_multiplier(F.col("q") % 8).alias("m"))


@plan("WIN-15c", "SELECT match_id, CASE outcome WHEN 'home_win' THEN cast(1 AS double) WHEN 'draw' THEN CASE WHEN match_id % 2 = 0 THEN cast(0.75 AS double) ELSE cast(0.25 AS double) END WHEN 'away_win' THEN cast(0 AS double) ELSE NULL END AS actual FROM {v_matches} WHERE status = 'played'")
def partial_credit(t):
    settings = ratings.EloSettings(shootout_credit=0.25, recorded_fallback=False)
    made = ratings.actual_score(F.col("outcome"), F.col("home_score"), F.col("away_score"), settings, F.col("match_id") % 2 == 0)
    return t("v_matches").where("status = 'played'").select("match_id", made.alias("actual"))


@plan("WIN-21", "SELECT team, rank() OVER (ORDER BY points DESC) AS place FROM (SELECT hn AS team, sum(k % 1000) AS points FROM {v_base} GROUP BY hn)")
def places(t):
    totals = t("v_base").groupBy(F.col("hn").alias("team")).agg(F.sum(F.col("k") % 1000).alias("points"))
    return totals.select("team", F.rank().over(Window.orderBy(F.desc("points"))).cast("long").alias("place"))


# Models, feedback.


@plan("MET-11b", "SELECT k, CASE WHEN elo_diff / 1000 + 0.05 < 0 THEN 'supported_improvement' WHEN elo_diff / 1000 - 0.05 > 0 THEN 'supported_degradation' WHEN abs(elo_diff / 1000) < 0.001 THEN 'no_meaningful_change' ELSE 'weak_evidence' END AS verdict FROM {v_preds}")
def verdicts(t):
    x = F.col("elo_diff") / 1000
    return t("v_preds").select("k", metrics.delta_verdict(x, x - 0.05, x + 0.05).alias("verdict"))


#: Coefficients and low-score correction of the goal model behind the payloads.
GOALS, RHO = [0.6, 0.4, 0.0], -0.05


def forecasts(t, view="v_preds", more=(), **options):
    """Every forecast with its five likeliest scorelines, in one pass; more columns of the view are kept."""
    home, away = models.expected_goals(GOALS, F.col("elo_diff"), F.lit(0.0))
    made = models.likely_scores(t(view), home, away, list(dict.fromkeys(["k", "p0", "p1", "p2", "home_score", "away_score", "elo_diff", *more])), 5, **options)
    lines = F.transform("scores", lambda x: F.struct(x["h"].alias("home"), x["a"].alias("away"), x["p"].alias("p")))
    own = [c for c in (*more, "markets", "tail_mass") if c in made.columns]
    return made.select("k", "p0", "p1", "p2", F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"), home.alias("home_rate"), away.alias("away_rate"), lines.alias("scorelines"), *own)


@plan("ARR-03", f"WITH {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(p, 9) DESC, h, a) AS place FROM cells) SELECT k, coalesce(string_agg(h || '-' || a, ',' ORDER BY place) FILTER (place <= k % 4), '') AS lines, round(coalesce(sum(p) FILTER (place <= k % 4), 0), 6) AS p, count(*) FILTER (place <= k % 4) AS n FROM o WHERE place <= 3 GROUP BY k")
def scoreline_prefixes(t):
    """The first 0 to 3 scorelines of every forecast."""
    rows = forecasts(t).select("k", F.slice("scorelines", F.lit(1), (F.col("k") % 4).cast("int")).alias("l"))
    names = F.array_join(F.transform("l", lambda x: F.concat_ws("-", x["home"], x["away"])), ",")
    return six(rows.select("k", names.alias("lines"), F.aggregate("l", F.lit(0.0), lambda s, x: s + x["p"]).alias("p"), F.size("l").cast("long").alias("n")))


@plan("MET-13", "SELECT k, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score = away_score THEN 'draw' ELSE 'away_win' END AS actual_outcome, round(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 6) AS probability_of_actual, round(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END), 6) AS log_loss, round(abs(exp(0.6 + 0.4 * elo_diff / 400) - home_score), 6) AS home_goal_error FROM {v_preds}")
def scored(t):
    return six(feedback.score_forecasts(forecasts(t)).select("k", "actual_outcome", "probability_of_actual", "log_loss", "home_goal_error"))


@plan("AGG-31", "SELECT count(*) AS n, round(avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS log_loss, round(avg(pow(p0 - (label = 0)::INT, 2) + pow(p1 - (label = 1)::INT, 2) + pow(p2 - (label = 2)::INT, 2)), 6) AS brier FROM {v_preds}")
def realised(t):
    return six(feedback.score_forecasts(forecasts(t)).agg(F.count("*").alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier")))


CORRECTED = TAU.replace("home_score", "x.h").replace("away_score", "x.a").replace("* x", "* -0.05").replace("1 - x", "1 + 0.05")


@plan("MET-14", f"""WITH {CELLS}, w AS (SELECT x.k, x.home_score, x.away_score, x.h, x.a, x.p * {CORRECTED} AS w FROM cells x JOIN r ON x.k = r.k), m AS (SELECT *, w / sum(w) OVER (PARTITION BY k) AS p FROM w)
    SELECT k, CASE WHEN k % 5 = 0 THEN 'rates_differ' ELSE 'validated_reconstruction' END AS why, CASE WHEN k % 5 > 0 THEN round(p, 6) END AS probability FROM m WHERE h = home_score AND a = away_score""")
def reconstruction(t):
    """The goal model is rebuilt and its matrices made anew; every fifth stored forecast was made with other rates."""
    stored = forecasts(t, more=("elo_diff",), rho=RHO).drop("p0", "p1", "p2")
    frozen = stored.withColumns({"home_rate": F.round(F.col("home_rate") + F.when(F.col("k") % 5 == 0, 0.1).otherwise(0.0), 4), "away_rate": F.round("away_rate", 4), "scorelines": feedback.rounded_lines(F.col("scorelines")), "home_adv": F.lit(0.0)})
    made = feedback.reconstructed(frozen, GOALS, RHO)
    return six(made.select("k", F.col("reconstruction").alias("why"), "probability"))


@plan("LEDG-06")
def payloads(t):
    """Whole forecast payloads as JSON: five scorelines and all markets of the corrected score matrix, the fixture, and
    the data the model has seen, cut the day after the last played match. Engines print numbers differently, tests
    parse them."""
    match = ("home_team", "away_team", "tournament", "date")
    made = forecasts(t, "v_fixture_preds", match, rho=RHO, markets=True)
    cutoff = t("v_matches").where("status = 'played'").agg(F.date_add(F.max("date"), 1).alias("data_cutoff"))  # one row
    model = {"data_cutoff": F.col("data_cutoff"), "dataset_version": F.lit("d1"), "model_version": F.lit("m1")}
    markets = {m: F.col(f"markets.{m}") for m in models.MARKETS}
    body = feedback.payload(F.col("k"), {c: F.col(c) for c in match}, ["p0", "p1", "p2"], ["home_rate", "away_rate"], "scorelines", markets, model)
    return made.join(F.broadcast(cutoff)).select("k", body.alias("payload"))


@plan("PIPE-01")
def one_fold(t):
    rows = backtest.with_features(goal_rows(t))
    return six(metrics.summary(backtest.run_fold(rows, "date", 2000).forecasts, ("model",), "copies"))


@plan("PIPE-03")
def ablation(t):
    """Feature sets on the same fold: each model's loss on the same rows."""
    rows = t("v_preds").select("k", "year", "label", "elo_diff", F.col("b0").alias("x"))
    out = None
    for name, features in {"elo": ["elo_diff"], "both": ["elo_diff", "x"]}.items():
        ready = models.standardiser(rows.where("year < 1999"), features)(rows)
        p = models.logistic_probabilities(models.fit_logistic(ready.where("year < 1999"), features), features)
        made = ready.where("year >= 1999").select("label", *[c.alias(f"p{i}") for i, c in enumerate(p)]).agg(F.lit(name).alias("features"), F.avg(metrics.log_loss()).alias("log_loss"), F.count("*").alias("n"))
        out = made if out is None else out.union(made)
    return six(out)


@plan("MOD-15", "SELECT k, round(0.6 * p0 + 0.4 * b0, 6) AS q0, round(0.6 * p1 + 0.4 * b1, 6) AS q1, round(0.6 * p2 + 0.4 * b2, 6) AS q2 FROM {v_preds}")
def component_blend(t):
    return six(t("v_preds").select("k", *[(0.6 * F.col(f"p{i}") + 0.4 * F.col(f"b{i}")).alias(f"q{i}") for i in range(3)]))


@plan("MOD-14")
def live_model(t):
    """Trained before the last years, calibrated on them, goal model refitted on all."""
    rows = goal_rows(t)
    nu = models.fit_davidson(rows.where("year < 1999"), F.col("elo_diff"))
    p = models.davidson(F.col("elo_diff"), F.lit(nu))
    heat = models.fit_temperature(rows.where("year >= 1999").select("label", *[c.alias(f"p{i}") for i, c in enumerate(p)]))
    beta = models.fit_poisson(models.poisson_rows(rows))
    return t.spark.createDataFrame([(round(nu, 4), round(heat, 4), *[round(b, 4) for b in beta])], "nu double, temperature double, constant double, strength double, home double")


# Signals, blends, scenarios.


@plan("SIG-11b")
def staged(t):
    rows = t("v_preds").select("k", signals.staged_advance(F.lit(2.6), F.greatest(F.col("elo_diff"), F.lit(0.0)) / 400, F.lit(0.5)).alias("p"))
    return six(rows)


@plan("SIG-13", "SELECT signal, count(*) AS n, round(sum(p0), 4) AS p0 FROM {v_signals} GROUP BY signal")
def assembled(t):
    return t("v_signals").groupBy("signal").agg(F.count("*").alias("n"), F.round(F.sum("p0"), 4).alias("p0"))


@plan("SIG-flip", "SELECT k, round(p2, 6) AS p0, round(p1, 6) AS p1, round(p0, 6) AS p2 FROM {v_preds} WHERE k % 2 = 0")
def flipped(t):
    return six(t("v_preds").where("k % 2 = 0").select("k", F.col("p2").alias("p0"), "p1", F.col("p0").alias("p2")))


@plan("BLD-07", "SELECT match_id, count(*) AS signals FROM {v_signals} WHERE signal IN ('historical', 'expert') GROUP BY match_id")
def batch_blend(t):
    made = blend.blend(t("v_signals"), blend.weights_table(t.spark, {"v": blend.VERSIONS["llm_adjusted_challenger"]}))
    return made.select("match_id", F.size("used").cast("long").alias("signals"))


@plan("BLD-09", "SELECT competition, CASE WHEN competition = '5-LOW' THEN 'insufficient_coverage' WHEN avg(p0) < avg(b0) AND avg(p1) < avg(b1) THEN 'improves' ELSE 'no_clear_gain' END AS verdict FROM {v_preds} GROUP BY competition")
def verdict(t):
    made = t("v_preds").groupBy("competition").agg(*[F.avg(c).alias(c) for c in ("p0", "b0", "p1", "b1")])
    coverage = F.when(F.col("competition") == "5-LOW", 0.01).otherwise(0.5)
    return made.select("competition", blend.verdict(F.col("b0"), F.col("p0"), F.col("b1"), F.col("p1"), coverage).alias("verdict"))


@plan("JOIN-22", "WITH a AS (SELECT team_a AS team, avg(p) AS base FROM {v_ties} GROUP BY team_a), b AS (SELECT team_b AS team, avg(p) AS new FROM {v_ties} GROUP BY team_b) SELECT a.team, round(new - base, 5) + 0 AS delta FROM a LEFT JOIN b ON a.team = b.team")
def advancement_deltas(t):
    a = t("v_ties").groupBy(F.col("team_a").alias("team")).agg(F.avg("p").alias("base"))
    b = t("v_ties").groupBy(F.col("team_b").alias("team")).agg(F.avg("p").alias("new"))
    return a.join(b, "team", "left").select("team", (F.round(F.col("new") - F.col("base"), 5) + 0.0).alias("delta"))


@plan("GRF-02", "SELECT team, grp, chr(cast(65 + grp AS int)) AS letter FROM {v_teams48}")
def letters(t):
    return t("v_teams48").select("team", "grp", F.chr((65 + F.col("grp")).cast("long")).alias("letter"))


@plan("GRF-03", "SELECT 0 AS problems")
def bracket(t):
    rows = [(73 + k, f"1{chr(65 + k % 12)}", "THIRD" if k % 2 else f"2{chr(65 + (k + 1) % 12)}") for k in range(16)]
    rows += [(89 + k, f"W{73 + 2 * k}", f"W{74 + 2 * k}") for k in range(8)] + [(97 + k, f"W{89 + 2 * k}", f"W{90 + 2 * k}") for k in range(4)]
    rows += [(101, "W97", "W98"), (102, "W99", "W100"), (103, "L101", "L102"), (104, "W101", "W102")]
    return graph.bracket_problems(t.spark.createDataFrame(rows, "match int, slot_1 string, slot_2 string"), 73, 104).agg(F.count("*").cast("int").alias("problems"))


@plan("GRF-04", "SELECT 73 + grp AS match, '1' AS side, min(team) AS team FROM {v_teams48} GROUP BY grp")
def slots(t):
    order = Window.partitionBy("grp").orderBy("team")
    table = t("v_teams48").select(F.col("grp").cast("string").alias("group"), F.row_number().over(order).alias("position"), "team")
    want = t("v_teams48").select("grp").distinct().select((73 + F.col("grp")).alias("match"), F.lit("1").alias("side"), F.lit("1").alias("kind"), F.col("grp").cast("string").alias("group"))
    none = t.spark.createDataFrame([], "match long, group string")
    return graph.resolve_slots(want, table, none)


def active_results(t):
    return t("v_fixtures").where("played").select("fixture_id", F.col("home_goals").alias("regulation_home_goals"), F.col("away_goals").alias("regulation_away_goals"))


@plan("SIM-13", "SELECT fixture_id, home_goals, away_goals FROM {v_fixtures} WHERE played")
def completed_overlay(t):
    return simulate.validate_completed(t("v_fixtures"), active_results(t)).select("fixture_id", "home_goals", "away_goals")


@plan("SIM-13b", "SELECT fixture_id, concat_ws(';', CASE WHEN fixture_id % 3 = 0 THEN 'missing' END, CASE WHEN fixture_id % 4 = 1 AND fixture_id % 3 > 0 THEN 'repeated' END, CASE WHEN fixture_id % 3 = 0 AND fixture_id % 2 = 0 THEN 'not_fixed' END, CASE WHEN fixture_id % 5 < 2 AND fixture_id % 3 > 0 THEN 'goals_differ' END) AS problems FROM {v_fixtures} WHERE played AND (fixture_id % 3 = 0 OR fixture_id % 4 = 1 OR fixture_id % 5 < 2)")
def overlay_mismatches(t):
    """All fixtures with faults put in: some left out or not played, some twice, some with another score."""
    f, k = t("v_fixtures"), F.col("fixture_id")
    faulty = f.where("not played or fixture_id % 3 > 0 or fixture_id % 2 = 0").withColumn("played", F.col("played") & (k % 3 > 0))
    faulty = faulty.unionByName(faulty.where("fixture_id % 4 = 1"))
    results = active_results(t).withColumn("regulation_home_goals", F.col("regulation_home_goals") + (k % 5 < 2).cast("int"))
    return simulate.completed_problems(faulty, results)


@plan("SIM-15b", "SELECT k, round(p0 / (p0 + p2), 6) AS share FROM {v_preds}")
def ensemble_share(t):
    return six(t("v_preds").select("k", (F.col("p0") / (F.col("p0") + F.col("p2"))).alias("share")))


@plan("SIM-15c", "SELECT k, round(1.3 * exp(least(greatest(elo_diff / 4000, -0.1), 0.1) / 2), 6) AS home FROM {v_preds}")
def squad_rates(t):
    home, _ = squads.adjusted_rates(F.lit(1.3), F.lit(1.3), probs.clamp(F.col("elo_diff") / 4000, -0.1, 0.1), F.lit(0.0))
    return six(t("v_preds").select("k", home.alias("home")))


@plan("SQD-01")
def squad_scores(t):
    """Bounded squad adjustments per team; z-scores over filled medians, held by tests."""
    p = t("v_players").withColumn("m", F.when(F.col("player_id") % 4 > 0, (F.col("player_id") * 37 % 900).cast("double")))
    place = F.get(F.array(*map(F.lit, ("goalkeeper", "defender", "midfielder", "forward"))), (F.col("player_id") % 4).cast("int"))
    activity = p.select("team", "player_id", place.alias("position"), (F.col("player_id") % 9 > 0).alias("local"), (F.col("player_id") % 13 > 0).alias("identified"), *[(F.col("m") * d / 90).alias(f"minutes_{d}d") for d in (30, 90, 180, 365)], *[F.floor(F.col("m") / 90).cast("double").alias(f"starts_{d}d") for d in (30, 90, 180, 365)], (F.col("player_id") % 60).cast("double").alias("days_since_last"))
    values = p.select("team", "player_id", F.when(F.col("player_id") % 11 > 0, F.col("balance")).alias("value"), (F.col("player_id") % 500).cast("double").alias("age_days"))
    weights = dict.fromkeys(squads.COMPONENTS, 1.0)
    thresholds = {"identity_coverage": 0.8, "local_activity_coverage": 0.7, "valuation_coverage": 0.7, "goalkeeper_local_coverage": 0.3, "minimum_position_local_coverage": 0.3}
    made = squads.score_teams(squads.team_features(activity, values), weights, thresholds)
    return six(made.select("team", "score_full", "coverage_confidence", "log_goal_adjustment", "fallback_used"))


@plan("OVL-05", "WITH a AS (SELECT match, p FROM {v_ties} WHERE match % 2 = 0), b AS (SELECT match, 1 - p AS q FROM {v_ties} WHERE match % 3 = 0) SELECT coalesce(a.match, b.match) AS match, round(p, 6) AS model, round(q, 6) AS human, round(q - p, 6) + 0 AS delta_human FROM a FULL JOIN b ON a.match = b.match")
def scenarios(t):
    ties = t("v_ties")
    made = overlay.compare({"model": ties.where("match % 2 = 0").select("match", "p"), "human": ties.where("match % 3 = 0").select("match", (1 - F.col("p")).alias("p"))}, "match", "p")
    return six(made).withColumn("delta_human", F.col("delta_human") + 0.0)


@plan("TOPK-04", "WITH a AS (SELECT match, p, 1 - p AS q FROM {v_ties}), l AS (SELECT match, 'delta_human' AS measure, q - p AS change FROM a) SELECT match, measure, round(change, 6) AS change FROM l ORDER BY abs(round(change, 9)) DESC, match LIMIT 12")
def scenario_movers(t):
    ties = t("v_ties")
    made = overlay.compare({"model": ties.select("match", "p"), "human": ties.select("match", (1 - F.col("p")).alias("p"))}, "match", "p")
    return six(overlay.biggest_movers(made, "match", ["delta_human"], 12))


@plan("OVL-10", "WITH b AS (SELECT team, cast(sum(points) AS double) AS s FROM {v_tags} GROUP BY team) SELECT t.team, round(10 + least(greatest(coalesce(s, 0), -6), 6), 6) AS adjusted FROM (SELECT team FROM {v_teams48}) t LEFT JOIN b ON t.team = b.team")
def form_update(t):
    total = t("v_tags").groupBy("team").agg(F.sum("points").alias("s"))
    return six(t("v_teams48").select("team").join(total, "team", "left").select("team", (10 + probs.clamp(F.coalesce("s", F.lit(0.0)), -6.0, 6.0)).alias("adjusted")))


@plan("OVL-11b", "SELECT team, count(*) AS n, string_agg(cast(match_number AS varchar), ',' ORDER BY match_number, points) AS matches FROM {v_tags} GROUP BY team")
def blocks(t):
    made = t("v_tags").groupBy("team").agg(F.sort_array(F.collect_list(F.struct("match_number", "points"))).alias("b"))
    return made.select("team", F.size("b").cast("long").alias("n"), F.array_join(F.transform("b", lambda x: x["match_number"].cast("string")), ",").alias("matches"))


@plan("OVL-12", "SELECT k, round(abs(p0 - b0), 6) AS with_penalties, round(abs(p0 - b0) - abs(p1 - b1), 6) + 0 AS attribution FROM {v_preds}")
def attribution(t):
    full, part = F.abs(F.col("p0") - F.col("b0")), F.abs(F.col("p1") - F.col("b1"))
    return six(t("v_preds").select("k", full.alias("with_penalties"), (full - part).alias("attribution"))).withColumn("attribution", F.col("attribution") + 0.0)


# Assertions, streams, extensions.


@plan("VAL-03", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_shipdate > TIMESTAMP '2001-09-01 00:00:00'")
def published_late(t):
    rows = t("lineitem").withColumn("cutoff", F.lit("2001-09-01").cast("timestamp"))
    return quality.available_before(rows, "l_shipdate", "cutoff").select("l_orderkey", "l_linenumber", "l_partkey")


CLASSES = {"c_custkey": "static", "c_acctbal": "as_of_required", "c_mktsegment": "unsafe_current_only"}


@plan("VAL-07", "SELECT * FROM (VALUES ('c_acctbal', 'as_of_required'), ('c_custkey', 'static'), ('c_mktsegment', 'unsafe_current_only'), ('c_name', 'unclassified'), ('c_nationkey', 'unclassified')) AS x(name, class)")
def temporal_safety(t):
    known = t.spark.createDataFrame(list(CLASSES.items()), "name string, class string")
    columns = t.spark.createDataFrame([(c,) for c in t("customer").columns], "name string")
    return columns.join(F.broadcast(known), "name", "left").select("name", F.coalesce("class", F.lit("unclassified")).alias("class"))


@plan("VAL-08", "SELECT 0 AS leaks")
def leakage(t):
    """No ranking seen by a match is from its day or later."""
    from fixtura.operators import features

    made = features.ranking_features(features.match_frame(t("v_matches"), t("v_timeline")), t("v_releases")).join(t("v_matches").select("match_id", "date"), "match_id")
    return made.where("home_fifa_release_date >= date or away_fifa_release_date >= date").agg(F.count("*").cast("int").alias("leaks"))


@plan("VAL-11", "SELECT event_type, CASE WHEN count(*) > 2000 THEN 'ingested' WHEN count(*) > 0 THEN 'partial' ELSE 'absent' END AS state FROM {events} GROUP BY event_type")
def source_state(t):
    n = F.count("*")
    return t("events").groupBy("event_type").agg(F.when(n > 2000, "ingested").when(n > 0, "partial").otherwise("absent").alias("state"))


@plan("VAL-12", "SELECT 0 AS forward_filled")
def no_forward_fill(t):
    """Matches long after the last release see no ranking."""
    frame = t("v_matches").select("match_id", "home_team").withColumn("date", F.lit("2010-01-01").cast("date"))
    seen = temporal.asof_join(frame.withColumnRenamed("home_team", "team"), t("v_releases"), "team", "date", "release_date", ["points"])
    return seen.where(F.datediff("date", "state_date") <= 450).agg(F.count("*").cast("int").alias("forward_filled"))


@plan("STRM-01", "SELECT user_id, max(event_id) AS event_id FROM {events} GROUP BY user_id")
def latest_stream(t):
    """Corrections supersede: the table as a stream into a latest-wins sink."""
    from fixtura.streaming.results import latest_results

    source, out, check = (scratch_path(t.spark, n) for n in ("strm-in", "strm-out", "strm-check"))
    t("events").select("user_id", "event_id").write.parquet(source)
    stream = t.spark.readStream.schema("user_id long, event_id long").parquet(source)
    stream.writeStream.foreachBatch(latest_results(out, "user_id", "event_id")).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/v0").select("user_id", "event_id")


@plan("STRM-02")
def rating_stream(t):
    """Ratings carried from batch to batch equal one pass over all; tests compare them."""
    from fixtura.streaming.results import rating_batches

    out = scratch_path(t.spark, "strm-ratings")
    rate = rating_batches(out)
    rate(t("v_matches").where("date < '1998-01-01'"), 0)
    rate(t("v_matches").where("date >= '1998-01-01'"), 1)
    return six(t.spark.read.parquet(f"{out}/ratings/v1"))


@plan("UDF-03", "SELECT year, round(avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1e-12)), 6) AS log_loss, round(avg(pow(p0 - (label = 0)::INT, 2) + pow(p1 - (label = 1)::INT, 2) + pow(p2 - (label = 2)::INT, 2)), 6) AS brier FROM {v_preds} GROUP BY year")
def plugged_metrics(t):
    return six(extension.evaluate(t("v_preds"), ["log_loss", "brier"], ("year",)))


@plan("UDF-01", "SELECT k, round(1.3 * exp(elo_diff / 800), 6) AS home_rate FROM {v_preds}")
def plugged_goals(t):
    return six(extension.with_rates(t("v_preds"), "strength").select("k", "home_rate"))


@plan("UDF-02", "SELECT k AS match_id, 'mine' AS signal, round(p0, 6) AS p0 FROM {v_preds} WHERE k % 2 = 0")
def plugged_signal(t):
    extension.SIGNALS["mine"] = lambda m: m.where("k % 2 = 0").withColumnRenamed("k", "match_id")
    return six(extension.all_signals(t("v_preds"), ["mine"]).select("match_id", "signal", "p0"))


@plan("STR-fold", "SELECT n_nationkey, lower(n_name) AS key FROM {nation}")
def folded(t):
    return t("nation").select("n_nationkey", text.folded_key(F.col("n_name")).alias("key"))
