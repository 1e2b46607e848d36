"""Queries that apply known operators to further inputs: the remaining loaders, sinks, signals and protocols."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.operators import blend, graph, metrics, models, overlay, quality, signals, simulate
from fixtura.plans import aggregate_plans, link_plans
from fixtura.plans.more_plans import as_csv
from fixtura.plans.model_plans import six
from fixtura.plans.registry import ORACLES, dated, plan
from fixtura.shared import scratch_path
from fixtura.sources import adapters, delimited, limits, logs, manual, sinks


@plan("SRC-06b", "SELECT s_suppkey AS row_id, s_name AS name FROM {supplier}")
def seed_candidates(t):
    path = as_csv(t("supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name")), "seeds")
    return delimited.optional(t.spark, path, "row_id long, name string")


@plan("SRC-09", "SELECT n_name AS team, cast(1 + (n_nationkey * 7) % 25 AS int) AS published FROM {nation}")
def published_ranks(t):
    path = as_csv(t("nation").select(F.col("n_name").alias("team"), (1 + (F.col("n_nationkey") * 7) % 25).alias("published")), "published")
    return delimited.optional(t.spark, path, "team string, published int")


def last_of(t, group):
    return manual.last_per_team(t("v_players").where(f"group_no = {group}").select("team", "balance", "player_id"), "player_id")


@plan("SRC-17b", "SELECT team, arg_max(balance, player_id) AS balance, max(player_id) AS player_id FROM {v_players} WHERE group_no = 0 GROUP BY team")
def form_rows(t):
    return last_of(t, 0)


@plan("SRC-17c", "SELECT team, arg_max(balance, player_id) AS balance, max(player_id) AS player_id FROM {v_players} WHERE group_no = 1 GROUP BY team")
def style_rows(t):
    return last_of(t, 1)


@plan("SRC-17d", "SELECT team, arg_max(balance, player_id) AS balance, max(player_id) AS player_id FROM {v_players} WHERE group_no = 2 GROUP BY team")
def penalty_rows(t):
    return last_of(t, 2)


@plan("SRC-22", "SELECT 'A' AS team, cast(60 AS double) AS penalty_strength")
def bundled_example(t):
    """The bundled example stands in for a file that isn't there."""
    folder = scratch_path(t.spark, "manual-example")
    t.spark.createDataFrame([("A", 60.0)], "team string, penalty_strength double").coalesce(1).write.option("header", True).csv(f"{folder}/penalties.example.csv")
    return manual.load(t.spark, folder, "penalties").select("team", "penalty_strength")


KNOCKOUT = "SELECT cast(k AS string) AS match_number, 'final' AS round, hn AS team_a, CASE WHEN k % 17 = 0 THEN '' ELSE an END AS team_b, CASE WHEN k % 11 = 0 THEN 'x' ELSE cast(q % 5 AS string) END AS score_a, cast(pk % 4 AS string) AS score_b, CASE WHEN k % 13 = 0 THEN 'maybe' ELSE 'false' END AS aet, CASE WHEN k % 7 = 0 THEN 'yes' ELSE 'no' END AS penalties, CASE WHEN k % 19 = 0 THEN 'Nobody' ELSE hn END AS winner FROM {v_base}"


@plan("SRC-24", f"""WITH r AS (SELECT *, cast(match_number AS bigint) AS k, team_a AS ta, team_b AS tb, try_cast(score_a AS int) AS a, cast(score_b AS int) AS b, penalties = 'yes' AS s FROM ({KNOCKOUT})) SELECT k AS match_number, concat_ws(';', CASE WHEN a IS NULL THEN 'score_a_not_integer' END, CASE WHEN aet = 'maybe' THEN 'aet_not_boolean' END,
    CASE WHEN k NOT BETWEEN 73 AND 104 THEN 'number_range' WHEN k <> 104 THEN 'round' END, CASE WHEN tb = '' THEN 'team_missing' END, CASE WHEN ta = tb THEN 'same_team' END, CASE WHEN winner NOT IN (ta, tb) THEN 'winner' END, CASE WHEN s THEN 'penalties_without_aet' END, CASE WHEN a IS NULL THEN 'one_score' END,
    CASE WHEN s AND a <> b THEN 'shootout_not_level' END, CASE WHEN NOT s AND a = b THEN 'level_without_shootout' END, CASE WHEN NOT s AND a <> b AND winner <> CASE WHEN a > b THEN ta ELSE tb END THEN 'winner_contradicts_score' END) AS problems FROM r""")
def knockout_problems(t):
    """Every match written to a file and scanned by the knockout loader; the problems of each row."""
    path = as_csv(t.sql(KNOCKOUT), "knockout")
    return manual.scan_knockout(t.spark, path).select(F.col("match_number").cast("long").alias("match_number"), "problems")


@plan("SRC-26", "SELECT 16 AS matches, 0 AS problems")
def bracket_tables(t):
    rows = t.spark.createDataFrame([(73 + k, "1A", "2B") for k in range(16)], "match int, slot_1 string, slot_2 string")
    return rows.agg(F.count("*").cast("int").alias("matches")).join(F.broadcast(graph.bracket_problems(rows, 73, 88).agg(F.count("*").cast("int").alias("problems"))))


@plan("SRC-28", "SELECT count(*) AS rows FROM {nation} WHERE false")
def tolerant_run(t):
    return delimited.optional(t.spark, scratch_path(t.spark, "no-run"), "team string, p_champion double").agg(F.count("*").alias("rows"))


@plan("SRC-32", "SELECT n_nationkey, n_name FROM {nation}")
def snapshot(t):
    """An immutable snapshot under the hash of its content; writing the same content again finds it there."""
    rows = t("nation").select("n_nationkey", "n_name")
    path = f"{scratch_path(t.spark, 'cache')}/{sinks.content_hash(rows)}"
    for _ in range(2):
        if not sinks.exists(rows, path):
            sinks.write_table(rows, path)
    return t.spark.read.parquet(path)


@plan("SNK-04", "SELECT count(*) AS entries, 0 AS problems FROM {supplier}")
def logged(t):
    path = scratch_path(t.spark, "log")
    logs.chain(t.sql(link_plans.LOG)).write.parquet(path)
    log = t.spark.read.parquet(path)
    return log.agg(F.count("*").alias("entries")).join(F.broadcast(logs.broken(log).agg(F.count("*").cast("int").alias("problems"))))


@plan("SNK-06", "SELECT 16 AS digits")
def dataset_version(t):
    version = sinks.version_of({"results": sinks.content_hash(t("nation")), "schema": 1})
    return t.spark.createDataFrame([(len(version),)], "digits int")


@plan("SNK-07", "SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type")
def normalised(t):
    path = scratch_path(t.spark, "normalized")
    sinks.write_table(t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), path, partition_by=["event_type"])
    return t.spark.read.parquet(path).select("user_id", "event_type", "n")


@plan("FLT-13", "SELECT s_suppkey FROM {supplier} WHERE sha256(s_name) LIKE (SELECT substr(sha256(s_name), 1, 10) || '%' FROM {supplier} WHERE s_suppkey = 5)")
def resolved_fixture(t):
    rows = t("supplier").select("s_suppkey", F.sha2("s_name", 256).alias("id"))
    prefix = rows.where("s_suppkey = 5").first()["id"][:10]
    hits = rows.where(F.col("id").startswith(prefix))
    return hits.withColumn("n", F.count("*").over(Window.partitionBy())).where("n = 1").select("s_suppkey")


@plan("OPTZ-02")
def simplex(t):
    """Weights on the simplex for a renormalised blend: multiplicative rounds, each one aggregate."""
    labels = t("v_preds").select(F.col("k").alias("match_id"), "label")
    weights = blend.tune_weights(t("v_signals"), labels, ["historical", "market", "recent_form"], 8)
    return t.spark.createDataFrame([(s, round(w, 4)) for s, w in weights.items()], "signal string, weight double")


@plan("SIG-10", "WITH p AS (SELECT competition, greatest((k % 10) / 10.0, 1e-6) AS w, p0, p1, p2 FROM {v_preds}), m AS (SELECT competition, sum(w * p0) / sum(w) AS a, sum(w * p1) / sum(w) AS b, sum(w * p2) / sum(w) AS c, count(*) AS n FROM p GROUP BY competition) SELECT competition, round(a / (a + b + c), 6) AS p0, n AS n_sources FROM m")
def consensus(t):
    rows = t("v_preds").select("competition", ((F.col("k") % 10) / 10).alias("confidence"), "p0", "p1", "p2")
    return six(signals.expert_consensus(rows, "competition").select("competition", "p0", "n_sources"))


@plan("SIG-11e")
def survival_tags(t):
    """How often each path of an upset is named."""
    made = signals.knockout_survival(t.sql(aggregate_plans.STYLES))
    return made.select(F.explode(F.split("tags", r"\|")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


@plan("SIG-12")
def adapter(t):
    """Advancement from goal rates: regulation, extra time at a third, then even chances."""
    ways = link_plans.resolution(t)
    return six(ways.select("home", "away", (F.col("reg_home") + F.col("et_home") + F.col("pen_home")).alias("p_home")))


@plan("SIM-05", f"WITH {link_plans.RANKED} SELECT grp, team, round(count(*) FILTER (position = 3) / {link_plans.N_SIMS}.0, 6) AS p_3, round(count(*) FILTER (position = 4) / {link_plans.N_SIMS}.0, 6) AS p_4 FROM st GROUP BY grp, team")
def lower_places(t):
    made = simulate.position_shares(simulate.standings(link_plans.drawn(t), link_plans.SEED), link_plans.N_SIMS)
    return six(made.select("grp", "team", "p_3", "p_4"))


@plan("SIM-11", "SELECT 100 AS ties")
def single_ties(t):
    ties = t.spark.range(100).select(F.col("id").cast("int").alias("sim"), F.lit(1).cast("long").alias("match"), F.lit("T10").alias("home"), F.lit("T20").alias("away"))
    return simulate.play_round(ties, link_plans.resolution(t), "s").where("winner in ('T10', 'T20')").agg(F.count("*").cast("int").alias("ties"))


OPINIONS = {"T10": {"fitness": 4.0, "tactics": 9.0}, "T11": {"fitness": -3.0}}


@plan("OVL-01", "SELECT 'T10' AS team, cast(10 AS double) AS points UNION ALL SELECT 'T11', -3")
def opinions(t):
    rows = t.spark.createDataFrame([(team, m, p) for team, ms in OPINIONS.items() for m, p in ms.items()], "team string, modifier string, points double")
    return rows.groupBy("team").agg(F.least(F.greatest(F.sum("points"), F.lit(-10.0)), F.lit(10.0)).alias("points"))


@plan("OVL-04", "WITH c AS (SELECT team, least(greatest(sum(points), -10), 10) AS points FROM {v_tags} GROUP BY team) SELECT match, team_a, team_b, round(p, 6) AS p, round(least(greatest(p + least(greatest(coalesce(a.points, 0) - coalesce(b.points, 0), -15), 15) / 100, 0.02), 0.98), 6) AS p_adjusted FROM {v_ties} t LEFT JOIN c a ON a.team = team_a LEFT JOIN c b ON b.team = team_b")
def bracket_frame(t):
    return six(overlay.adjust_pairs(t("v_ties"), t("v_tags")).select("match", "team_a", "team_b", "p", "p_adjusted"))


@plan("OVL-11", "SELECT match, p, 'kept' AS origin FROM {v_ties} WHERE match % 4 > 0 UNION ALL SELECT match, round(1 - p, 6), 'new' FROM {v_ties} WHERE match % 4 = 0")
def merged_blocks(t):
    old = t("v_ties").select("match", "p", F.lit("kept").alias("origin"))
    fresh = old.where("match % 4 = 0").select("match", F.round(1 - F.col("p"), 6).alias("p"), F.lit("new").alias("origin"))
    return quality.replace_rows(old, F.col("match") % 4 == 0, fresh)


@plan("VAL-10b", "SELECT c_mktsegment, CASE WHEN avg((c_acctbal > 0)::INT) >= 0.9 THEN 'ready' WHEN avg((c_acctbal > 0)::INT) >= 0.5 THEN 'partial' ELSE 'blocked' END AS state FROM {customer} GROUP BY c_mktsegment")
def source_readiness(t):
    rate = F.avg((F.col("c_acctbal") > 0).cast("int"))
    return t("customer").groupBy("c_mktsegment").agg(F.when(rate >= 0.9, "ready").when(rate >= 0.5, "partial").otherwise("blocked").alias("state"))


@plan("VAL-13", "SELECT 'missing' AS state")
def path_state(t):
    path = scratch_path(t.spark, "nowhere")
    return t.spark.createDataFrame([("there" if sinks.exists(t("nation"), path) else "missing",)], "state string")


@plan("UDF-04", "WITH f AS (SELECT (count(*) FILTER (label = 0) + 1) / (count(*) + cast(3 AS double)) AS p0, (count(*) FILTER (label = 1) + 1) / (count(*) + cast(3 AS double)) AS p1, (count(*) FILTER (label = 2) + 1) / (count(*) + cast(3 AS double)) AS p2 FROM {v_preds} WHERE year < 1999) SELECT count(*) AS n, round(avg(-ln(CASE label WHEN 0 THEN f.p0 WHEN 1 THEN f.p1 ELSE f.p2 END + 1e-12)), 6) AS log_loss FROM {v_preds} t CROSS JOIN f WHERE t.year >= 1999")
def fit_and_predict(t):
    rows = t("v_preds").select("year", "label")
    fitted = models.class_frequencies(rows.where("year < 1999"))
    return six(models.by_context(rows.where("year >= 1999"), fitted, []).agg(F.count("*").alias("n"), F.avg(metrics.log_loss()).alias("log_loss")))


@plan("SRC-33", "SELECT c_mktsegment AS key, arg_min(c_name || '=' || c_custkey, c_custkey) AS value FROM {customer} WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment")
def settings(t):
    line = F.concat(F.when(F.col("c_acctbal") < 0, " # ").otherwise("  "), "c_mktsegment", F.lit(" = "), "c_name", F.lit("="), "c_custkey", F.lit(" "))
    return delimited.settings(t("customer").select(F.col("c_custkey").alias("seq"), line.alias("line")), ["BUILDING"])


@plan("SNK-09", ORACLES["BLD-08"])
def version_report(t):
    """The comparison of blend versions as a report, read again from its JSON."""
    made, folder = aggregate_plans.version_scores(t), scratch_path(t.spark, "report")
    sinks.write_report(made, folder)
    return t.spark.read.schema(made.schema).json(f"{folder}/json")


@plan("STRM-04", "SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM {events}) WHERE in_window > 1")
def calls_over_the_rate(t):
    """Events are a user's calls; they are too sparse for 60 seconds, so the window is an hour of one call."""
    return limits.rate_breaches(t("events"), "user_id", "ts", 1, 3600).select("event_id", "user_id", "in_window")


@plan("STRM-04b", "SELECT user_id, cast(cast(ts AS date) AS varchar) AS day, count(*) AS used, greatest(0, 4 - count(*)) AS remaining FROM {events} GROUP BY ALL")
def calls_by_day(t):
    return dated(limits.daily_use(t("events"), "user_id", "ts", 5, 1))


def order_source(t):
    rules = {"pending": F.col("o_orderstatus") != "P", "low_price": F.col("o_totalprice") >= 100000}
    return adapters.TableAdapter("orders", "fixtures", t("orders"), "o_orderdate", rules)


@plan("UDF-05", "SELECT 'orders' AS name, 'fixtures' AS role, count(*) AS n_rows, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 100000) AS n_valid, cast(cast(min(o_orderdate) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 100000) AS date) AS varchar) AS first_date, cast(cast(max(o_orderdate) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 100000) AS date) AS varchar) AS last_date FROM {orders}")
def source_coverage(t):
    return dated(order_source(t).coverage())


@plan("UDF-05b", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'low_price' END AS reason FROM {orders} WHERE o_orderstatus = 'P' OR o_totalprice < 100000")
def refused_records(t):
    return order_source(t).refused().select("o_orderkey", "reason")


@plan("UDF-05c", ORACLES["JOIN-09"])
def linked_source(t):
    canonical = t("v_matches").select("date", F.col("home_team").alias("home"), F.col("away_team").alias("away"), "match_id")
    return adapters.Fixtures("fixtures", "fixtures", t("v_source_fixtures"), "date").link_fixtures(canonical)


@plan("UDF-05d", "WITH a AS (SELECT p_name, min(p_partkey) AS player_id FROM {part} GROUP BY p_name HAVING min(p_partkey) = max(p_partkey)) SELECT p.p_partkey, a.player_id FROM {part} p LEFT JOIN a ON p.p_name = a.p_name WHERE p.p_size > 10")
def resolved_source(t):
    source = adapters.Players("parts", "players", t("part"), "p_size", {"small": F.col("p_size") > 10}, "p_name")
    return source.resolve_players(t("part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("player_id"))).select("p_partkey", "player_id")


@plan("UDF-05e", "WITH f AS (SELECT o_custkey AS team, cast(o_orderdate AS date) AS date, max(o_totalprice) AS points FROM {orders} GROUP BY ALL) SELECT f.team, cast(f.date AS varchar) AS date, cast(s.date AS varchar) AS state_date, s.points FROM f ASOF LEFT JOIN (SELECT * FROM f WHERE points >= 100000) s ON f.team = s.team AND f.date > s.date")
def ranked_source(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("team"), F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("points"))
    return dated(adapters.Rankings("points", "ranking", rows, "date", {"low": F.col("points") >= 100000}).as_of(rows.select("team", "date")))


@plan("UDF-05f", "SELECT cast(year(ts) AS int) AS year, event_type, count(*) AS n_events FROM {events} WHERE value IS NOT NULL GROUP BY ALL")
def covered_events(t):
    return adapters.Events("events", "events", t("events"), "ts", {"no_value": F.col("value").isNotNull()}, ("event_type",)).event_coverage()
