"""Queries of metrics, calibration, models and their fitting."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fixtura.functions.hashing import hash_uniform
from fixtura.operators import feedback, metrics, models
from fixtura.plans.registry import plan
from fixtura.plans.views import Tables
from fixtura.shared import settle

LOSS = "-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 1e-12)"
BRIER = "(pow(p0 - (label = 0)::INT, 2) + pow(p1 - (label = 1)::INT, 2) + pow(p2 - (label = 2)::INT, 2))"
RPS = "((pow(p0 - (label = 0)::INT, 2) + pow(p0 - (label = 0)::INT + p1 - (label = 1)::INT, 2)) / 2)"
HIT = "((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = label)::INT)"
BIN = "least(cast(floor(greatest(p0, p1, p2) * 10) AS int), 9)"


def six(df, *keep):
    """df with its doubles rounded to six places."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


@plan("MET-01", f"SELECT year, count(*) AS n, round(avg({LOSS}), 6) AS log_loss FROM {{v_preds}} GROUP BY year")
def log_losses(t):
    return six(t("v_preds").groupBy("year").agg(F.count("*").alias("n"), F.avg(metrics.log_loss()).alias("log_loss")))


@plan("MET-02", f"SELECT year, round(avg({BRIER}), 6) AS brier FROM {{v_preds}} GROUP BY year")
def briers(t):
    return six(t("v_preds").groupBy("year").agg(F.avg(metrics.brier()).alias("brier")))


@plan("MET-03", f"SELECT year, round(avg({RPS}), 6) AS rps FROM {{v_preds}} GROUP BY year")
def ranked_scores(t):
    return six(t("v_preds").groupBy("year").agg(F.avg(metrics.rps()).alias("rps")))


@plan("MET-04", f"SELECT year, round(avg({HIT}), 6) AS accuracy FROM {{v_preds}} GROUP BY year")
def accuracies(t):
    return six(t("v_preds").groupBy("year").agg(F.avg(metrics.correct()).alias("accuracy")))


@plan("MET-05", f"WITH b AS (SELECT {BIN} AS bin, count(*) AS n, avg(greatest(p0, p1, p2)) AS c, avg({HIT}) AS h FROM {{v_preds}} GROUP BY 1) SELECT round(sum(n * abs(c - h)) / sum(n), 6) AS ece FROM b")
def calibration_error(t):
    return six(metrics.calibration_error(t("v_preds")))


@plan("MET-06", f"WITH b AS (SELECT {BIN} AS bin, count(*) AS n, avg(greatest(p0, p1, p2)) AS c, avg({HIT}) AS h FROM {{v_preds}} GROUP BY 1) SELECT cast(x.bin AS int) AS bin, coalesce(n, 0) AS n, round(c, 6) AS mean_confidence, round(h, 6) AS empirical_accuracy FROM range(10) x(bin) LEFT JOIN b ON x.bin = b.bin")
def reliability(t):
    return six(metrics.reliability(t("v_preds")))


@plan("MET-07", """WITH l AS (SELECT 0 AS class, p0 AS p, (label = 0)::INT AS hit FROM {v_preds} UNION ALL SELECT 1, p1, (label = 1)::INT FROM {v_preds} UNION ALL SELECT 2, p2, (label = 2)::INT FROM {v_preds}),
    b AS (SELECT class, p, hit, (SELECT count(*) FROM (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) AS e(x) WHERE l.p >= e.x) AS bin FROM l) SELECT class, cast(bin AS int) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(hit), 6) AS empirical FROM b GROUP BY class, bin""")
def class_calibration(t):
    return six(metrics.class_calibration(t("v_preds")))


@plan("MET-08", "SELECT count(*) AS n, round(avg(-((label = 0)::INT * ln(least(greatest(p0, 1e-12), 1 - 1e-12)) + (1 - (label = 0)::INT) * ln(1 - least(greatest(p0, 1e-12), 1 - 1e-12)))), 6) AS log_loss, round(avg(pow(p0 - (label = 0)::INT, 2)), 6) AS brier, round(avg(((p0 >= 0.5) = (label = 0))::INT), 6) AS accuracy FROM {v_preds}")
def binary(t):
    return six(metrics.binary_scores(t("v_preds").withColumn("hit", F.col("label") == 0), "p0", "hit"))


@plan("MET-09", f"WITH m AS (SELECT competition, count(*) AS n, avg({LOSS}) AS log_loss, avg({BRIER}) AS brier, avg({RPS}) AS rps, avg({HIT}) AS accuracy FROM {{v_preds}} GROUP BY competition), b AS (SELECT competition, {BIN} AS bin, count(*) AS n, avg(greatest(p0, p1, p2)) AS c, avg({HIT}) AS h FROM {{v_preds}} GROUP BY ALL), e AS (SELECT competition, sum(n * abs(c - h)) / sum(n) AS ece FROM b GROUP BY competition) SELECT m.competition, n, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(rps, 6) AS rps, round(accuracy, 6) AS accuracy, round(ece, 6) AS ece FROM m JOIN e ON m.competition = e.competition")
def summaries(t):
    return six(metrics.summary(t("v_preds"), ("competition",)))


UNIFORM = "cast(('0x' || substr(sha256(concat_ws('|', '7', cast(r AS varchar), cast(i AS varchar))), 1, 12)) AS bigint) / 281474976710656.0"


@plan("MET-10", f"""WITH b AS (SELECT year AS block, sum({LOSS}) AS total, count(*) AS n, row_number() OVER (ORDER BY year) - 1 AS at FROM {{v_preds}} GROUP BY year), k AS (SELECT count(*) AS k, sum(total) / sum(n) AS point FROM b), d AS (SELECT r, i, cast(floor({UNIFORM} * k.k) AS int) AS at FROM range(1000) x(r) CROSS JOIN range(100) y(i) CROSS JOIN k WHERE i < k.k),
    s AS (SELECT r, sum(total) / sum(n) AS stat FROM d JOIN b ON b.at = d.at GROUP BY r) SELECT round(any_value(point), 6) AS point, round(quantile_cont(stat, 0.05), 6) AS ci_low, round(quantile_cont(stat, 0.95), 6) AS ci_high, any_value(k.k) AS blocks FROM s CROSS JOIN k""")
def bootstrap(t):
    return six(metrics.block_bootstrap(t("v_preds"), metrics.log_loss(), "year"))


@plan("MET-11", f"""WITH v AS (SELECT year, {LOSS} - -ln(CASE label WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END + 1e-12) AS x FROM {{v_preds}}), b AS (SELECT year AS block, sum(x) AS total, count(*) AS n, row_number() OVER (ORDER BY year) - 1 AS at FROM v GROUP BY year), k AS (SELECT count(*) AS k, sum(total) / sum(n) AS point FROM b), d AS (SELECT r, i, cast(floor({UNIFORM} * k.k) AS int) AS at FROM range(1000) x(r) CROSS JOIN range(100) y(i) CROSS JOIN k WHERE i < k.k),
    s AS (SELECT r, sum(total) / sum(n) AS stat FROM d JOIN b ON b.at = d.at GROUP BY r), q AS (SELECT any_value(point) AS point, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi, any_value(k.k) AS blocks FROM s CROSS JOIN k)
    SELECT round(point, 6) AS point, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, blocks, CASE WHEN hi < 0 THEN 'supported_improvement' WHEN lo > 0 THEN 'supported_degradation' WHEN abs(point) < 0.001 THEN 'no_meaningful_change' ELSE 'weak_evidence' END AS verdict FROM q""")
def paired(t):
    base = t("v_preds").select("k", "year", "label", *[F.col(f"b{i}").alias(f"p{i}") for i in range(3)])
    return six(metrics.paired_delta(base, t("v_preds"), "k", "year"))


@plan("HASH-U", "SELECT k, round(cast(('0x' || substr(sha256(cast(k AS varchar)), 1, 12)) AS bigint) / 281474976710656.0, 9) AS u FROM {v_base}")
def uniforms(t):
    return t("v_base").select("k", F.round(hash_uniform(F.col("k").cast("string")), 9).alias("u"))


@plan("MOD-01", "SELECT k, round(1 / 3.0, 6) AS p0, round(1 / 3.0, 6) AS p1, round(1 / 3.0, 6) AS p2 FROM {v_preds}".replace("1 / 3.0", "cast(1 AS double) / 3"))
def uniform(t):
    return six(models.uniform(t("v_preds").select("k")))


@plan("MOD-02", "SELECT round((count(*) FILTER (label = 0) + 1) / (count(*) + 3.0), 6) AS p0, round((count(*) FILTER (label = 1) + 1) / (count(*) + 3.0), 6) AS p1, round((count(*) FILTER (label = 2) + 1) / (count(*) + 3.0), 6) AS p2 FROM {v_preds} WHERE year < 1999".replace("3.0", "cast(3 AS double)"))
def frequencies(t):
    return six(models.class_frequencies(t("v_preds").where("year < 1999")))


@plan("MOD-03", """WITH f AS (SELECT neutral, (count(*) FILTER (label = 0) + 1) / (count(*) + cast(3 AS double)) AS p0, (count(*) FILTER (label = 1) + 1) / (count(*) + cast(3 AS double)) AS p1, (count(*) FILTER (label = 2) + 1) / (count(*) + cast(3 AS double)) AS p2 FROM {v_preds} WHERE year < 1999 GROUP BY neutral)
    SELECT t.k, round(f.p0, 6) AS p0, round(f.p1, 6) AS p1, round(f.p2, 6) AS p2 FROM {v_preds} t LEFT JOIN f ON t.neutral = f.neutral WHERE t.year >= 1999""")
def by_neutral(t):
    rows = t("v_preds").select("k", "year", "label", "neutral")
    learnt = models.class_frequencies(rows.where("year < 1999"), ["neutral"])
    return six(models.by_context(rows.where("year >= 1999").select("k", "neutral"), learnt, ["neutral"]).drop("neutral"))


@plan("MOD-04", """WITH f AS (SELECT cast(sign(elo_diff) AS int) AS s, (count(*) FILTER (label = 0) + 1) / (count(*) + cast(3 AS double)) AS p0, (count(*) FILTER (label = 1) + 1) / (count(*) + cast(3 AS double)) AS p1, (count(*) FILTER (label = 2) + 1) / (count(*) + cast(3 AS double)) AS p2 FROM {v_preds} WHERE year < 1999 GROUP BY 1)
    SELECT t.k, round(f.p0, 6) AS p0, round(f.p1, 6) AS p1, round(f.p2, 6) AS p2 FROM {v_preds} t LEFT JOIN f ON cast(sign(t.elo_diff) AS int) = f.s WHERE t.year >= 1999""")
def by_strength(t):
    rows = models.strength_sign(t("v_preds").select("k", "year", "label", "elo_diff"))
    learnt = models.class_frequencies(rows.where("year < 1999"), ["stronger"])
    return six(models.by_context(rows.where("year >= 1999").select("k", "stronger"), learnt, ["stronger"]).drop("stronger"))


def grid(body: str, low: float, high: float) -> str:
    """Four rounds of a grid of 33 points in SQL: each takes the neighbours of the last one's best. body gives the
    mean loss of candidate x."""
    steps = []
    for r in range(4):
        ends = f"SELECT cast({low} AS double) AS lo, cast({high} AS double) AS hi" if not r else f"SELECT greatest(lo, best - (hi - lo) / 32) AS lo, least(hi, best + (hi - lo) / 32) AS hi FROM best{r - 1}"
        steps.append(f"ends{r} AS ({ends}), best{r} AS (SELECT lo, hi, arg_min(x, (loss, x)) AS best, min(loss) AS loss FROM (SELECT lo, hi, lo + i * (hi - lo) / 32 AS x, ({body}) AS loss FROM ends{r} CROSS JOIN range(33) g(i)) GROUP BY lo, hi)")
    return ", ".join(steps)


@plan("MOD-10", f"WITH p AS MATERIALIZED (SELECT label, ln(p0) AS a, ln(p1) AS b, ln(p2) AS c FROM {{v_preds}} WHERE year < 1999), {grid('SELECT avg(-ln(CASE label WHEN 0 THEN exp(a / x) WHEN 1 THEN exp(b / x) ELSE exp(c / x) END / (exp(a / x) + exp(b / x) + exp(c / x)) + 1e-12)) FROM p', 0.2, 5.0)} SELECT round(best, 4) AS temperature, round(loss, 6) AS loss FROM best3")
def temperature(t):
    train = t("v_preds").where("year < 1999").select("label", "p0", "p1", "p2")
    best, loss = models.grid_minimum(train, lambda x: models.label_loss(models.tempered([F.col(c) for c in ("p0", "p1", "p2")], x)), 0.2, 5.0)
    return t.spark.createDataFrame([(round(best, 4), round(loss, 6))], "temperature double, loss double")


@plan("MOD-10b", "WITH r AS (SELECT k, pow(p0, 1 / 1.3) AS a, pow(p1, 1 / 1.3) AS b, pow(p2, 1 / 1.3) AS c FROM {v_preds}) SELECT k, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM r")
def tempered(t):
    made = models.tempered([F.col(c) for c in ("p0", "p1", "p2")], F.lit(1.3))
    return six(t("v_preds").select("k", *[c.alias(f"p{i}") for i, c in enumerate(made)]))


DAVIDSON = "SELECT avg(-ln(CASE label WHEN 0 THEN h WHEN 1 THEN x * sqrt(h * a) ELSE a END / (h + a + x * sqrt(h * a)) + 1e-12)) FROM d"


@plan("MOD-05", f"WITH d AS MATERIALIZED (SELECT label, pow(10, elo_diff / 800) AS h, pow(10, -elo_diff / 800) AS a FROM {{v_preds}} WHERE year < 1999), {grid(DAVIDSON, 1e-6, 5.0)} SELECT round(best, 4) AS nu, round(loss, 6) AS loss FROM best3")
def draw_propensity(t):
    train = t("v_preds").where("year < 1999").select("label", "elo_diff")
    best, loss = models.grid_minimum(train, lambda nu: models.label_loss(models.davidson(F.col("elo_diff"), nu)), 1e-6, 5.0)
    return t.spark.createDataFrame([(round(best, 4), round(loss, 6))], "nu double, loss double")


@plan("OPTZ-01", f"WITH d AS MATERIALIZED (SELECT label, pow(10, elo_diff / 800) AS h, pow(10, -elo_diff / 800) AS a FROM {{v_preds}}), {grid(DAVIDSON, 0.5, 4.5)} SELECT round(best, 4) AS argument FROM best3")
def grid_search(t):
    best, _ = models.grid_minimum(t("v_preds").select("label", "elo_diff"), lambda nu: models.label_loss(models.davidson(F.col("elo_diff"), nu)), 0.5, 4.5)
    return t.spark.createDataFrame([(round(best, 4),)], "argument double")


@plan("SIG-04", "SELECT k, round(pow(10, elo_diff / 800) / (pow(10, elo_diff / 800) + pow(10, -elo_diff / 800) + 1), 6) AS p0, round(1 / (pow(10, elo_diff / 800) + pow(10, -elo_diff / 800) + 1), 6) AS p1, round(pow(10, -elo_diff / 800) / (pow(10, elo_diff / 800) + pow(10, -elo_diff / 800) + 1), 6) AS p2 FROM {v_preds}")
def strength_map(t):
    p = models.davidson(F.col("elo_diff"), F.lit(1.0))
    return six(t("v_preds").select("k", *[c.alias(f"p{i}") for i, c in enumerate(p)]))


@plan("MOD-11", """WITH RECURSIVE m AS MATERIALIZED (SELECT CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS a, CASE label WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS b FROM {v_preds} WHERE year < 1999), em AS (SELECT 0 AS i, cast(0.5 AS double) AS w UNION ALL SELECT i + 1, (SELECT avg(em.w * a / (em.w * a + (1 - em.w) * b)) FROM m) FROM em WHERE i < 60) SELECT round(w, 3) AS w0, round(1 - w, 3) AS w1 FROM em WHERE i = 60""")
def mixture(t):
    rows = t("v_preds").where("year < 1999").select(*[F.when(F.col("label") == 0, F.col(f"{s}0")).when(F.col("label") == 1, F.col(f"{s}1")).otherwise(F.col(f"{s}2")).alias(n) for s, n in (("p", "a"), ("b", "b"))])
    weights = models.fit_mixture(rows, ["a", "b"])
    return t.spark.createDataFrame([tuple(round(w, 3) for w in weights)], "w0 double, w1 double")


@plan("MOD-12", """WITH tr AS (SELECT elo_diff, CASE WHEN k % 4 = 0 THEN NULL ELSE p0 END AS x FROM {v_preds} WHERE year < 1999), m AS (SELECT median(elo_diff) AS me, median(x) AS mx FROM tr), s AS (SELECT avg(elo_diff) AS ae, stddev_samp(elo_diff) AS se, avg(coalesce(x, mx)) AS ax, stddev_samp(coalesce(x, mx)) AS sx, any_value(mx) AS mx FROM tr CROSS JOIN m)
    SELECT k, round((elo_diff - ae) / se, 6) AS elo_diff, round((coalesce(CASE WHEN k % 4 = 0 THEN NULL ELSE p0 END, mx) - ax) / sx, 6) AS x, CASE WHEN neutral THEN cast(1 AS double) ELSE cast(0 AS double) END AS neutral FROM {v_preds} CROSS JOIN s""")
def preprocessed(t):
    rows = t("v_preds").select("k", "year", "elo_diff", F.when(F.col("k") % 4 != 0, F.col("p0")).alias("x"), "neutral")
    apply = models.standardiser(rows.where("year < 1999"), ["elo_diff", "x", "neutral"], ["neutral"])
    return six(apply(rows).select("k", "elo_diff", "x", "neutral"))


def goal_rows(t: Tables):
    """Matches with date, tournament and what models learn from. Where v_shootouts has a shootout, the score of 90 minutes
    is unknown, so the row isn't strict."""
    shot = (F.col("k") % 7 == 0) & ((F.col("home_score") == F.col("away_score")) | (F.col("k") % 3 == 0))
    return t("v_fixture_preds").select("k", "year", "date", "tournament", "home_score", "away_score", "label", "elo_diff", F.when(F.col("neutral"), 0.0).otherwise(1.0).alias("home_adv"), (~shot).alias("strict"))


@plan("MOD-06")
def poisson_fit(t):
    """Coefficients of the goal model; Newton steps have no SQL form here, tests recover known ones."""
    beta = models.fit_poisson(models.poisson_rows(goal_rows(t).where("year < 1999")))
    return t.spark.createDataFrame([tuple(round(b, 5) for b in beta)], "constant double, strength double, home double")


@plan("MOD-06b", "SELECT k, round(exp(least(greatest(0.6 + 0.4 * elo_diff / 400 + 0.2 * CASE WHEN neutral THEN 0 ELSE 1 END, -3), 3)), 6) AS home_rate, round(exp(least(greatest(0.6 - 0.4 * elo_diff / 400, -3), 3)), 6) AS away_rate FROM {v_preds}")
def goal_rates(t):
    home, away = models.expected_goals([0.6, 0.4, 0.2], F.col("elo_diff"), F.col("home_adv"))
    return six(goal_rows(t).select("k", home.alias("home_rate"), away.alias("away_rate")))


RATES = "SELECT k, exp(0.6 + 0.4 * elo_diff / 400) AS lh, exp(0.6 - 0.4 * elo_diff / 400) AS la, home_score, away_score FROM {v_preds}"
CELLS = f"""r AS ({RATES} WHERE k % 1 = 0), g AS (SELECT i, list_sum(list_transform(range(1, i + 1), lambda x: ln(x))) AS lf FROM range(13) t(i)), h AS (SELECT r.*, i AS h, exp(-lh + i * ln(lh) - coalesce(lf, 0)) AS ph FROM r CROSS JOIN g), c AS (SELECT h.k, h.home_score, h.away_score, h.h, g.i AS a, ph * exp(-la + g.i * ln(la) - coalesce(g.lf, 0)) AS raw FROM h CROSS JOIN g),
    cells AS (SELECT *, raw / sum(raw) OVER (PARTITION BY k) AS p FROM c)""".replace(" WHERE k % 1 = 0", "")


def cells(t: Tables):
    home, away = models.expected_goals([0.6, 0.4, 0.0], F.col("elo_diff"), F.lit(0.0))
    return models.score_cells(t("v_preds"), home, away, ["k", "home_score", "away_score"])


@plan("JOIN-27", f"WITH {CELLS} SELECT h, a, count(*) AS n, round(avg(p), 6) AS p FROM cells GROUP BY h, a")
def score_matrix(t):
    return six(cells(t).groupBy("h", "a").agg(F.count("*").alias("n"), F.avg("p").alias("p")))


@plan("OUT-01", f"WITH {CELLS} SELECT k, round(sum(p) FILTER (h > a), 6) AS p0, round(sum(p) FILTER (h = a), 6) AS p1, round(sum(p) FILTER (h < a), 6) AS p2 FROM cells GROUP BY k")
def outcomes(t):
    return six(models.matrix_outcomes(cells(t), ["k"]).select("k", "p0", "p1", "p2"))


@plan("OUT-02", f"WITH {CELLS} SELECT k, round(sum(p) FILTER (h + a > 0), 6) AS over_0_5, round(sum(p) FILTER (h + a > 1), 6) AS over_1_5, round(sum(p) FILTER (h + a > 2), 6) AS over_2_5, round(sum(p) FILTER (h + a > 3), 6) AS over_3_5, round(sum(p) FILTER (h > 0 AND a > 0), 6) AS btts, round(sum(p) FILTER (a = 0), 6) AS home_clean_sheet, round(sum(p) FILTER (h = 0), 6) AS away_clean_sheet FROM cells GROUP BY k")
def markets(t):
    return six(models.matrix_outcomes(cells(t), ["k"]).drop("p0", "p1", "p2", "tail_mass"))


@plan("OUT-03", f"WITH {CELLS} SELECT k, round(1 - sum(raw), 6) AS tail_mass, round(sum(raw) FILTER (h <= 5 AND a <= 5), 6) AS core_mass FROM cells GROUP BY k")
def tails(t):
    made = cells(t).groupBy("k").agg((1 - F.sum("raw")).alias("tail_mass"), F.sum(F.when((F.col("h") <= 5) & (F.col("a") <= 5), F.col("raw"))).alias("core_mass"))
    return six(made)


@plan("TOPK-01", f"WITH {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(p, 9) DESC, h, a) AS place FROM cells) SELECT k, h, a, round(p, 6) AS p, place FROM o WHERE place <= 3")
def top_scores(t):
    return six(top_cells(t, 3))


def top_cells(t: Tables, most: int):
    """The likeliest cells of each matrix."""
    rows = top_arrays(t, most).select("k", F.posexplode("scores").alias("i", "s"))
    return rows.select("k", "s.h", "s.a", "s.p", (F.col("i") + 1).cast("long").alias("place"))


def top_arrays(t: Tables, most: int, *more: str):
    home, away = models.expected_goals([0.6, 0.4, 0.0], F.col("elo_diff"), F.lit(0.0))
    return models.likely_scores(t("v_preds"), home, away, ["k", *more], most)


@plan("TOPK-02", f"WITH {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(p, 9) DESC, h, a) AS place FROM cells) SELECT round(avg((place = 1)::INT), 6) AS top1, round(avg((place <= 3)::INT), 6) AS top3, count(*) AS n FROM o WHERE h = home_score AND a = away_score")
def in_top(t):
    made = top_arrays(t, 3, "home_score", "away_score").select("home_score", "away_score", F.transform("scores", lambda s: F.struct(s["h"].alias("home"), s["a"].alias("away"))).alias("lines"))
    rows = made.select(feedback.scoreline_rank(F.col("lines"), F.col("home_score"), F.col("away_score")).alias("place"))
    return six(rows.agg(F.avg(F.coalesce((F.col("place") == 1).cast("int"), F.lit(0))).alias("top1"), F.avg(F.col("place").isNotNull().cast("int")).alias("top3"), F.count("*").alias("n")))


@plan("MET-12", f"WITH {CELLS}, m AS (SELECT avg(-ln(p + 1e-12)) AS nll FROM cells WHERE h = home_score AND a = away_score), gaps AS (SELECT avg(abs(lh - home_score)) AS mae_home, avg(abs(la - away_score)) AS mae_away, avg(abs(lh + la - home_score - away_score)) AS mae_total FROM r) SELECT round(nll, 6) AS scoreline_nll, round(mae_home, 6) AS mae_home, round(mae_away, 6) AS mae_away, round(mae_total, 6) AS mae_total FROM m CROSS JOIN gaps")
def goal_metrics(t):
    seen = cells(t).where("h = home_score and a = away_score").agg(F.avg(-F.log(F.col("p") + 1e-12)).alias("scoreline_nll"))
    home, away = models.expected_goals([0.6, 0.4, 0.0], F.col("elo_diff"), F.lit(0.0))
    gaps = t("v_preds").agg(F.avg(F.abs(home - F.col("home_score"))).alias("mae_home"), F.avg(F.abs(away - F.col("away_score"))).alias("mae_away"), F.avg(F.abs(home + away - F.col("home_score") - F.col("away_score"))).alias("mae_total"))
    return six(seen.join(F.broadcast(gaps)))


TAU = "greatest(CASE WHEN home_score = 0 AND away_score = 0 THEN 1 - lh * la * x WHEN home_score = 1 AND away_score = 0 THEN 1 + la * x WHEN home_score = 0 AND away_score = 1 THEN 1 + lh * x WHEN home_score = 1 AND away_score = 1 THEN 1 - x ELSE 1 END, 1e-12)"


@plan("MOD-07", f"WITH r AS MATERIALIZED ({RATES}), {grid(f'SELECT avg(-ln({TAU})) FROM r', -0.15, 0.15)} SELECT round(best, 4) AS rho FROM best3")
def low_score_rho(t):
    home, away = models.expected_goals([0.6, 0.4, 0.0], F.col("elo_diff"), F.lit(0.0))
    rows = t("v_preds").select("home_score", "away_score", home.alias("lh"), away.alias("la"))
    return t.spark.createDataFrame([(round(models.fit_rho(rows, "lh", "la"), 4),)], "rho double")


@plan("MOD-07b", f"WITH r AS ({RATES}) SELECT k, round({TAU.replace('* x', '* -0.05').replace('1 - x', '1 + 0.05')}, 6) AS tau FROM r")
def low_score_factors(t):
    home, away = models.expected_goals([0.6, 0.4, 0.0], F.col("elo_diff"), F.lit(0.0))
    return six(t("v_preds").select("k", models.low_score_factor(F.col("home_score"), F.col("away_score"), home, away, F.lit(-0.05)).alias("tau")))


@plan("MOD-08")
def logistic(t):
    """Weights of the multinomial model; Newton steps, held against finite differences in the tests."""
    rows = goal_rows(t).where("year < 1999").withColumns({"d": F.col("elo_diff") / 400, "ad": F.abs(F.col("elo_diff") / 400)})
    weights = models.fit_logistic(rows, ["d", "ad", "home_adv"])
    return t.spark.createDataFrame([(k, *[round(float(w), 5) for w in row]) for k, row in enumerate(weights)], "label int, constant double, d double, ad double, home_adv double")


@plan("MOD-09")
def logistic_columns(t):
    """The same model on standardised columns, scored on later rows."""
    rows = t("v_preds").select("k", "year", "label", "elo_diff", F.col("b0").alias("x"))
    features = ["elo_diff", "x"]
    apply = models.standardiser(rows.where("year < 1999"), features)
    ready = apply(rows)
    p = models.logistic_probabilities(models.fit_logistic(ready.where("year < 1999"), features), features)
    return six(ready.where("year >= 1999").select("k", *[c.alias(f"p{i}") for i, c in enumerate(p)]))


@plan("MOD-13")
def importances(t):
    rows = t("v_preds").select("year", "label", "elo_diff", F.col("b0").alias("x"))
    ready = models.standardiser(rows, ["elo_diff", "x"])(rows)
    return t.spark.createDataFrame([(f, round(v, 5)) for f, v in models.importance_of(models.fit_logistic(ready, ["elo_diff", "x"]), ["elo_diff", "x"])], "feature string, importance double")


@plan("MATH-06", "SELECT k, round(exp(p0) / (exp(p0) + exp(p1) + exp(p2)), 6) AS s0, round(exp(p1) / (exp(p0) + exp(p1) + exp(p2)), 6) AS s1 FROM {v_preds}")
def softmax(t):
    top = F.greatest("p0", "p1", "p2")
    raised = [F.exp(F.col(f"p{i}") - top) for i in range(3)]
    return six(t("v_preds").select("k", *[(raised[i] / (raised[0] + raised[1] + raised[2])).alias(f"s{i}") for i in range(2)]))


@plan("PIPE-02")
def backtest(t):
    """Expanding-window evaluation over every year with rows enough: models fitted on earlier rows, temperature and
    mixture on the three years before; pooled scores with intervals, the ensemble's per kind of competition, scores of
    the goal models, and what was fitted. Fits are loops; tests hold their parts against known answers."""
    from fixtura.operators.backtest import possible_years, run_backtest, tallied, with_features

    rows = settle(tallied(with_features(goal_rows(t))), "tally")
    made = run_backtest(rows, possible_years(rows))
    return six(made.withColumn("fitted", F.transform("fitted", lambda x: F.round(x, 6))))


@plan("TOPK-07", f"WITH s AS (SELECT 'first' AS model, {LOSS} AS l FROM {{v_preds}} UNION ALL SELECT 'second', -ln(CASE label WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END + 1e-12) FROM {{v_preds}} UNION ALL SELECT 'uniform', -ln(1 / 3.0 + 1e-12) FROM {{v_preds}}), m AS (SELECT model, avg(l) AS log_loss FROM s GROUP BY model) SELECT model, round(log_loss, 6) AS log_loss, row_number() OVER (ORDER BY log_loss) AS place FROM m")
def model_ranks(t):
    v = t("v_preds")
    one = v.agg(F.avg(metrics.log_loss()).alias("first"), F.avg(metrics.log_loss(p=("b0", "b1", "b2"))).alias("second"), F.lit(-math.log(1 / 3 + 1e-12)).alias("uniform"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("log_loss")) for m in ("first", "second", "uniform")])))
    from pyspark.sql.window import Window

    return six(rows.withColumn("place", F.row_number().over(Window.orderBy("log_loss")).cast("long")))
