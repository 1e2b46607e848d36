"""Operators without a SQL form, against plain Python; temporal ones against shuffled and extended inputs."""

import json
import math
import random
import re
import time
from datetime import timedelta

import numpy as np
import pytest
from games import matches, plain_elo
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions import parse, probs, text
from fixtura.functions.hashing import hash_uniform
from fixtura.operators import blend, features, graph, metrics, models, overlay, ratings, signals, simulate, squads, temporal
from fixtura.shared import DataError, SchemaError, require_columns


def test_elo_is_a_plain_fold(spark):
    df, rows = matches(spark)
    expected, state = plain_elo(rows)
    made = ratings.elo_timeline(df)
    for r in made.collect():
        assert (r.home_elo_pre, r.away_elo_pre, r.delta) == pytest.approx(expected[r.match_id])
    final = {r.team: r.rating for r in ratings.ratings_as_of(made, F.lit("2999-01-01").cast("date")).collect()}
    assert final == pytest.approx(state)


def test_elo_by_component_equals_the_whole(spark):
    df, _ = matches(spark, 60)
    other = df.select((F.col("match_id") + 1000).alias("match_id"), "source_row", "date", *[F.concat(F.lit("x"), c).alias(c) for c in ("home_team", "away_team")], "tournament", "neutral", "status", "home_score", "away_score", "outcome")
    both = df.unionByName(other)
    groups = graph.components(both.select(F.col("home_team").alias("home"), F.col("away_team").alias("away")))
    assert groups.select("component").distinct().count() == 2
    whole = {r.match_id: r.delta for r in ratings.elo_timeline(both).collect()}
    parts = {r.match_id: r.delta for r in ratings.elo_by_component(both, groups).collect()}
    assert parts == pytest.approx(whole)


def test_features_ignore_later_rows(spark):
    df, _ = matches(spark)
    timeline = ratings.elo_timeline(df).select("match_id", "home_elo_pre", "away_elo_pre", "expected_home")
    made = lambda d: {(r.match_id, r.is_home): r for r in features.rolling_form(features.team_history(d, timeline)).collect()}
    whole, early = made(df), made(df.where("date < '2020-03-01'"))
    assert early and all(whole[k] == v for k, v in early.items())


def test_form_streams_whatever_the_batches(spark):
    """Batches end anywhere in a team, a day or a tournament; no window holds a team's history."""
    df, _ = matches(spark)
    timeline = ratings.elo_timeline(df).select("match_id", "home_elo_pre", "away_elo_pre", "expected_home")
    history = features.team_history(df, timeline)
    order = Window.partitionBy("team").orderBy("date", "source_row")
    same = Window.partitionBy("team", "tournament").orderBy("day").rangeBetween(-60, 0)
    later = Window.partitionBy("team", "tournament", "date").orderBy("source_row").rowsBetween(0, Window.unboundedFollowing)
    plain = history.withColumn("day", F.datediff("date", F.lit("2000-01-01").cast("date"))).select("match_id", "is_home", F.avg("points").over(order.rowsBetween(-10, -1)).alias("ppm"), (1 + F.count("*").over(same) - F.count("*").over(later)).alias("seq"))
    want = {(r.match_id, r.is_home): (r.ppm, r.seq) for r in plain.collect()}
    form = features.rolling_form(history)
    assert "Window" not in form._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.match_id, r.is_home): r for r in form.collect()}
    assert {k: (r.ppm_last10, r.tournament_seq) for k, r in whole.items()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r.match_id, r.is_home): r for r in features.rolling_form(history).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_table_is_compiled(spark):
    """The JVM runs methods of over 8,000 bytes interpreted."""
    df, _ = matches(spark)
    timeline = ratings.elo_timeline(df).select("match_id", "home_elo_pre", "away_elo_pre", "expected_home")
    releases = df.groupBy(F.col("home_team").alias("team"), F.last_day("date").alias("release_date")).agg(F.sum("source_row").cast("double").alias("points"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = features.feature_table(df.withColumn("country", F.lit("x")), timeline, releases, places=6)
        code = spark._jvm.PythonSQLUtils.explainString(table._jdf.queryExecution(), "codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) <= 8000, sizes
        assert table.count() == df.where("status = 'played'").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_asof_is_strict(spark):
    facts = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 1)], "id int, key string, t int")
    states = spark.createDataFrame([("a", 5, 10.0), ("a", 3, 7.0)], "key string, at int, v double")
    strict = {r.id: r.v for r in temporal.asof_join(facts, states, "key", "t", "at", ["v"]).collect()}
    loose = {r.id: r.v for r in temporal.asof_join(facts, states, "key", "t", "at", ["v"], strict=False).collect()}
    assert strict == {1: 7.0, 2: 10.0, 3: None} and loose == {1: 10.0, 2: 10.0, 3: None}


def test_poisson_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(0, 0.5, 6000), rng.integers(0, 2, 6000)
    y = rng.poisson(np.exp(0.1 + 0.4 * x1 + 0.25 * x2))
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2, strict=True)], "goals double, x1 double, x2 double")
    assert models.fit_poisson(rows) == pytest.approx([0.1, 0.4, 0.25], abs=0.06)


def test_logistic_is_a_minimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = np.clip(np.round(1 + x * 0.6 + rng.normal(0, 0.7, 400)), 0, 2).astype(int)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x, strict=True)], "label int, x double")
    w = np.array(models.fit_logistic(rows, ["x"]))

    def loss(w):
        z = w[:, :1].T + np.outer(x, w[:, 1])
        z = z - z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(len(y)), y]).mean() + 1e-4 * (w**2).sum()

    for i in np.ndindex(w.shape):
        step = np.zeros(w.shape)
        step[i] = 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-6


def test_mixture_prefers_the_better_member(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(rnd.uniform(0.5, 0.9), rnd.uniform(0.1, 0.4)) for _ in range(200)], "a double, b double")
    assert models.fit_mixture(rows, ["a", "b"])[0] > 0.99


def test_temperature_one_changes_nothing(spark):
    row = spark.range(1).select(F.lit(0.5).alias("p0"), F.lit(0.3).alias("p1"), F.lit(0.2).alias("p2"))
    made = row.select(*[c.alias(f"q{k}") for k, c in enumerate(models.tempered([F.col(f"p{k}") for k in range(3)], F.lit(1.0)))]).first()
    assert list(made) == pytest.approx([0.5, 0.3, 0.2])


def poisson(k, rate):
    return math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))


@pytest.mark.parametrize("a,b", [(1.4, 1.0), (0.05, 3.2), (2.5, 2.5)])
def test_skellam_is_the_direct_sum(spark, a, b):
    win, draw, loss = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(probs.skellam_outcomes(F.lit(a), F.lit(b)))]).first()
    direct = {s: 0.0 for s in (1, 0, -1)}
    for i in range(40):
        for j in range(40):
            direct[(i > j) - (i < j)] += poisson(i, a) * poisson(j, b)
    assert (win, draw, loss) == pytest.approx((direct[1], direct[0], direct[-1]), abs=1e-6)


def test_survival_abstains_without_evidence_and_is_bounded(spark):
    cols = ["und_low_block_defense", "und_defensive_compactness", "fav_sterile_possession_risk", "und_transition_threat", "fav_chance_creation", "fav_struggles_vs_low_block", "und_set_piece_threat", "und_aerial_threat"]
    schema = "evidence boolean, p_fav double, fav_rating double, und_rating double, " + ", ".join(f"{c} double" for c in cols)
    rows = spark.createDataFrame([(False, 0.7, None, None, *[None] * 8), (True, 0.7, None, None, *[None] * 8), (True, 0.9, -1.0, 1.0, *[100.0] * 8)], schema)
    none, neutral, strong = signals.knockout_survival(rows).collect()
    assert none.shift is None and none.p_final is None
    assert neutral.shift == pytest.approx(0, abs=1e-9) and neutral.p_final == pytest.approx(0.7)
    assert 0 < strong.shift <= 0.15 and "low_block_survival_path" in strong.tags


def test_power_margin_sums_to_one(spark):
    p = spark.range(1).select(probs.power_margin(F.array(F.lit(0.6), F.lit(0.3), F.lit(0.2))).alias("p")).first()[0]
    assert sum(p) == pytest.approx(1) and p[0] > 0.6 / 1.1


def test_normalised_refuses_negative_parts(spark):
    bad = spark.range(1).select(*probs.normalised([F.lit(-0.5), F.lit(1.0)]))
    with pytest.raises(Exception, match="not a probability vector"):
        bad.collect()


def test_blend_renormalises_missing_signals(spark):
    s = spark.createDataFrame([(1, "a", 0.6, 0.2, 0.2), (1, "b", 0.2, 0.2, 0.6), (2, "a", 0.6, 0.2, 0.2), (3, "c", 1.0, 0.0, 0.0)], "match_id int, signal string, p0 double, p1 double, p2 double")
    w = blend.weights_table(spark, {"v": {"a": 0.75, "b": 0.25}})
    made = {r.match_id: r for r in blend.blend(s, w).collect()}
    assert set(made) == {1, 2}
    assert made[1].p0 == pytest.approx(0.5) and made[2].p0 == pytest.approx(0.6) and made[2].missing == ["b"]
    worst = {r.match_id: r.max_disagreement for r in blend.disagreement(s).collect()}
    assert worst == pytest.approx({1: 0.4, 2: 0.0, 3: 0.0})


def test_tuning_does_not_raise_the_loss(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for k in range(150):
        y = rnd.randint(0, 2)
        labels.append((k, y))
        good = [0.2, 0.2, 0.2]
        good[y] = 0.6
        rows += [(k, "good", *good), (k, "bad", 0.4, 0.3, 0.3)]
    s = spark.createDataFrame(rows, "match_id int, signal string, p0 double, p1 double, p2 double")
    w = blend.tune_weights(s, spark.createDataFrame(labels, "match_id int, label int"), ["good", "bad"], 15)
    assert w["good"] > 0.9 and sum(w.values()) == pytest.approx(1)


def test_standings_use_head_to_head_then_lots(spark):
    games = [("a", "b", 1, 0), ("a", "c", 0, 1), ("a", "d", 2, 0), ("b", "c", 2, 1), ("b", "d", 0, 0), ("c", "d", 0, 2)]
    rows = [(0, i, "G", h, a, x, y) for i, (h, a, x, y) in enumerate(games)]
    df = spark.createDataFrame(rows, "sim int, fixture_id int, grp string, home string, away string, home_goals int, away_goals int")
    order = [r.team for r in simulate.standings(df, "s").orderBy("position").collect()]
    assert order[0] == "a" and sorted(order) == list("abcd")
    tied = [("a", "b", 1, 0), ("c", "d", 1, 0), ("a", "c", 0, 1), ("b", "d", 0, 1), ("a", "d", 1, 0), ("b", "c", 1, 0)]
    rows = [(0, i, "G", h, a, x, y) for i, (h, a, x, y) in enumerate(tied)]
    made = simulate.standings(spark.createDataFrame(rows, df.schema), "s")
    first = {r.team: r.position for r in made.collect()}
    # a and c have six points and the same goals: c won their game. b and d have three: d won theirs.
    assert (first["c"], first["a"], first["d"], first["b"]) == (1, 2, 3, 4)


def test_bracket_walk_invariants(spark):
    teams = [f"t{i:02d}" for i in range(8)]
    first = spark.createDataFrame([(s, m, teams[m], teams[7 - m]) for s in range(50) for m in range(4)], "sim int, match long, home string, away string")
    pairs = spark.createDataFrame([(a, b, 1.2, 1.0, 0.7 if a < b else 0.3) for a in teams for b in teams if a != b], "home string, away string, home_rate double, away_rate double, advance_home double")
    ways = simulate.pair_resolution(pairs)
    for r in ways.collect():
        assert r.reg_home + r.et_home + r.pen_home == pytest.approx(r.advance_home)
    table = simulate.advancement(simulate.walk_bracket(first, ways, 3, "s"), 50, 3)
    sums = table.agg(*[F.sum(c) for c in ("p_round_1", "p_round_2", "p_round_3", "p_champion")]).first()
    assert list(sums) == pytest.approx([8, 4, 2, 1])


def test_draws_are_uniform_and_repeatable(spark):
    u = spark.range(4000).select(hash_uniform(F.lit("s"), F.col("id").cast("string")).alias("u"))
    got = u.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert got[0] == pytest.approx(0.5, abs=0.02) and 0 <= got[1] and got[2] < 1
    assert u.collect() == u.collect()


def test_squad_scores_shrink_and_fall_back(spark):
    rnd = random.Random(2)
    activity, values = [], []
    for t in range(6):
        for p in range(26):
            covered = t > 0 or p < 4
            place = ("goalkeeper", "defender", "midfielder", "forward")[p % 4]
            m = [float(rnd.randint(0, 900)) if covered else None for _ in range(4)]
            activity.append((f"T{t}", t * 100 + p, place, covered, covered, *m, *m, float(rnd.randint(1, 90)) if covered else None))
            values.append((f"T{t}", t * 100 + p, float(rnd.randint(1, 50)) if covered else None, float(rnd.randint(1, 500)) if covered else None))
    cols = ", ".join(f"minutes_{d}d double" for d in (30, 90, 180, 365)) + ", " + ", ".join(f"starts_{d}d double" for d in (30, 90, 180, 365))
    a = spark.createDataFrame(activity, f"team string, player_id int, position string, local boolean, identified boolean, {cols}, days_since_last double")
    v = spark.createDataFrame(values, "team string, player_id int, value double, age_days double")
    made = squads.score_teams(squads.team_features(a, v), {"activity": 1.0, "starts": 1.0, "valuation": 1.0, "positional": 1.0, "goalkeeper": 1.0, "depth": 1.0}, {"identity_coverage": 0.8, "local_activity_coverage": 0.8, "valuation_coverage": 0.8, "goalkeeper_local_coverage": 0.3, "minimum_position_local_coverage": 0.3})
    rows = {r.team: r for r in made.collect()}
    assert rows["T0"].fallback_used and rows["T0"].log_goal_adjustment == 0
    assert all(abs(r.log_goal_adjustment) <= 0.10 for r in rows.values()) and not rows["T1"].fallback_used


def test_bootstrap_interval_holds_the_mean(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(y, rnd.gauss(1, 0.3)) for y in range(12) for _ in range(30)], "year int, x double")
    got = metrics.block_bootstrap(df, F.col("x"), "year", resamples=300).first()
    assert got.ci_low < got.point < got.ci_high and got.blocks == 12


def test_confirmed_results_override_the_walk(spark):
    first = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "match long, team_a string, team_b string")
    chances = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.8), ("b", "c", 0.4)], "a string, b string, p double")
    known = spark.createDataFrame([(1, 0, "b")], "round int, match long, winner string")
    last = overlay.walk(first, chances, known, 2).where("round = 2").first()
    assert (last.team_a, last.team_b, last.winner) == ("b", "c", "c")


def test_bracket_problems(spark):
    rows = spark.createDataFrame([(73, "1A", "2B"), (74, "W73", "THIRD"), (75, "W99", "??")], "match int, slot_1 string, slot_2 string")
    found = {(r.match, r.problem) for r in graph.bracket_problems(rows, 73, 76).collect()}
    assert found == {(76, "number"), (75, "slot"), (75, "order")}


def test_names(spark):
    row = spark.createDataFrame([("Müller, José  Luis", "  Côte d'Ivoire ", "Atlético F.C. Madrid FC")], "a string, b string, c string")
    got = row.select(text.person_key(F.col("a")), text.plain_key(F.col("b")), text.folded_key(F.lit("Straße")), text.club_key(F.col("c")), text.token_key(F.lit("B A"))).first()
    assert list(got) == ["jose luis muller", "cote d'ivoire", "strasse", "atletico f c madrid", "a b"]


def test_cells(spark):
    rows = spark.createDataFrame([("00",), ("-1",), ("NA",), ("bad",), (" 3 ",), ("3.0",)], "c string")
    got = [tuple(r) for r in rows.select(parse.score_value(F.col("c")), parse.score_missing(F.col("c")), parse.score_bad(F.col("c"))).collect()]
    assert got == [(0, False, False), (None, False, True), (None, True, False), (None, False, True), (3, False, False), (None, False, True)]


def test_required_columns(spark):
    with pytest.raises(SchemaError, match="b"):
        require_columns(spark.range(1), ["id", "b"], "t")
    assert issubclass(DataError, ValueError)


def test_completed_overlay_is_fixed_exactly_once(spark):
    fixtures = spark.createDataFrame([(1, True, 2, 1), (2, True, 0, 0), (2, True, 0, 0), (3, False, 1, 1), (4, True, 1, 0), (6, True, 3, 3), (6, False, 3, 3), (7, True, 1, 1), (8, False, None, None), (9, True, None, 0)], "fixture_id long, played boolean, home_goals int, away_goals int")
    results = lambda *rows: spark.createDataFrame(list(rows), "fixture_id long, regulation_home_goals int, regulation_away_goals int")
    found = simulate.completed_problems(fixtures, results((1, 2, 1), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, 0, 0), (6, 3, 3), (7, 1, 1), (7, 1, 1), (9, 0, 0)))
    assert {r.fixture_id: r.problems for r in found.collect()} == {2: "repeated", 3: "missing;not_fixed", 4: "goals_differ", 5: "missing", 6: "not_fixed", 7: "given_twice", 9: "goals_differ"}
    assert [r.fixture_id for r in simulate.validate_completed(fixtures, results((1, 2, 1))).collect()] == [1]
    with pytest.raises(DataError):
        simulate.validate_completed(fixtures, results((1, 2, 1), (4, 0, 1)))


def test_corrected_outcomes_are_those_of_the_whole_matrix(spark):
    from fixtura.functions.probs import period_outcomes
    from fixtura.operators import backtest

    rates, rho = [(1.4, 0.9), (0.3, 2.2), (1.0, 1.0)], -0.08
    rows = spark.createDataFrame(rates, "lh double, la double").withColumn("made", period_outcomes(F.col("lh"), F.col("la")))
    p = backtest.low_scores_corrected(F.col("made"), F.col("lh"), F.col("la"), rho)
    got = {(r.lh, r.la): (r.p0, r.p1, r.p2) for r in rows.select("lh", "la", *[c.alias(f"p{k}") for k, c in enumerate(p)]).collect()}
    for lh, la in rates:
        tau = {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): 1 - rho}
        cells = {(h, a): math.exp(-lh - la) * lh**h * la**a / math.factorial(h) / math.factorial(a) * tau.get((h, a), 1) for h in range(31) for a in range(31)}
        total = sum(cells.values())
        sides = [sum(v for (h, a), v in cells.items() if test(h, a)) / total for test in (lambda h, a: h > a, lambda h, a: h == a, lambda h, a: h < a)]
        assert got[lh, la] == pytest.approx(sides, abs=1e-9)


def test_folds_of_every_possible_year(spark):
    from fixtura.operators import backtest

    years = {2001: 60, 2002: 10, 2003: 10, 2004: 40, 2005: 60, 2006: 49, 2007: 50}
    rows = spark.createDataFrame([(y,) for y, n in years.items() for _ in range(n)], "year int").selectExpr("make_date(year, 7, 1) AS date")
    assert backtest.possible_years(rows) == [2005, 2007]
    assert backtest.possible_years(rows.limit(0)) == []


def test_whole_score_matrices_are_searched_in_time(spark):
    """20,000 matrices take seconds: no sum over the matrix is made again for each of its cells."""
    rates = spark.range(20_000).select("id", (0.05 + F.col("id") % 397 / 40).alias("lh"), (0.05 + F.col("id") % 211 / 30).alias("la")).repartition(4)
    began = time.monotonic()
    got = {r["id"]: r["scores"] for r in models.likely_scores(rates, F.col("lh"), F.col("la"), ["id"], 3).collect()}
    assert time.monotonic() - began < 40
    assert len(got) == 20_000
    for k in range(0, 20_000, 997):
        lh, la = 0.05 + k % 397 / 40, 0.05 + k % 211 / 30
        x, y = ([math.exp(-r + g * math.log(r) - math.lgamma(g + 1)) for g in range(13)] for r in (lh, la))
        cells = sorted((-round(p * q / (sum(x) * sum(y)), 9), h, a) for h, p in enumerate(x) for a, q in enumerate(y))[:3]
        assert [(s["h"], s["a"]) for s in got[k]] == [c[1:] for c in cells]
        assert [s["p"] for s in got[k]] == pytest.approx([-c[0] for c in cells], abs=1e-8)


def test_odd_rates_have_their_first_cells(spark):
    """Next to no goals: all cells but one are equal to nine places, so the lower scores follow; no rate: no p."""
    rates = spark.createDataFrame([(0, 1e-12, 1e-12), (1, None, 1.0), (2, 2.0, 2.0)], "id int, lh double, la double")
    got = {r["id"]: [tuple(s) for s in r["scores"]] for r in models.likely_scores(rates, F.col("lh"), F.col("la"), ["id"], 3).collect()}
    assert [s[:2] for s in got[0]] == [(0, 0), (0, 1), (0, 2)]
    assert got[1] == [(0, 0, None), (0, 1, None), (0, 2, None)]
    assert [s[:2] for s in got[2]] == [(1, 1), (1, 2), (2, 1)]


def test_periods_are_summed_in_arrays(spark):
    """No fold of 41 steps runs in each row, and none is planned twice where its result is filtered and split."""
    rates = spark.createDataFrame([(1.4, 1.0), (None, 1.0), (0.0, 2.0)], "a double, b double").withColumn("made", probs.period_outcomes(F.col("a"), F.col("b")))
    plan = rates._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "Python" in plan
    got = [r.made for r in rates.collect()]
    direct = [sum(poisson(h, 1.4) * poisson(a, 1.0) for h in range(30) for a in range(30) if (h < a) - (h > a) == side) for side in (-1, 0, 1)]
    assert tuple(got[0]) == pytest.approx(direct, abs=1e-9) and tuple(got[1]) == (None, None, None)
    assert tuple(got[2]) == pytest.approx([0, math.exp(-2), 1 - math.exp(-2)], abs=1e-12)


def test_a_fold_reads_equal_rows_once(spark):
    """Tallied rows give each fit and score what all rows give."""
    from fixtura.operators import backtest

    rnd = random.Random(5)
    rows = [(f"{rnd.choice((1999, 2000))}-{rnd.randint(1, 12):02d}-03", rnd.randint(0, 2), float(rnd.choice((-100, 0, 150))), float(rnd.randint(0, 1)), rnd.randint(0, 3), rnd.randint(0, 3)) for _ in range(4000)]
    df = backtest.with_features(spark.createDataFrame(rows, "date string, label int, elo_diff double, home_adv double, home_score int, away_score int").withColumn("date", F.col("date").cast("date")))
    few = backtest.tallied(df).cache()
    assert few.count() < 1000 and few.agg(F.sum("copies")).first()[0] == 4000
    assert backtest.possible_years(few, val_years=0) == backtest.possible_years(df, val_years=0)
    assert models.fit_davidson(few, F.col("elo_diff"), "copies") == pytest.approx(models.fit_davidson(df, F.col("elo_diff")), abs=1e-6)
    assert np.array(models.fit_logistic(few, ["d", "home_adv"], weight="copies")) == pytest.approx(np.array(models.fit_logistic(df, ["d", "home_adv"])), abs=1e-7)
    assert models.fit_poisson(models.poisson_rows(few, "copies"), weight="copies") == pytest.approx(models.fit_poisson(models.poisson_rows(df)), abs=1e-7)
    scores = lambda d, w: [tuple(r) for r in metrics.summary(models.uniform(d), (), w).collect()]
    assert scores(few, "copies")[0] == pytest.approx(scores(df, None)[0])


def test_elo_in_stretches_is_the_same_fold(spark):
    df, rows = matches(spark)
    expected, _ = plain_elo(rows)
    got = {r.match_id: (r.home_elo_pre, r.away_elo_pre, r.delta) for r in ratings.elo_timeline(df, stretch=25).collect()}
    assert set(got) == set(expected) and len(got) == len(rows)
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_versions_are_scored_on_signals_gathered_once(spark):
    signals_ = spark.createDataFrame([(m, s, 0.5, 0.3, 0.2) for m in range(4) for s in ("historical", "market")], "match_id long, signal string, p0 double, p1 double, p2 double")
    labels = spark.createDataFrame([(m, m % 3) for m in range(4)], "match_id long, label int")
    made = blend.score_versions(signals_, labels, blend.weights_table(spark, {"both": {"historical": 0.5, "market": 0.5}}))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    row = made.first()
    assert (row.n_scored, row.mean_signals_used, row.high_disagreement_count) == (4, 2.0, 0)


def plain_matrix(lh, la, rho):
    """A score matrix of 13 by 13 in plain Python, corrected and normalised, and its mass before."""
    pmf = lambda k, r: math.exp(-r + k * math.log(r) - math.lgamma(k + 1))
    raw = {(h, a): pmf(h, lh) * pmf(a, la) for h in range(13) for a in range(13)}
    tau = {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): 1 - rho}
    made = {c: p * tau.get(c, 1.0) for c, p in raw.items()}
    return {c: p / sum(made.values()) for c, p in made.items()}, sum(raw.values())


def test_a_payload_is_whole(spark):
    """Five scorelines and every market of the corrected matrix, the fixture, and what the forecast was made with."""
    from test_queries import DATA, QUERIES

    from fixtura.plans.views import Tables

    t = Tables(spark, DATA)
    bases = {r.k: r for r in t("v_fixture_preds").collect()}
    got = {r.k: json.loads(r.payload) for r in QUERIES["LEDG-06"](spark, DATA).collect()}
    assert got.keys() == bases.keys()
    last = t("v_matches").where("status = 'played'").agg(F.max("date")).first()[0]
    for k in sorted(got)[::150]:
        row, made = bases[k], got[k]
        rates = [math.exp(0.6 + side * 0.4 * row.elo_diff / 400) for side in (1, -1)]
        matrix, _ = plain_matrix(*rates, -0.05)
        total = lambda test: round(sum(p for (h, a), p in matrix.items() if test(h, a)), 4)  # noqa: E731, B023
        best = sorted(matrix, key=lambda c: (-round(matrix[c], 9), c))[:5]  # noqa: B023
        assert [(s["home"], s["away"]) for s in made["top_scorelines"]] == best
        assert [s["p"] for s in made["top_scorelines"]] == pytest.approx([matrix[c] for c in best], abs=6e-5)
        markets = {f"over_{n}_5": total(lambda h, a: h + a > n) for n in range(4)} | {"under_2_5": total(lambda h, a: h + a < 3), "both_teams_score": total(lambda h, a: h > 0 and a > 0), "home_clean_sheet": total(lambda h, a: a == 0), "away_clean_sheet": total(lambda h, a: h == 0)}  # noqa: B023
        assert made["markets"] == pytest.approx(markets, abs=1.1e-4)
        assert [made["home_expected_goals"], made["away_expected_goals"]] == pytest.approx(rates, abs=6e-5)
        assert [made[f"{c}_probability"] for c in ("home_win", "draw", "away_win")] == pytest.approx([row.p0, row.p1, row.p2], abs=6e-5)
        assert (made["fixture_id"], made["home_team"], made["away_team"], made["tournament"], made["kickoff_timestamp"]) == (k, row.home_team, row.away_team, row.tournament, str(row.date))
        assert (made["data_cutoff"], made["dataset_version"], made["model_version"]) == (str(last + timedelta(days=1)), "d1", "m1")
        assert made["kickoff_time_known"] is False and len(made["limitations"]) == 2 and list(made) == sorted(made)


def test_matrices_give_what_is_asked_of_them(spark):
    rates = spark.createDataFrame([(0, 1.4, 0.9, 1, 1), (1, 18.0, 0.05, 13, 0), (2, None, 1.0, 0, 0), (3, 1.0, 1.0, None, 0)], "id int, lh double, la double, h int, a int")
    got = {r.id: r for r in models.likely_scores(rates, F.col("lh"), F.col("la"), ["id"], 5, rho=0.1, actual=("h", "a"), markets=True).collect()}
    matrix, mass = plain_matrix(1.4, 0.9, 0.1)
    assert got[0].p_actual == pytest.approx(matrix[1, 1], abs=1e-12) and got[0].tail_mass == pytest.approx(1 - mass, abs=1e-12)
    assert sum(p for (h, a), p in matrix.items() if h + a > 2) == pytest.approx(got[0].markets.over_2_5, abs=1e-12)
    assert got[1].p_actual is None and got[1].tail_mass > 0.8 and got[3].p_actual is None
    assert (got[2].p_actual, got[2].tail_mass, got[2].markets.over_0_5) == (None, None, None)


def test_payloads_keep_nulls_and_revisions(spark):
    from fixtura.operators import feedback

    df = spark.createDataFrame([(1, None, 1.23456, [(2, 1, 0.123456)])], "k int, p double, rate double, lines array<struct<home:int,away:int,p:double>>")
    match = {c: F.lit("x") for c in ("home_team", "away_team", "tournament")} | {"date": F.lit("2026-06-11").cast("date")}
    model = {"data_cutoff": F.lit("2026-06-01").cast("date"), "dataset_version": F.lit("d"), "model_version": F.lit("m")}
    body = feedback.payload(F.col("k"), match, ["p"] * 3, ["rate"] * 2, "lines", {"b": F.lit(0.55555), "a": F.lit(0.1)}, model, {"model_version": F.lit("m+r1"), "revision": F.lit(1)})
    made = json.loads(df.select(body.alias("x")).first().x)
    assert made["draw_probability"] is None and (made["model_version"], made["revision"]) == ("m+r1", 1)
    assert made["markets"] == {"a": 0.1, "b": 0.5556} and made["home_expected_goals"] == 1.2346
    assert made["top_scorelines"] == [{"away": 1, "home": 2, "p": 0.1235}] and made["kickoff_timestamp"] == "2026-06-11"


def test_a_missing_chance_is_rebuilt_or_refused(spark):
    """The chance of any score of the matrix, stored or not, if the model gives again all that was stored."""
    from fixtura.operators import feedback

    beta, rho, elo = [0.2, 0.5, 0.3], -0.08, 120.0
    rates = [math.exp(0.2 + 0.5 * elo / 400 + 0.3), math.exp(0.2 - 0.5 * elo / 400)]
    matrix, _ = plain_matrix(*rates, rho)
    best = sorted(matrix, key=lambda c: -matrix[c])[:5]
    lines = [(h, a, round(matrix[h, a], 4)) for h, a in best]
    moved = [(*lines[0][:2], lines[0][2] + 0.0001), *lines[1:]]
    h, a = (round(r, 4) for r in rates)
    rows = [(0, h, a, lines, 7, 5), (1, h, a, lines, *best[0]), (2, h + 0.0001, a, lines, 1, 0), (3, h, None, lines, 1, 0), (4, h, a, moved, 1, 0), (5, h, a, lines[:3], 1, 0), (6, h, a, None, 1, 0), (7, h, a, [lines[1], lines[0], *lines[2:]], 1, 0), (8, h, a, lines, 13, 0), (9, h, a, lines, 12, 12)]
    df = spark.createDataFrame(rows, "id int, home_rate double, away_rate double, scorelines array<struct<home:int,away:int,p:double>>, home_goals int, away_goals int").withColumns({"elo_diff": F.lit(elo), "home_adv": F.lit(1.0)})
    got = {r.id: (r.reconstruction, r.probability) for r in feedback.reconstructed(df, beta, rho).collect()}
    for k, cell in ((0, (7, 5)), (1, best[0]), (9, (12, 12))):
        assert got[k] == ("validated_reconstruction", pytest.approx(matrix[cell], rel=1e-9))
    assert [got[k] for k in range(2, 9)] == [(w, None) for w in ("rates_differ", "rates_differ", *["scorelines_differ"] * 4, "outside_grid")]


def test_a_mixture_is_minimal_at_an_edge_too(spark):
    """Also where members are much alike, and with rows that stand for several."""
    rnd = random.Random(11)
    rows = [(a := rnd.uniform(0.2, 0.6), a * rnd.uniform(0.9, 1.1), a * rnd.uniform(0.85, 1.05), rnd.randint(1, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, n int")
    got = models.minimal_mixture(df, ["a", "b", "c"], weight="n")
    p, n = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    slope = (p / (p @ got)[:, None] * n[:, None]).sum(0) / n.sum()  # 1 where a weight is, at most 1 elsewhere
    assert sum(got) == pytest.approx(1) and min(got) == 0.0
    assert all(s == pytest.approx(1, abs=1e-6) if w else s <= 1 + 1e-6 for s, w in zip(slope, got, strict=True))
    assert models.minimal_mixture(df, ["a"], weight="n") == [1.0] and models.minimal_mixture(df.limit(0), ["a", "b"]) == [0.5, 0.5]
    assert sum(models.minimal_mixture(df.withColumn("d", F.col("a")), ["a", "d"])) == pytest.approx(1)


def test_groups_are_resampled_as_if_alone(spark):
    rnd = random.Random(2)
    rows = [(m, year, rnd.random(), rnd.randint(1, 4)) for m in "ab" for year in range(2000, 2006) for _ in range(20)]
    df = spark.createDataFrame(rows, "model string, year int, x double, n int")
    got = {r.model: tuple(r)[1:] for r in metrics.block_bootstrap(df, F.col("x"), "year", by=("model",), weight="n").collect()}
    every = df.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n"))))
    for m in "ab":
        assert got[m] == pytest.approx(tuple(metrics.block_bootstrap(every.where(F.col("model") == m), F.col("x"), "year").first()))


def test_a_backtest_is_whole(spark):
    """Home advantage in the rating model, goals learnt and judged on strict rows of the cut matrix, intervals, kinds of
    competition, and what was fitted."""
    from fixtura.operators import backtest

    rnd = random.Random(7)
    cups = ("FIFA World Cup", "FIFA World Cup qualification", "Friendly", "Cup")
    rows = []
    for year in (2000, 2001, 2002, 2003):
        for k in range(60 if year < 2003 else 90):
            elo, home = float(rnd.choice((-200, -50, 0, 100, 300))), float(k % 3 > 0)
            goals = [sum(rnd.random() < min(0.9, math.exp(side * elo / 400 + 0.1 * home) * 0.15) for _ in range(10)) for side in (1, -1)]
            rows.append((f"{year}-0{1 + k % 9}-02", cups[k % 4], elo, home, goals[0] + 6 * (k % 10 == 0), goals[1], k % 10 > 0))
    df = spark.createDataFrame(rows, "date string, tournament string, elo_diff double, home_adv double, home_score int, away_score int, strict boolean")
    df = df.withColumn("date", F.col("date").cast("date")).withColumn("label", F.expr("CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END"))
    unlabelled = df.limit(5).withColumn("label", F.lit(-1))
    got = {(r.fold, r.model, r.competition): r for r in backtest.run_backtest(df.unionByName(unlabelled), [2003], val_years=2).collect()}
    names = {"uniform", "frequency", "context", "higher_rated", "ensemble", *backtest.CALIBRATED, *[f"{m}_calibrated" for m in backtest.CALIBRATED]}
    assert set(got) == {(f, m, "all") for f in (0, 2003) for m in names} | {(0, "ensemble", c) for c in ("world_cup", "qualification", "friendly", "other")}
    assert sum(r.n for (_, m, c), r in got.items() if c != "all") == got[0, "ensemble", "all"].n == 90
    assert all(got[0, m, "all"].ci_low == pytest.approx(got[0, m, "all"].log_loss) for m in names)  # one block

    of = lambda years, every=True: [r for r in rows if int(r[0][:4]) in years and (every or r[6])]
    label = lambda r: 0 if r[4] > r[5] else 1 if r[4] == r[5] else 2

    def davidson(r, nu):
        q = 10 ** ((r[2] + 60 * r[3]) / 800)
        return [x / (q + 1 / q + nu) for x in (q, nu, 1 / q)]

    loss = lambda nu, years: np.mean([-math.log(davidson(r, nu)[label(r)] + 1e-12) for r in of(years)])
    (nu,) = got[2003, "davidson", "all"].fitted
    assert nu == pytest.approx(min(np.linspace(0.01, 4.99, 2000), key=lambda x: loss(x, (2000,))), abs=5e-3)
    assert got[2003, "davidson", "all"].log_loss == pytest.approx(loss(nu, (2003,)), abs=1e-9)

    beta, (rho,) = got[2003, "poisson", "all"].fitted, got[2003, "dixon_coles", "all"].fitted
    rates = lambda r: (math.exp(beta[0] + beta[1] * r[2] / 400 + beta[2] * r[3]), math.exp(beta[0] - beta[1] * r[2] / 400))
    train = [(r, *rates(r)) for r in of((2000,), every=False)]
    slopes = [sum(r[4] - h + r[5] - a for r, h, a in train), sum((r[4] - h - r[5] + a) * r[2] / 400 for r, h, a in train), sum((r[4] - h) * r[3] for r, h, a in train)]
    assert slopes == pytest.approx([0, 0, 0], abs=1e-5)
    for model, low in (("poisson", 0.0), ("dixon_coles", rho)):
        row, strict = got[2003, model, "all"], [(r, plain_matrix(*rates(r), low)[0]) for r in of((2003,), every=False)]
        best = [sorted(m, key=lambda c: (-round(m[c], 9), c))[:3] for _, m in strict]  # noqa: B023
        assert row.goal_n == len(strict) == 81
        assert row.scoreline_nll == pytest.approx(np.mean([-math.log(max(m.get(r[4:6], 0), 1e-12)) for r, m in strict]), abs=1e-9)
        assert row.total_goal_mae == pytest.approx(np.mean([abs(sum(rates(r)) - r[4] - r[5]) for r, _ in strict]), abs=1e-9)
        assert row.top1_scoreline == pytest.approx(np.mean([r[4:6] == b[0] for (r, _), b in zip(strict, best, strict=True)]))
        assert row.top3_scoreline == pytest.approx(np.mean([r[4:6] in b for (r, _), b in zip(strict, best, strict=True)]))
        wins = [[sum(p for (h, a), p in plain_matrix(*rates(r), low)[0].items() if (h < a) - (h > a) + 1 == k) for k in range(3)] for r in of((2003,))]
        assert row.log_loss == pytest.approx(np.mean([-math.log(p[label(r)] + 1e-12) for r, p in zip(of((2003,)), wins, strict=True)]), abs=1e-9)
        assert got[0, model, "all"].scoreline_nll == pytest.approx(row.scoreline_nll)
