"""Expanding-window evaluation: every model sees only rows before the years it is judged on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.probs import normalised, period_outcomes
from fixtura.operators import metrics, models, ratings
from fixtura.shared import settle

LEAST_ROWS = 50
FEATURES = ["d", "ad", "home_adv"]
#: Models whose probabilities get a temperature, and those that the ensemble mixes.
CALIBRATED = ("davidson", "poisson", "dixon_coles", "logistic")
MIXED = ("davidson", "dixon_coles", "logistic")
#: Models of goals, and the most goals of a side in their score matrices.
GOAL_MODELS = ("poisson", "dixon_coles")
MOST_GOALS = 12


#: What a fold reads of a row besides its date; strict says whether its score is known to be that of 90 minutes.
READ = ("label", "elo_diff", "home_adv", "home_score", "away_score", "d", "ad", "strict")


def competition(tournament: Column) -> Column:
    """The kind of competition that the ensemble is judged by."""
    name = F.lower(tournament)
    return F.when(name == "fifa world cup", "world_cup").when(name.contains("qualif"), "qualification").when(name == "friendly", "friendly").otherwise("other")


def tallied(rows: DataFrame, date: str = "date") -> DataFrame:
    """Rows that a fold can't tell apart as one row with their number, `copies`: folds are cut at the turn of years, so
    its date is the first of its year. Fits and scores weigh rows by copies, so their results are those of all rows.
    Rows without a label are in none; all scores are strict, and all competitions alike, if no column says otherwise."""
    if "copies" in rows.columns:
        return rows
    strict = F.coalesce(F.col("strict"), F.lit(False)) if "strict" in rows.columns else F.lit(True)
    kind = competition(F.col("tournament") if "tournament" in rows.columns else F.lit(None).cast("string"))
    known = rows.where("label >= 0").withColumns({"strict": strict, "competition": kind})
    counted = known.groupBy(F.year(date).alias("year_"), *READ, "competition").agg(F.count("*").alias("copies"))
    return counted.withColumn(date, F.make_date("year_", F.lit(1), F.lit(1))).drop("year_")


def low_scores_corrected(made: Column, lh: Column, la: Column, rho: float) -> list[Column]:
    """Win, draw and loss of independent goals with the four low scores corrected: only these cells change."""
    none = F.exp(-lh - la)
    more = lambda h, a, p: p * (models.low_score_factor(F.lit(h), F.lit(a), lh, la, F.lit(rho)) - 1)
    return normalised([made["win"] + more(1, 0, none * lh), made["draw"] + more(0, 0, none) + more(1, 1, none * lh * la), made["loss"] + more(0, 1, none * la)])


def shares_by(train: DataFrame, key: Column, values: Sequence[int]) -> list[Column]:
    """Train's shares of the labels where key has each of a few fixed values; those of a value never seen are equal."""
    found = {r["key"]: r for r in models.class_frequencies(train.withColumn("key", key), ["key"], "copies").where(F.col("key").isin(*values)).collect()}
    out = []
    for k in range(3):
        share = F.lit(1 / 3)
        for v, r in found.items():
            share = F.when(key == v, F.lit(float(r[f"p{k}"]))).otherwise(share)
        out.append(share)
    return out


def with_members(train: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[str], dict[str, list[float]]]:
    """rows with columns <model>_0 to <model>_2 of every model fitted on train (tallied) and with the rates of the goal
    models, which learn from strict rows only; the models' names; and what each has fitted."""
    advantage = F.col("elo_diff") + ratings.EloSettings().home_advantage * F.col("home_adv")
    nu = models.fit_davidson(train, advantage, "copies")
    weights = models.fit_logistic(train, FEATURES, weight="copies")
    counts = models.class_frequencies(train, weight="copies").first()
    beta = models.fit_poisson(models.poisson_rows(train, "copies"), weight="copies")
    rates = dict(zip(("rate_home", "rate_away"), models.expected_goals(beta, F.col("elo_diff"), F.col("home_adv")), strict=True))
    rho = models.fit_rho(settle(train.where("strict").select("copies", "home_score", "away_score", *[c.alias(n) for n, c in rates.items()]), "rates"), "rate_home", "rate_away", weight="copies")
    lh, la, made = F.col("rate_home"), F.col("rate_away"), F.col("period")
    cells = {
        "uniform": [F.lit(1 / 3)] * 3,
        "frequency": [F.lit(float(counts[f"p{k}"])) for k in range(3)],
        "context": shares_by(train, (F.col("home_adv") > 0).cast("int"), (0, 1)),
        "higher_rated": shares_by(train, F.signum("elo_diff").cast("int"), (-1, 0, 1)),
        "davidson": models.davidson(advantage, F.lit(nu)),
        "poisson": normalised([made["win"], made["draw"], made["loss"]]),
        "dixon_coles": low_scores_corrected(made, lh, la, rho),
        "logistic": models.logistic_probabilities(weights, FEATURES),
    }
    rows = settle(rows.withColumns(rates).withColumn("period", period_outcomes(lh, la, MOST_GOALS)), "periods")
    fitted = {"davidson": [nu], "poisson": beta, "dixon_coles": [rho], "logistic": [w for row in weights for w in row]}
    return rows.withColumns({f"{m}_{k}": p[k] for m, p in cells.items() for k in range(3)}), list(cells), fitted


def goal_scores(test: DataFrame, year: int, rho: float) -> DataFrame:
    """Per goal model, over the strict rows of test (tallied, with rates): mean log loss of the score, mean errors of the
    rates, and how often the score was the likeliest or among three."""
    h, a, lh, la = (F.col(c) for c in ("home_score", "away_score", "rate_home", "rate_away"))
    keys = ["copies", "home_score", "away_score", "rate_home", "rate_away"]
    is_score = lambda s: (s["h"] == h) & (s["a"] == a)
    cells = {
        "scoreline_nll": -F.log(F.greatest(F.coalesce("p_actual", F.lit(0.0)), F.lit(1e-12))),
        "home_goal_mae": F.abs(lh - h),
        "away_goal_mae": F.abs(la - a),
        "total_goal_mae": F.abs(lh + la - h - a),
        "top1_scoreline": is_score(F.get("scores", F.lit(0))).cast("double"),
        "top3_scoreline": F.exists("scores", is_score).cast("double"),
    }
    out = []
    for model, low in zip(GOAL_MODELS, (0.0, rho), strict=True):
        made = models.likely_scores(test.where("strict"), lh, la, keys, 3, MOST_GOALS, low, ("home_score", "away_score"))
        means = made.agg(F.sum("copies").cast("double").alias("goal_n"), *[models.mean_of(c, "copies").alias(n) for n, c in cells.items()])
        out.append(means.where("goal_n > 0").select(F.lit(year).alias("fold"), F.lit(model).alias("model"), "*"))
    return out[0].unionByName(out[1])


@dataclass(frozen=True)
class Fold:
    """forecasts: the test rows in long form, tallied: fold, model, p0..p2, label, competition, copies. goals: scores of
    the goal models. fitted: what each model, calibrated one and ensemble has learnt."""

    year: int
    forecasts: DataFrame
    goals: DataFrame
    fitted: dict[str, list[float]]


def run_fold(rows: DataFrame, date: str, year: int, val_years: int = 3) -> Fold:
    """One fold: fitted before validation, calibrated and mixed on it, judged on its own year."""
    parts = models.with_folds(tallied(rows, date), date, [year], val_years)
    kind = F.when(F.col("part") == "test", F.col("competition")).alias("competition")  # only test rows are told apart by it
    parts = settle(parts.groupBy("part", *READ, kind).agg(F.sum("copies").alias("copies")), "fold")
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum("copies").alias("n")).collect()}  # three rows
    if any(sizes.get(p, 0) < LEAST_ROWS for p in ("train", "validation", "test")):
        raise ValueError(f"fold {year} has too few rows: {sizes}")
    judged, names, fitted = with_members(parts.where("part = 'train'"), parts.where("part <> 'train'"))
    goals = goal_scores(judged.where("part = 'test'"), year, fitted["dixon_coles"][0])
    judged = settle(judged.select("part", "label", "competition", "copies", *[f"{m}_{k}" for m in names for k in range(3)]), "members")
    cells = {}
    for m in CALIBRATED:
        own = [f"{m}_{k}" for k in range(3)]
        heat = models.fit_temperature(judged.where("part = 'validation'"), own, "copies")
        fitted[f"{m}_calibrated"] = [heat]
        cells |= {f"{m}_calibrated_{k}": p for k, p in enumerate(models.tempered([F.col(c) for c in own], F.lit(heat)))}
    judged = settle(judged.withColumns(cells), "calibrated")
    validation, test = judged.where("part = 'validation'"), judged.where("part = 'test'")
    forms = {m: [F.col(f"{m}_{k}") for k in range(3)] for m in [*names, *[f"{m}_calibrated" for m in CALIBRATED]]}
    mixed = {m: forms[f"{m}_calibrated"] for m in MIXED}
    true = [F.when(F.col("label") == 0, p[0]).when(F.col("label") == 1, p[1]).otherwise(p[2]).alias(m) for m, p in mixed.items()]
    weights = models.minimal_mixture(validation.select("copies", *true), list(mixed), weight="copies")
    fitted["ensemble"] = weights
    forms["ensemble"] = normalised([sum((w * p[k] for w, p in zip(weights, mixed.values(), strict=True)), F.lit(0.0)) for k in range(3)])
    long = [F.struct(F.lit(m).alias("model"), *[p[k].alias(f"p{k}") for k in range(3)]) for m, p in forms.items()]
    made = test.select(F.lit(year).alias("fold"), "label", "competition", "copies", F.explode(F.array(*long)).alias("x"))
    return Fold(year, made.select("fold", "label", "competition", "copies", "x.*"), goals, fitted)


def possible_years(rows: DataFrame, date: str = "date", val_years: int = 3) -> list[int]:
    """The years whose fold has rows enough to fit, validate and test on."""
    n = F.sum("copies") if "copies" in rows.columns else F.count("*")
    sizes = {r["year"]: r["n"] for r in rows.groupBy(F.year(date).alias("year")).agg(n.alias("n")).collect() if r["year"] is not None}  # a row per year
    between = lambda first, end: sum(n for y, n in sizes.items() if first <= y < end)
    least = min(sizes, default=0)
    return [y for y in sorted(sizes) if min(between(least, y - val_years), between(y - val_years, y), sizes[y]) >= LEAST_ROWS]


def with_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"d": F.col("elo_diff") / 400, "ad": F.abs(F.col("elo_diff") / 400)})


def run_backtest(rows: DataFrame, years: Sequence[int], val_years: int = 3, date: str = "date") -> DataFrame:
    """Scores of every model per fold and pooled (fold 0) over the union of the folds' test rows, the pooled log loss with
    an interval over resampled years; of the ensemble per kind of competition too (else all); of the goal models' scores
    per fold, and pooled as means over the folds; and per fold what was fitted."""
    if not years:
        raise ValueError("no year has rows enough for a fold")
    rows = rows if "copies" in rows.columns else settle(tallied(with_features(rows), date), "tally")
    return pooled([run_fold(rows, date, y, val_years) for y in years])


def pooled(folds: Sequence[Fold]) -> DataFrame:
    """The scores of folds in one table, as run_backtest has them."""
    every = reduce(DataFrame.unionByName, [f.forecasts for f in folds])
    goals = reduce(DataFrame.unionByName, [f.goals for f in folds])
    of = lambda fold, kind: F.struct(fold.alias("fold"), kind.alias("competition"))
    none = F.lit(0)
    places = F.concat(F.array(of(F.col("fold"), F.lit("all")), of(none, F.lit("all"))), F.when(F.col("model") == "ensemble", F.array(of(none, F.col("competition")))).otherwise(F.array()))
    both = every.select("model", "label", "copies", *metrics.P, F.explode(places).alias("at")).select("*", "at.*").drop("at")
    scores = metrics.summary(both, ("fold", "model", "competition"), "copies")
    keys = ["fold", "model", "competition"]
    whole = lambda df: df.withColumn("competition", F.lit("all"))
    interval = metrics.block_bootstrap(every, metrics.log_loss(), "fold", by=("model",), weight="copies").select(none.alias("fold"), "model", "ci_low", "ci_high")
    measures = [c for c in goals.columns if c not in keys]
    goals = goals.unionByName(goals.groupBy("model").agg(*[F.avg(c).alias(c) for c in measures]).withColumn("fold", none))
    learnt = every.sparkSession.createDataFrame([(f.year, m, v) for f in folds for m, v in f.fitted.items()], "fold int, model string, fitted array<double>")
    for more in (interval, goals, learnt):  # a row per fold and model at most
        scores = scores.join(F.broadcast(whole(more)), keys, "left")
    return scores
