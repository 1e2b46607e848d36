"""Outcome and goal models, fitted by aggregates.

Each optimiser step is one aggregate over the rows (sufficient statistics, a gradient, or the losses of a grid of
candidates) and a solve of a few numbers on the driver. Inputs are written out once before a loop, so an
iteration reads columns and not a growing plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.shared import settle, small


def with_folds(df: DataFrame, date: str, years: Sequence[int], val_years: int = 3) -> DataFrame:
    """Every row once per fold it belongs to, with fold and part: train before the validation years, then those,
    then the fold's own year. Later rows are in no fold of that year."""
    first = lambda year: F.make_date(year, F.lit(1), F.lit(1))
    rows = df.withColumn("fold", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    part = F.when(F.col(date) < first(F.col("fold") - val_years), "train").when(F.col(date) < first(F.col("fold")), "validation").otherwise("test")
    return rows.where(F.col(date) < first(F.col("fold") + 1)).withColumn("part", part)


def mean_of(value: Column, weight: str | None = None) -> Column:
    """The mean of value; with a weight, a row counts as often as it says. Nulls count for nothing."""
    if weight is None:
        return F.avg(value)
    return F.try_divide(F.sum(value * F.col(weight)), F.sum(F.when(value.isNotNull(), F.col(weight))))


# Baselines.


def uniform(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(1 / 3) for c in ("p0", "p1", "p2")})


def class_frequencies(train: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Shares of the labels with one added to each class, per context."""
    seen = F.col(weight) if weight else F.lit(1)
    counts = train.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, seen)), F.lit(0)).alias(f"n{k}") for k in range(3)])
    total = F.col("n0") + F.col("n1") + F.col("n2") + 3
    return counts.select(*by, *[((F.col(f"n{k}") + 1) / total).alias(f"p{k}") for k in range(3)])


def by_context(test: DataFrame, frequencies: DataFrame, by: Sequence[str]) -> DataFrame:
    """test with the shares of its context; contexts are few, one row each."""
    return test.join(small(frequencies), list(by), "left") if by else test.join(small(frequencies))


def strength_sign(df: DataFrame, column: str = "elo_diff") -> DataFrame:
    return df.withColumn("stronger", F.signum(column).cast("int"))


# One-parameter models: the same grid search for all.


def grid_minimum(df: DataFrame, loss: Callable[[Column], Column], low: float, high: float, steps: int = 33, rounds: int = 4, weight: str | None = None) -> tuple[float, float]:
    """(argument, mean loss) of the least mean loss in [low, high]. Each round is one aggregate over all candidates
    at once, which stand in an array, so that every round runs the same generated code; then the interval shrinks to
    the neighbours of the best."""
    best = (low, math.inf)
    for _ in range(rounds):
        points = np.linspace(low, high, steps)
        tried = df.select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in points])).alias("grid_at", "grid_point"))
        tried = tried.select("grid_at", loss(F.col("grid_point")).alias("grid_loss"), *[weight] if weight else [])
        found = tried.groupBy("grid_at").agg(mean_of(F.col("grid_loss"), weight).alias("mean")).collect()  # a row per candidate
        losses = {r["grid_at"]: r["mean"] for r in found}
        if losses.get(0) is None:
            return best
        at = int(np.argmin([losses[i] for i in range(steps)]))
        best = (float(points[at]), float(losses[at]))
        low, high = float(points[max(0, at - 1)]), float(points[min(steps - 1, at + 1)])
    return best


def davidson(advantage: Column, nu: Column, scale: float = 400.0) -> tuple[Column, Column, Column]:
    """Home, draw, away from a rating advantage and a draw propensity."""
    home, away = F.pow(F.lit(10.0), advantage / (2 * scale)), F.pow(F.lit(10.0), -advantage / (2 * scale))
    draw = nu * F.sqrt(home * away)
    return home / (home + draw + away), draw / (home + draw + away), away / (home + draw + away)


def label_loss(p: Sequence[Column]) -> Column:
    picked = F.when(F.col("label") == 0, p[0]).when(F.col("label") == 1, p[1]).otherwise(p[2])
    return -F.log(picked + 1e-12)


def fit_davidson(train: DataFrame, advantage: Column, weight: str | None = None) -> float:
    return grid_minimum(train, lambda nu: label_loss(davidson(advantage, nu)), 1e-6, 5.0, weight=weight)[0]


def tempered(p: Sequence[Column], temperature: Column) -> list[Column]:
    """Probabilities to the power 1 / temperature, normalised; 0 is taken as 1e-12."""
    raised = [F.exp(F.log(F.greatest(c, F.lit(1e-12))) / temperature) for c in p]
    return [r / sum(raised[1:], raised[0]) for r in raised]


def fit_temperature(df: DataFrame, p: Sequence[str] = ("p0", "p1", "p2"), weight: str | None = None) -> float:
    return grid_minimum(df, lambda t: label_loss(tempered([F.col(c) for c in p], t)), 0.2, 5.0, weight=weight)[0]


# Mixtures.


def fit_mixture(df: DataFrame, members: Sequence[str], rounds: int = 60, weight: str | None = None) -> list[float]:
    """Weights of a convex mixture that minimise its log loss: expectation maximisation, one aggregate a round.
    members are columns with each model's probability of the true class."""
    rows = settle(df.select(*members, *[weight] if weight else []).dropna(), "mixture")
    mean, total = ((lambda v: F.sum(v * F.col(weight))), rows.agg(F.sum(weight)).first()[0] or 1) if weight else (F.avg, 1)
    weights = [1 / len(members)] * len(members)
    for _ in range(rounds):
        mix = sum((w * F.col(m) for w, m in zip(weights[1:], members[1:], strict=True)), weights[0] * F.col(members[0]))
        shares = rows.agg(*[mean(w * F.col(m) / F.greatest(mix, F.lit(1e-300))).alias(m) for w, m in zip(weights, members, strict=True)]).first()
        updated = [float(shares[m] or 0) / total for m in members]
        done = max(abs(a - b) for a, b in zip(weights, updated, strict=True)) < 1e-9
        weights = updated
        if done:
            break
    return weights


def simplex_step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The point of the simplex where the quadratic model around w is least: the best of those of all sets of members
    with a weight. Members are few."""
    k = len(w)
    best = (0.0, w)
    for size in range(1, k + 1):
        for used in map(list, combinations(range(k), size)):
            system = np.block([[curvature[np.ix_(used, used)] + 1e-10 * np.eye(size), np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            found = np.zeros(k)
            found[used] = np.linalg.solve(system, [*(curvature @ w - gradient)[used], 1.0])[:size]
            step = found - w
            value = gradient @ step + step @ curvature @ step / 2
            if found.min() >= 0 and value < best[0]:
                best = (value, found)
    return best[1]


def minimal_mixture(df: DataFrame, members: Sequence[str], rounds: int = 50, tolerance: float = 1e-9, weight: str | None = None) -> list[float]:
    """Weights of the convex mixture with the least log loss, by Newton steps on the simplex, at its edges too: where
    members are alike, expectation maximisation needs thousands of rounds. A round is an aggregate for gradient and
    curvature, and one for the losses of ever shorter steps. members are as in fit_mixture, and few."""
    rows = settle(df.select(*members, *[weight] if weight else []).dropna(), "mixture")
    k = len(members)
    mixed = lambda w: sum((float(x) * F.col(m) for x, m in zip(w[1:], members[1:], strict=True)), float(w[0]) * F.col(members[0])) + 1e-12
    w = np.full(k, 1 / k)
    for _ in range(rounds):
        shares = rows.select(*[(F.col(m) / mixed(w)).alias(f"r{i}") for i, m in enumerate(members)], *[weight] if weight else [])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = shares.agg(*[mean_of(F.col(f"r{i}"), weight).alias(f"g{i}") for i in range(k)], *[mean_of(F.col(f"r{i}") * F.col(f"r{j}"), weight).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if got[0] is None:
            break
        curvature = np.zeros((k, k))
        for (i, j), value in zip(pairs, got[k:], strict=True):
            curvature[i, j] = curvature[j, i] = value
        step = simplex_step(w, -np.array(got[:k], dtype=float), curvature) - w
        if np.abs(step).max() < tolerance:
            break
        tried = [w, *[w + step / 2**i for i in range(12)]]
        losses = rows.agg(*[mean_of(-F.log(mixed(x)), weight).alias(f"l{i}") for i, x in enumerate(tried)]).first()
        at = int(np.argmin(losses))
        if not at:
            break
        w = tried[at]
    return [float(x) for x in w / w.sum()]


# Poisson goals.


def poisson_rows(frame: DataFrame, weight: str | None = None) -> DataFrame:
    """Two rows per match: goals, strength difference of the scorer over 400, and whether it is at home; its weight. Where
    a column `strict` says which scores are those of 90 minutes, only these."""
    frame = frame.where("strict") if "strict" in frame.columns else frame
    sides = F.array(
        F.struct(F.col("home_score").cast("double").alias("goals"), (F.col("elo_diff") / 400).alias("x1"), F.col("home_adv").alias("x2")),
        F.struct(F.col("away_score").cast("double").alias("goals"), (-F.col("elo_diff") / 400).alias("x1"), F.lit(0.0).alias("x2")),
    )
    kept = [weight] if weight else []
    return frame.select(*kept, F.explode(sides).alias("s")).select(*kept, "s.*")


def fit_poisson(rows: DataFrame, features: Sequence[str] = ("x1", "x2"), target: str = "goals", rounds: int = 50, ridge: float = 1e-8, tolerance: float = 1e-10, weight: str | None = None) -> list[float]:
    """Coefficients [constant, *features] of log goals by Newton steps; the linear predictor is kept in [-3, 3]."""
    rows = settle(rows.select(target, *features, *[weight] if weight else []).dropna(), "poisson")
    mean = rows.agg(mean_of(F.col(target), weight)).first()[0]
    if mean is None:
        return [0.0] * (len(features) + 1)
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    beta = np.array([math.log(max(mean, 1e-9)), *[0.0] * len(features)])
    for _ in range(rounds):
        eta = sum((float(b) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        rate = F.exp(F.greatest(F.least(eta, F.lit(3.0)), F.lit(-3.0)))
        k = len(x)
        seen = F.col(weight) if weight else F.lit(1.0)
        cells = [F.sum(seen * c * (F.col(target) - rate)) for c in x] + [F.sum(seen * x[i] * x[j] * rate) for i in range(k) for j in range(i, k)]
        got = [float(v) for v in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()]
        hessian = np.zeros((k, k))
        at = iter(got[k:])
        for i in range(k):
            for j in range(i, k):
                hessian[i, j] = hessian[j, i] = next(at)
        step = np.linalg.solve(hessian + ridge * np.eye(k), np.array(got[:k]))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return [float(b) for b in beta]


def expected_goals(beta: Sequence[float], elo_diff: Column, home_adv: Column) -> tuple[Column, Column]:
    rate = lambda d, h: F.exp(F.greatest(F.least(beta[0] + beta[1] * d / 400 + beta[2] * h, F.lit(3.0)), F.lit(-3.0)))
    return rate(elo_diff, home_adv), rate(-elo_diff, F.lit(0.0))


LOG_FACTORIAL = [math.lgamma(k + 1) for k in range(61)]


def poisson_pmf(k: Column, rate: Column) -> Column:
    """For k up to 60."""
    return F.exp(-rate + k * F.log(rate) - F.get(F.array(*map(F.lit, LOG_FACTORIAL)), k.cast("int")))


def score_cells(df: DataFrame, home_rate: Column, away_rate: Column, keys: Sequence[str], most: int = 12) -> DataFrame:
    """keys, h, a, p and raw: the score matrix in long form, p normalised, raw before it."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(most)))
    rates = df.select(*keys, home_rate.alias("lh"), away_rate.alias("la"))
    total = lambda r: sum((poisson_pmf(F.lit(k), F.col(r)) for k in range(most + 1)), F.lit(0.0))
    rates = rates.withColumns({"th": total("lh"), "ta": total("la")})
    cells = rates.select("*", grid.alias("h")).select("*", grid.alias("a"))
    raw = poisson_pmf(F.col("h"), F.col("lh")) * poisson_pmf(F.col("a"), F.col("la"))
    return cells.select(*keys, "h", "a", raw.alias("raw"), (raw / (F.col("th") * F.col("ta"))).alias("p"))


#: Markets of a score matrix: which of its cells, by goals home and away, each one takes.
MARKETS = {
    **{f"over_{n}_5": (lambda h, a, n=n: h + a > n) for n in range(4)},
    "under_2_5": lambda h, a: h + a < 3,
    "both_teams_score": lambda h, a: (h > 0) & (a > 0),
    "home_clean_sheet": lambda h, a: a == 0,
    "away_clean_sheet": lambda h, a: h == 0,
}


def likely_scores(df: DataFrame, home_rate: Column, away_rate: Column, keys: Sequence[str], top: int, most: int = 12, rho: float = 0.0, actual: Sequence[str] = (), markets: bool = False) -> DataFrame:
    """keys and scores: the `top` likeliest cells of each score matrix as structs (h, a, p), the likeliest first, the
    lower score first of equals (to nine places). Whole matrices are made and searched in arrays of many rows at once;
    rates without a matrix (null) give cells without p. With rho the low scores are corrected and the matrix normalised
    again. `actual` names the columns of a score, whose chance is p_actual (null outside the matrix); `markets` adds
    these as a struct, and tail_mass, what is beyond the matrix before it is normalised."""
    rows = df.select(*keys, home_rate.cast("double").alias("lh_"), away_rate.cast("double").alias("la_"), *[F.col(c).cast("double").alias(f"{n}_") for n, c in zip("ha", actual, strict=False)])
    cell = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("p", T.DoubleType())])
    fields = [*df.select(*keys).schema.fields, T.StructField("scores", T.ArrayType(cell))]
    if actual:
        fields.append(T.StructField("p_actual", T.DoubleType()))
    if markets:
        fields += [T.StructField("markets", T.StructType([T.StructField(m, T.DoubleType()) for m in MARKETS])), T.StructField("tail_mass", T.DoubleType())]
    return rows.mapInArrow(searched(len(keys), top, most, rho, bool(actual), markets), T.StructType(fields))


def searched(n_keys: int, top: int, most: int, rho: float = 0.0, actual: bool = False, markets: bool = False, chunk: int = 1000):
    """Batches (keys, two rates, a score if asked for) as batches (keys, scores, what else is asked for), a thousand
    matrices at a time."""
    goals, log_factorial = np.arange(most + 1), np.array([math.lgamma(k + 1) for k in range(most + 1)])
    cells = (most + 1) ** 2
    top = min(top, cells)
    takes = np.array([test(*divmod(np.arange(cells), most + 1)) for test in MARKETS.values()], dtype=float).T if markets else None
    doubles = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))

    def matrices(lh: np.ndarray, la: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.exp(-r[:, None] + goals * np.log(r)[:, None] - log_factorial) for r in (lh, la))
        mass = x.sum(1) * y.sum(1)
        p = x[:, :, None] * y[:, None, :] / mass[:, None, None]
        if rho:
            for (h, a), tau in {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): 1 - rho}.items():
                p[:, h, a] *= np.maximum(tau, 1e-12)
            p /= p.sum((1, 2), keepdims=True)
        return p.reshape(len(lh), cells), mass

    def best(lh: np.ndarray, la: np.ndarray, score: np.ndarray | None) -> list[np.ndarray]:
        p, mass = matrices(lh, la)
        left, at = np.nan_to_num(np.floor(p * 1e9 + 0.5), nan=0.0), np.empty((len(lh), top), dtype=np.int64)
        row = np.arange(len(lh))
        for k in range(top):  # the first of equals is the one with the lower score
            at[:, k] = left.argmax(1)
            left[row, at[:, k]] = -1.0
        made = [at, p[row[:, None], at]]
        if score is not None:
            inside = ((score >= 0) & (score <= most)).all(1)
            h, a = np.where(inside[:, None], score, 0).astype(np.int64).T
            made.append(np.where(inside, p[row, h * (most + 1) + a], np.nan))
        return [*made, p @ takes, 1 - mass] if markets else made

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [np.array(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns[n_keys:]]
            n = batch.num_rows
            score = np.stack(given[2:], axis=1) if actual else None
            with np.errstate(all="ignore"):
                parts = [best(given[0][i : i + chunk], given[1][i : i + chunk], None if score is None else score[i : i + chunk]) for i in range(0, n, chunk)]
            at, p, *more = (np.concatenate(c) for c in zip(*parts, strict=True))
            at = at.ravel()
            flat = pa.StructArray.from_arrays([pa.array(at // (most + 1), pa.int32()), pa.array(at % (most + 1), pa.int32()), doubles(p.ravel())], ["h", "a", "p"])
            columns = {"scores": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * top, pa.int32()), flat)}
            if actual:
                columns["p_actual"] = doubles(more.pop(0))
            if markets:
                columns["markets"] = pa.StructArray.from_arrays([doubles(c) for c in more[0].T], list(MARKETS))
                columns["tail_mass"] = doubles(more[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *columns.values()], [*batch.schema.names[:n_keys], *columns])

    return search


def low_score_factor(h: Column, a: Column, lh: Column, la: Column, rho: Column) -> Column:
    """The Dixon-Coles correction of the four low scores, at least 1e-12."""
    tau = F.when((h == 0) & (a == 0), 1 - lh * la * rho).when((h == 1) & (a == 0), 1 + la * rho).when((h == 0) & (a == 1), 1 + lh * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(F.lit(1.0))
    return F.greatest(tau, F.lit(1e-12))


def fit_rho(df: DataFrame, home_rate: str, away_rate: str, home: str = "home_score", away: str = "away_score", weight: str | None = None) -> float:
    h, a = F.col(home), F.col(away)
    return grid_minimum(df, lambda rho: -F.log(low_score_factor(h, a, F.col(home_rate), F.col(away_rate), rho)), -0.15, 0.15, weight=weight)[0]


def matrix_outcomes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Win, draw, loss and the derived markets of each score matrix, in one aggregate."""
    p, h, a = F.col("p"), F.col("h"), F.col("a")
    total = lambda test: F.sum(F.when(test, p).otherwise(0.0))
    overs = {f"over_{n}_5": total(h + a > n) for n in range(4)}
    return cells.groupBy(*keys).agg(total(h > a).alias("p0"), total(h == a).alias("p1"), total(h < a).alias("p2"), *[c.alias(n) for n, c in overs.items()], total((h > 0) & (a > 0)).alias("btts"), total(a == 0).alias("home_clean_sheet"), total(h == 0).alias("away_clean_sheet"), (1 - F.sum("raw")).alias("tail_mass"))


# Multinomial logistic.


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label", penalty: float = 1e-4, classes: int = 3, rounds: int = 25, tolerance: float = 1e-9, weight: str | None = None) -> list[list[float]]:
    """Weights (classes x [constant, *features]) that minimise the mean log loss plus penalty times their squares,
    the constants included. Newton steps: gradient and curvature are one aggregate each round."""
    rows = settle(df.select(label, *features, *[weight] if weight else []).dropna(), "logistic")
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    w = np.zeros((classes, k))
    for _ in range(rounds):
        scores = [sum((float(w[c, j]) * x[j] for j in range(1, k)), F.lit(float(w[c, 0]))) for c in range(classes)]
        top = F.greatest(*scores)
        raised = [F.exp(s - top) for s in scores]
        p = [r / sum(raised[1:], raised[0]) for r in raised]
        cells = rows.select(*[c.alias(f"p{i}") for i, c in enumerate(p)], *[c.alias(f"x{j}") for j, c in enumerate(x)], F.col(label).alias("y"), *[weight] if weight else [])
        mean = (lambda v: F.sum(v * F.col(weight))) if weight else F.avg
        sums = [mean((F.col(f"p{c}") - (F.col("y") == c).cast("double")) * F.col(f"x{j}")) for c in range(classes) for j in range(k)]
        pairs = [(c, d, i, j) for c in range(classes) for d in range(c, classes) for i in range(k) for j in range(i, k)]
        sums += [mean(F.col(f"p{c}") * ((1.0 if c == d else 0.0) - F.col(f"p{d}")) * F.col(f"x{i}") * F.col(f"x{j}")) for c, d, i, j in pairs]
        got = cells.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)], (F.sum(weight) if weight else F.lit(1)).alias("total")).first()
        if got[0] is None:
            break
        got = [v / got["total"] for v in got[:-1]]
        gradient = np.array(got[: classes * k], dtype=float) + 2 * penalty * w.ravel()
        curvature = 2 * penalty * np.eye(classes * k)
        for (c, d, i, j), value in zip(pairs, got[classes * k :], strict=True):
            for a, b in {(c, d), (d, c)}:
                for m, n in {(i, j), (j, i)}:
                    curvature[a * k + m, b * k + n] += value
        step = np.linalg.solve(curvature, gradient)
        w = w - step.reshape(classes, k)
        if np.abs(step).max() < tolerance:
            break
    return w.tolist()


def logistic_probabilities(weights: Sequence[Sequence[float]], features: Sequence[str]) -> list[Column]:
    scores = [sum((float(v) * F.col(f).cast("double") for v, f in zip(row[1:], features, strict=True)), F.lit(float(row[0]))) for row in weights]
    top = F.greatest(*scores)
    raised = [F.exp(s - top) for s in scores]
    return [r / sum(raised[1:], raised[0]) for r in raised]


def standardiser(train: DataFrame, columns: Sequence[str], indicators: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Median imputation and scaling learned on train only (sample deviation; next to none counts as 1); indicators
    are filled with 0 and not scaled. Returns what applies it."""
    scaled = [c for c in columns if c not in indicators]
    medians = train.agg(*[F.median(c).alias(c) for c in scaled]).first() if scaled else {}
    fill = {c: float(medians[c] if medians[c] is not None else 0.0) for c in scaled}
    got = train.agg(*[f(F.coalesce(F.col(c), F.lit(fill[c]))).alias(f"{n}_{c}") for c in scaled for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first() if scaled else {}

    def apply(df: DataFrame) -> DataFrame:
        made = {c: (F.coalesce(F.col(c), F.lit(fill[c])) - float(got[f"m_{c}"] or 0.0)) / (s if (s := float(got[f"s_{c}"] or 0.0)) > 1e-9 else 1.0) for c in scaled}
        return df.withColumns(made | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in indicators})

    return apply


def importance_of(weights: Sequence[Sequence[float]], features: Sequence[str]) -> list[tuple[str, float]]:
    """Mean absolute weight over the classes, largest first."""
    return sorted(((f, float(np.mean([abs(row[j + 1]) for row in weights]))) for j, f in enumerate(features)), key=lambda x: (-x[1], x[0]))
