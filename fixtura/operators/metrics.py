"""Scores of probability forecasts, as expressions and aggregates.

Forecast columns are p0, p1, p2 and label (0, 1, 2). Every metric that is a mean over rows is one expression, so a
report is one aggregate and a bootstrap needs only its sum and count per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.hashing import hash_uniform
from fixtura.operators.models import mean_of

P = ("p0", "p1", "p2")


def of_label(label: str = "label", p: tuple[str, ...] = P) -> Column:
    value = F.col(p[2])
    for k in (1, 0):
        value = F.when(F.col(label) == k, F.col(p[k])).otherwise(value)
    return value


def log_loss(label: str = "label", p: tuple[str, ...] = P) -> Column:
    return -F.log(of_label(label, p) + 1e-12)


def brier(label: str = "label", p: tuple[str, ...] = P) -> Column:
    return sum((F.pow(F.col(c) - (F.col(label) == k).cast("double"), 2) for k, c in enumerate(p)), F.lit(0.0))


def rps(label: str = "label", p: tuple[str, ...] = P) -> Column:
    first = F.col(p[0]) - (F.col(label) == 0).cast("double")
    second = first + F.col(p[1]) - (F.col(label) == 1).cast("double")
    return (F.pow(first, 2) + F.pow(second, 2)) / 2


def confidence(p: tuple[str, ...] = P) -> Column:
    return F.greatest(*p)


def predicted(p: tuple[str, ...] = P) -> Column:
    """The most likely class; the first of equals."""
    top = F.greatest(*p)
    return F.when(F.col(p[0]) == top, 0).when(F.col(p[1]) == top, 1).otherwise(2)


def correct(label: str = "label", p: tuple[str, ...] = P) -> Column:
    return (predicted(p) == F.col(label)).cast("double")


def number_of(weight: str | None = None) -> Column:
    return F.sum(weight) if weight else F.count("*")


def confidence_bins(df: DataFrame, bins: int = 10, p: tuple[str, ...] = P, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Per bin of the largest probability (cut by truncation): rows, mean confidence, share correct."""
    number = F.least(F.floor(confidence(p) * bins), F.lit(bins - 1)).cast("int")
    rows = df.select(*by, number.alias("bin"), confidence(p).alias("c"), correct(p=p).alias("hit"), *[weight] if weight else [])
    return rows.groupBy(*by, "bin").agg(number_of(weight).alias("n"), mean_of(F.col("c"), weight).alias("mean_confidence"), mean_of(F.col("hit"), weight).alias("empirical_accuracy"))


def calibration_error(df: DataFrame, bins: int = 10, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    made = confidence_bins(df, bins, by=by, weight=weight)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("empirical_accuracy"))) / F.sum("n")
    return made.groupBy(*by).agg(gap.alias("ece"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """All bins, empty ones with a count of 0 and null means."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(confidence_bins(df, bins)), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_calibration(df: DataFrame, bins: int = 10, p: tuple[str, ...] = P) -> DataFrame:
    """Per class and bin of its probability (left-closed on k / bins): rows, mean probability, share that came true."""
    edges = [k / bins for k in range(1, bins)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).alias("p"), (F.col("label") == k).cast("double").alias("hit")) for k, c in enumerate(p)])).alias("x")).select("x.*")
    number = sum(((F.col("p") >= e).cast("int") for e in edges), F.lit(0))
    return long.groupBy("class", number.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("hit").alias("empirical"))


def summary(df: DataFrame, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """n, log_loss, brier, rps, accuracy and ece, per group of `by`; with a weight, a row counts as often as it says."""
    scores = {"log_loss": log_loss(), "brier": brier(), "rps": rps(), "accuracy": correct()}
    means = df.groupBy(*by).agg(number_of(weight).alias("n"), *[mean_of(c, weight).alias(n) for n, c in scores.items()])
    gaps = calibration_error(df, by=by, weight=weight)
    return means.join(gaps, list(by)) if by else means.join(F.broadcast(gaps))


def binary_scores(df: DataFrame, p: str, hit: str) -> DataFrame:
    """log loss (probabilities clipped at 1e-12), Brier and accuracy (0.5 counts as yes) of a two-way forecast."""
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    y = F.col(hit).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"), F.avg(F.pow(F.col(p) - y, 2)).alias("brier"), F.avg(((F.col(p) >= 0.5) == (y == 1)).cast("double")).alias("accuracy"))


def block_bootstrap(df: DataFrame, value: Column, block: str, resamples: int = 1000, seed: int = 7, level: float = 0.90, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Mean of value with a percentile interval over resampled whole blocks, per group of `by`; with a weight, a row
    counts as often as it says.

    Rows collapse to a sum and a count per block first, so a resample costs blocks, not rows. Draws are hashes of
    (seed, resample, draw): the same on every run, in any engine and for every group."""
    total = F.sum(value * F.col(weight)) if weight else F.sum(value)
    blocks = df.groupBy(*by, F.col(block).alias("block")).agg(total.alias("total"), number_of(weight).alias("n"))
    indexed = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("block", "total", "n"))).alias("b"))  # one row per group and block, years for instance
    draws = indexed.select(*by, "b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).select(*by, "b", "resample", F.explode(F.sequence(F.lit(0), F.size("b") - 1)).alias("draw"))
    at = F.floor(hash_uniform(F.lit(str(seed)), F.col("resample").cast("string"), F.col("draw").cast("string")) * F.size("b")).cast("int")
    picked = draws.select(*by, "resample", F.get("b", at).alias("x")).groupBy(*by, "resample").agg((F.sum("x.total") / F.sum("x.n")).alias("stat"))
    ends = picked.groupBy(*by).agg(F.percentile("stat", F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))).alias("q"))
    point = blocks.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("point"), F.count("*").alias("blocks"))
    both = point.join(ends, list(by)) if by else point.join(F.broadcast(ends))
    return both.select(*by, "point", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "blocks")


def delta_verdict(point: Column, low: Column, high: Column) -> Column:
    return F.when(high < 0, "supported_improvement").when(low > 0, "supported_degradation").when(F.abs(point) < 0.001, "no_meaningful_change").otherwise("weak_evidence")


def paired_delta(base: DataFrame, challenger: DataFrame, key: str, block: str, **options) -> DataFrame:
    """Bootstrap of the difference in log loss on the rows both have, and what it says."""
    left = base.select(key, block, log_loss().alias("base_loss"))
    right = challenger.select(key, log_loss().alias("new_loss"))
    out = block_bootstrap(left.join(right, key), F.col("new_loss") - F.col("base_loss"), block, **options)
    return out.withColumn("verdict", delta_verdict(F.col("point"), F.col("ci_low"), F.col("ci_high")))
