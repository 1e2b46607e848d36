"""Blending of signals in long form: one row per match and signal; an absent row is a missing signal.

A weight per signal is a row of a small table (version, signal, weight), so all versions are scored in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.operators import metrics
from fixtura.shared import small

#: Product weights and named versions (fixed values of the product configuration).
VERSIONS = {
    "default": {"historical": 0.35, "market": 0.25, "squad_strength": 0.15, "recent_form": 0.10, "expert": 0.10, "venue_context": 0.05},
    "baseline_historical": {"historical": 1.0},
    "market_only": {"market": 1.0},
    "squad_form_challenger": {"historical": 0.50, "squad_strength": 0.30, "recent_form": 0.20},
    "llm_adjusted_challenger": {"historical": 0.60, "expert": 0.40},
    "final_ensemble": {"historical": 0.35, "market": 0.25, "squad_strength": 0.15, "recent_form": 0.10, "expert": 0.10, "venue_context": 0.05, "knockout_upset": 0.05},
}
REVIEW_DISTANCE = 0.15


def weights_table(spark, versions: dict[str, dict[str, float]] | None = None) -> DataFrame:
    rows = [(v, s, float(w)) for v, weights in (versions or VERSIONS).items() for s, w in weights.items()]
    return spark.createDataFrame(rows, "version string, signal string, weight double")


def blend(signals: DataFrame, weights: DataFrame, key: str = "match_id", held: bool = False) -> DataFrame:
    """key, version, p0..p2, used and missing signals: the weighted mean of the signals a match has, weights made to
    sum to 1 again. Signals without positive weight take no part; a match with none of a version's has no row. With
    held, also s, the forecasts of the signals used."""
    positive = weights.where("weight > 0")
    rows = signals.join(small(positive), "signal")
    means = rows.groupBy(key, "version").agg(
        *[(F.sum(F.col("weight") * F.col(f"p{k}")) / F.sum("weight")).alias(f"m{k}") for k in range(3)],
        F.sort_array(F.collect_set("signal")).alias("used"),
        *[F.collect_list(F.struct("p0", "p1", "p2")).alias("s")] * held,
    )
    names = positive.groupBy("version").agg(F.sort_array(F.collect_set("signal")).alias("configured"))
    total = F.col("m0") + F.col("m1") + F.col("m2")
    out = means.join(small(names), "version")
    return out.select(key, "version", *[(F.col(f"m{k}") / total).alias(f"p{k}") for k in range(3)], "used", F.array_except("configured", "used").alias("missing"), *["s"] * held)


def disagreement(signals: DataFrame, key: str = "match_id") -> DataFrame:
    """key and the largest distance of any two of its signals. A match has a handful of signals: they are gathered
    per match and compared in the row, so no pair is ever a row of a join."""
    rows = signals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("signal", "p0", "p1", "p2"))).alias("s"))
    gap = lambda a, b: 0.5 * (F.abs(a["p0"] - b["p0"]) + F.abs(a["p1"] - b["p1"]) + F.abs(a["p2"] - b["p2"]))
    worst = F.aggregate("s", F.lit(0.0), lambda top, a: F.aggregate("s", top, lambda inner, b: F.greatest(inner, gap(a, b))))
    return rows.select(key, worst.alias("max_disagreement"), F.size("s").alias("n_signals"))


def against_reference(signals: DataFrame, reference: str, key: str = "match_id") -> DataFrame:
    """Distance of each other signal from the reference of its match."""
    r = signals.where(F.col("signal") == reference).select(key, *[F.col(f"p{k}").alias(f"r{k}") for k in range(3)])
    gap = 0.5 * (F.abs(F.col("p0") - F.col("r0")) + F.abs(F.col("p1") - F.col("r1")) + F.abs(F.col("p2") - F.col("r2")))
    return signals.where(F.col("signal") != reference).join(r, key).select(key, "signal", gap.alias("distance"))


def flagged(disagreements: DataFrame, threshold: float = REVIEW_DISTANCE) -> DataFrame:
    return disagreements.withColumn("flagged", F.col("max_disagreement") >= threshold)


def score_versions(signals: DataFrame, labels: DataFrame, weights: DataFrame, key: str = "match_id", threshold: float = REVIEW_DISTANCE) -> DataFrame:
    """Scores of every version on the matches it can serve, and how its loss depends on disagreement."""
    every = labels.select(key, "label")
    # A version's disagreement is that of the signals it uses, gathered as they are blended.
    blended = blend(signals, weights, key, held=True).join(every, key)
    gap = lambda a, b: 0.5 * (F.abs(a["p0"] - b["p0"]) + F.abs(a["p1"] - b["p1"]) + F.abs(a["p2"] - b["p2"]))
    worst = F.aggregate("s", F.lit(0.0), lambda top, a: F.aggregate("s", top, lambda inner, b: F.greatest(inner, gap(a, b))))
    rows = blended.withColumn("high", worst >= threshold)
    loss = metrics.log_loss()
    return rows.groupBy("version").agg(
        F.count("*").alias("n_scored"),
        F.avg(loss).alias("log_loss"),
        F.avg(metrics.brier()).alias("brier"),
        F.avg(metrics.rps()).alias("rps"),
        F.avg(metrics.correct()).alias("accuracy"),
        F.avg(F.size("used")).alias("mean_signals_used"),
        F.avg(F.size("missing")).alias("missing_signal_rate"),
        F.count_if("high").alias("high_disagreement_count"),
        F.avg(F.when(F.col("high"), loss)).alias("log_loss_high_disagreement"),
        F.avg(F.when(~F.col("high"), loss)).alias("log_loss_low_disagreement"),
    )


def signal_coverage(signals: DataFrame, matches: DataFrame, names: list[str], key: str = "match_id") -> DataFrame:
    """Per named signal: matches it covers, its rate and what that makes of it."""
    counts = signals.groupBy("signal").agg(F.count_distinct(key).alias("n_covered"))
    every = signals.sparkSession.createDataFrame([(n,) for n in names], "signal string")
    total = matches.agg(F.count("*").alias("n_total"))
    rows = F.broadcast(every).join(counts, "signal", "left").join(F.broadcast(total)).withColumn("n_covered", F.coalesce("n_covered", F.lit(0)))
    rate = F.col("n_covered") / F.greatest("n_total", F.lit(1))
    return rows.withColumn("coverage_rate", rate).withColumn("status", F.when(F.col("coverage_rate") >= 0.5, "trusted").when(F.col("coverage_rate") > 0, "experimental").otherwise("absent"))


def verdict(base_loss, full_loss, base_brier, full_brier, coverage):
    """What a comparison of the full blend with its baseline allows to say."""
    return F.when(base_loss.isNull() | full_loss.isNull(), "insufficient").when(coverage < 0.05, "insufficient_coverage").when((full_loss < base_loss) & (full_brier < base_brier), "improves").otherwise("no_clear_gain")


def tune_weights(signals: DataFrame, labels: DataFrame, names: list[str], rounds: int = 40, key: str = "match_id") -> dict[str, float]:
    """Weights that lower the log loss of the renormalised blend, by multiplicative updates.

    Each round is one aggregate over matches: with v = p(label) per signal and the blend b of the signals present,
    a weight moves by the mean of v / b over the matches that have the signal."""
    from fixtura.shared import settle

    true_p = F.when(F.col("label") == 0, F.col("p0")).when(F.col("label") == 1, F.col("p1")).otherwise(F.col("p2"))
    wide = signals.join(labels.select(key, "label"), key).groupBy(key).agg(*[F.max(F.when(F.col("signal") == n, true_p)).alias(n) for n in names])
    wide = settle(wide, "tuning")
    weights = {n: 1 / len(names) for n in names}
    for _ in range(rounds):
        top = sum((F.coalesce(w * F.col(n), F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
        bottom = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
        gains = wide.where(bottom > 0).agg(*[F.avg(F.when(F.col(n).isNotNull(), F.col(n) / F.greatest(top / bottom, F.lit(1e-12)))).alias(n) for n in names]).first()
        moved = {n: w * float(gains[n] or 0.0) ** 0.5 for n, w in weights.items()}
        total = sum(moved.values()) or 1.0
        weights = {n: w / total for n, w in moved.items()}
    return weights
