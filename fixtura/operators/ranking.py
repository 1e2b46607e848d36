"""Ranks, standardised scores and comparisons of two orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.operators.temporal import asof_join


def release_ranks(releases: DataFrame) -> DataFrame:
    """Competition rank in each release: one more than the teams with strictly more points; null for null points."""
    order = Window.partitionBy("release_date").orderBy(F.desc_nulls_last("points"))
    return releases.withColumn("rank", F.when(F.col("points").isNotNull(), F.rank().over(order)))


def release_changes(releases: DataFrame, lags: tuple[int, ...] = (1, 3)) -> DataFrame:
    by_team = Window.partitionBy("team").orderBy("release_date")
    return releases.withColumns({f"change_{k}": F.col("points") - F.lag("points", k).over(by_team) for k in lags})


def validate_published(published: DataFrame, releases: DataFrame) -> DataFrame:
    """Published ranks beside those reconstructed from the release before each opening, and how far they are apart."""
    ranked = release_ranks(releases).select("team", "release_date", F.col("rank").alias("reconstructed"))
    seen = asof_join(published, ranked, "team", "opening", "release_date", ["reconstructed"])
    apart = F.abs(F.col("reconstructed") - F.col("published"))
    named = F.when(F.col("reconstructed").isNull(), "unmatched").when(apart == 0, "exact").when(apart <= 2, "small").when(apart <= 5, "medium").otherwise("large")
    return seen.withColumn("class", named)


def compare(totals: DataFrame) -> DataFrame:
    """Ranks by points and by elo, points scaled to [0, 1] and standardised (population deviation). The extremes and
    moments are one aggregated row; only the ranks need an order over the (aggregated, one row per team) table."""
    moments = totals.agg(F.min("points").alias("lo"), F.max("points").alias("hi"), F.avg("points").alias("mean"), F.stddev_pop("points").alias("sd"))
    rows = totals.join(F.broadcast(moments))
    rows = rows.withColumns({"points_rank": F.rank().over(Window.orderBy(F.desc("points"))), "elo_rank": F.rank().over(Window.orderBy(F.desc("elo")))})
    return rows.withColumns({"scaled": (F.col("points") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), "z": (F.col("points") - F.col("mean")) / F.nullif("sd", F.lit(0.0))})


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman (average ranks for ties) and Pearson correlation of two columns of an aggregated table."""
    middle = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    ranked = df.withColumns({"rank_a": middle(a), "rank_b": middle(b)})
    return ranked.agg(F.corr("rank_a", "rank_b").alias("spearman"), F.corr(a, b).alias("pearson"))


def filled_zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column>: population z-score after filling nulls with the median; 0 where nothing varies."""
    medians = df.agg(*[F.median(c).alias(f"med_{c}") for c in columns])
    filled = df.join(F.broadcast(medians)).withColumns({f"fill_{c}": F.coalesce(c, f"med_{c}") for c in columns})
    moments = filled.agg(*[f(f"fill_{c}").alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    out = filled.join(F.broadcast(moments))
    z = {f"z_{c}": F.when(F.col(f"sd_{c}") > 0, (F.col(f"fill_{c}") - F.col(f"mean_{c}")) / F.col(f"sd_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return out.withColumns(z).drop(*[f"{n}_{c}" for c in columns for n in ("med", "fill", "mean", "sd")])
