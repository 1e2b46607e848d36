"""Data-quality reports and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.shared import DataError

KEY = ("date", "home_team", "away_team")


def with_event_counts(matches: DataFrame, events: DataFrame) -> DataFrame:
    """matches with how many events each has, 0 for none: the events are counted per key before the join."""
    counts = events.groupBy(*KEY).agg(F.count("*").alias("events"))
    return matches.join(counts, list(KEY), "left").withColumn("events", F.coalesce("events", F.lit(0)))


def event_coverage(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Per year: matches, those with events, events, and the share covered (null for no matches)."""
    rows = with_event_counts(matches, events).withColumn("year", F.year(F.col("date").try_cast("date"))).where("year is not null")
    out = rows.groupBy("year").agg(F.count("*").alias("matches"), F.count_if(F.col("events") > 0).alias("covered"), F.sum("events").alias("events"))
    return out.withColumn("share", F.round(F.col("covered") / F.nullif(F.col("matches"), F.lit(0)), 4))


def replace_rows(df: DataFrame, outdated: Column, fresh: DataFrame) -> DataFrame:
    """df without its outdated rows, and the fresh ones."""
    return df.where(~outdated).unionByName(fresh)


def build_report(triaged: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: is every raw row accounted for, and how many matches, shootouts and unknown outcomes there are."""
    rows = triaged.agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("gone"))
    found = matches.agg(F.count("*").alias("matches"), F.count_if("shootout_played").alias("shootouts"), F.count_if(F.col("regulation_outcome") == "unknown").alias("unknown_outcomes"))
    return rows.join(F.broadcast(found)).select((F.col("raw") == F.col("kept") + F.col("gone")).alias("all_accounted"), "matches", "shootouts", "unknown_outcomes")


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break in the order given. A rule that is null counts
    as kept: a missing value is no wrong value."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("broken", F.array_join(broken, ";")).where("broken <> ''").select(*keys, "broken")


def available_before(df: DataFrame, available_at: str, used_at: str) -> DataFrame:
    """Rows whose evidence came after it was used; the same moment is allowed."""
    return df.where(F.col(available_at) > F.col(used_at))


def assert_none(df: DataFrame, message: str) -> None:
    if df.limit(1).count():
        raise DataError(message)


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, filled rows, their rate, their mean; one pass over the table."""
    stats = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("filled"), (F.count(c) / F.count("*")).alias("rate"), F.avg(F.col(c).cast("double")).alias("mean")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def null_rates(df: DataFrame) -> DataFrame:
    """An inventory of a table: column, type, nulls, rate of nulls."""
    stats = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.count_if(F.col(c).isNull()).alias("nulls"), (F.count_if(F.col(c).isNull()) / F.count("*")).alias("null_rate")) for c, kind in df.dtypes]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
