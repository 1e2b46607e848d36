"""Adapters: what a source of enrichment offers the engine, as protocols, and a table that offers it.

An adapter never fetches: answers land as files, readers of `sources` make a table of them, and the adapter says which
rows hold, what they cover and how they meet the engine's own tables. Everything stays a DataFrame until asked for."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.operators import linking, temporal
from fixtura.sources import sinks


@runtime_checkable
class SourceAdapter(Protocol):
    """Every source: its valid records, the refused ones with a reason, a manifest and its coverage."""

    name: str
    role: str

    def records(self) -> DataFrame: ...
    def refused(self) -> DataFrame: ...
    def manifest(self) -> dict: ...
    def coverage(self) -> DataFrame: ...


@runtime_checkable
class FixtureAdapter(SourceAdapter, Protocol):
    def link_fixtures(self, canonical: DataFrame) -> DataFrame: ...


@runtime_checkable
class PlayerAdapter(SourceAdapter, Protocol):
    def resolve_players(self, aliases: DataFrame) -> DataFrame: ...


@runtime_checkable
class RankingAdapter(SourceAdapter, Protocol):
    def as_of(self, facts: DataFrame) -> DataFrame: ...


@runtime_checkable
class EventAdapter(SourceAdapter, Protocol):
    def event_coverage(self) -> DataFrame: ...


@dataclass
class TableAdapter:
    """A table as a source. rules: reason -> condition that a valid row meets; null counts as not met, the first rule
    that fails names the reason. date: the column that coverage is told in."""

    name: str
    role: str
    raw: DataFrame
    date: str
    rules: Mapping[str, Column] = field(default_factory=dict)

    def reason(self) -> Column:
        failed = [F.when(~F.coalesce(rule, F.lit(False)), reason) for reason, rule in self.rules.items()]
        return F.coalesce(*failed, F.lit(None).cast("string"))

    def records(self) -> DataFrame:
        return self.raw.where(self.reason().isNull())

    def refused(self) -> DataFrame:
        return self.raw.withColumn("reason", self.reason()).where("reason is not null")

    def manifest(self) -> dict:
        """The same for the same valid rows in any order."""
        rows = self.records()
        parts = {"name": self.name, "role": self.role, "columns": rows.columns, "rows": rows.count(), "content": sinks.content_hash(rows)}
        return parts | {"version": sinks.version_of(parts)}

    def coverage(self) -> DataFrame:
        """One row, in one aggregate; a source without valid rows has no period."""
        valid = self.reason().isNull()
        period = [f(F.when(valid, F.col(self.date).cast("date"))).alias(n) for n, f in (("first_date", F.min), ("last_date", F.max))]
        return self.raw.agg(F.count("*").alias("n_rows"), F.count_if(valid).alias("n_valid"), *period).select(F.lit(self.name).alias("name"), F.lit(self.role).alias("role"), "*")


@dataclass
class Fixtures(TableAdapter):
    key: str = "source_id"

    def link_fixtures(self, canonical: DataFrame) -> DataFrame:
        return linking.link_fixtures(self.records(), canonical, self.key)


@dataclass
class Players(TableAdapter):
    """player: the source's own name of a player, which aliases (alias, player_id) turn into the engine's."""

    player: str = "player"

    def resolve_players(self, aliases: DataFrame) -> DataFrame:
        """player_id where exactly one player has the alias, else null: a name shared by two is nobody's."""
        single = aliases.groupBy(F.col("alias").alias("alias_")).agg(F.min("player_id").alias("player_id"), F.max("player_id").alias("last_")).where("player_id = last_").drop("last_")
        return self.records().join(single, F.col(self.player) == F.col("alias_"), "left").drop("alias_")


@dataclass
class Rankings(TableAdapter):
    team: str = "team"
    values: tuple[str, ...] = ("points",)

    def as_of(self, facts: DataFrame) -> DataFrame:
        """facts (team, date, ...) with the latest values strictly before their date."""
        return temporal.asof_join(facts, self.records(), self.team, "date", self.date, list(self.values))


@dataclass
class Events(TableAdapter):
    by: tuple[str, ...] = ("team",)

    def event_coverage(self) -> DataFrame:
        return self.records().groupBy(F.year(self.date).alias("year"), *self.by).agg(F.count("*").alias("n_events"))
