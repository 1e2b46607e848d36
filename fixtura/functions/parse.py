"""Typed values from text cells: scores, flags, dates, timestamps, tournament classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "no value yet" (fixed).
MISSING_SCORES = ("", "NA", "NaN", "nan")


def score_value(cell: Column) -> Column:
    """The score as an integer; null where it is missing, no integer or negative."""
    clean = F.trim(cell)
    value = clean.try_cast("int")
    return F.when(~clean.isin(*MISSING_SCORES) & clean.rlike(r"^[+-]?[0-9]+$") & (value >= 0), value)


def score_missing(cell: Column) -> Column:
    return F.trim(cell).isin(*MISSING_SCORES)


def score_bad(cell: Column) -> Column:
    return ~score_missing(cell) & score_value(cell).isNull()


def neutral_flag(cell: Column) -> Column:
    """true/1 and false/0 in any case; null for anything else."""
    word = F.lower(F.trim(cell))
    return F.when(word.isin("true", "1"), F.lit(True)).when(word.isin("false", "0"), F.lit(False))


def iso_date(cell: Column) -> Column:
    return F.trim(cell).try_cast("date")


def first_date(cell: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")) -> Column:
    """The date by the first format that reads the cell."""
    return F.coalesce(*[F.try_to_date(F.trim(cell), f) for f in formats])


def zoned_timestamp(cell: Column) -> Column:
    """A timestamp only if the cell names its offset from UTC; null otherwise."""
    return F.when(F.trim(cell).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.trim(cell).try_cast("timestamp"))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def knockout_capable(tournament: Column, patterns: tuple[str, ...]) -> Column:
    """A pattern occurs, case-sensitively, and it is no qualification."""
    return ~F.lower(tournament).contains("qualif") & contains_any(tournament, patterns)


def competitive(tournament: Column, excluded: tuple[str, ...] = ("friendly",)) -> Column:
    return ~contains_any(F.lower(tournament), excluded)


def first_rule(text: Column, rules: tuple[tuple[str, float], ...], default: float) -> Column:
    """The value of the first rule whose pattern the lower-cased text contains; rules keep their order."""
    value = F.lit(default)
    for pattern, found in reversed(rules):
        value = F.when(F.lower(text).contains(pattern), F.lit(found)).otherwise(value)
    return value


def competition_bucket(tournament: Column) -> Column:
    """world_cup, qualification, friendly or other."""
    word = F.lower(tournament)
    return F.when(word.contains("qualif"), "qualification").when(word == "friendly", "friendly").when(word.contains("world cup"), "world_cup").otherwise("other")


def looks_numeric(cell: Column) -> Column:
    return F.trim(cell).rlike(r"^[0-9]+(\.[0-9]+)?$")


def source_id(cell: Column) -> Column:
    """An id as text, without the .0 that a float column leaves."""
    return F.regexp_replace(F.trim(cell.cast("string")), r"\.0$", "")


def noted_date(cell: Column) -> Column:
    """The first ISO date in a note."""
    return F.nullif(F.regexp_extract(cell, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).try_cast("date")
