"""Names and keys. Accents go by a translation table of Latin letters, JVM-side; full Unicode decomposition, which
Spark has no function for, is an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def accent_pairs(last: int = 0x024F) -> tuple[str, str]:
    """Latin letters with a single-letter base and that base, from the Unicode database."""
    old, new = [], []
    for code in range(0xC0, last + 1):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            old.append(chr(code))
            new.append(base)
    return "".join(old), "".join(new)


ACCENTED, PLAIN = accent_pairs()


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def team_key(text: Column) -> Column:
    """Lower case, single spaces; accents stay."""
    return collapsed(F.lower(text))


def plain_key(text: Column) -> Column:
    """Lower case, single spaces, Latin accents off."""
    return collapsed(F.lower(F.translate(text, ACCENTED, PLAIN)))


def folded_key(text: Column) -> Column:
    """The same by full decomposition and case folding, for any script; an Arrow UDF over distinct names only."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        strip = lambda s: " ".join("".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold().split())
        return names.map(lambda s: None if s is None else strip(s))

    return fold(text)


def person_key(text: Column) -> Column:
    """'Last, First' turned round, accents off, anything but letters and digits a space."""
    parts = F.split(text, ",", 2)
    turned = F.when(text.contains(","), F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0))))).otherwise(text)
    return F.trim(F.regexp_replace(plain_key(turned), r"[^\p{L}\p{N}]+", " "))


def token_key(text: Column) -> Column:
    """The words of a person key in order: the same for any order of names."""
    return F.array_join(F.array_sort(F.split(person_key(text), " ")), " ")


def club_key(text: Column, dropped: tuple[str, ...] = ("fc", "cf", "sc", "ac")) -> Column:
    words = F.split(F.trim(F.regexp_replace(plain_key(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*dropped)), " ")


def pair_key(a: Column, b: Column) -> Column:
    """A directed pair; the separator occurs in no name."""
    return F.concat_ws("\u001f", a, b)
