"""Probability columns: normalisation, flips, odds, strength maps, bounded shifts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(x: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def normalised(p: Sequence[Column]) -> list[Column]:
    """Parts over their sum; an error if one is negative or all are next to nothing."""
    clipped = [F.greatest(c, F.lit(0.0)) for c in p]
    total = sum(clipped[1:], clipped[0])
    wrong = F.greatest(*[(c < -1e-9).cast("int") for c in p]) == 1
    return [F.when(wrong | (total <= 1e-12), F.raise_error(F.lit("not a probability vector")).cast("double")).otherwise(c / total) for c in clipped]


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Total variation."""
    parts = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return 0.5 * sum(parts[1:], parts[0])


def advance_from_outcome(p: Sequence[Column], tiebreak: Column | float = 0.5) -> tuple[Column, Column]:
    return p[0] + tiebreak * p[1], p[2] + (1 - tiebreak) * p[1]


def implied(odds: Column) -> Column:
    """1 / odds; null for odds that are none (1 or less)."""
    return F.when(odds > 1, 1 / odds)


def proportional(p: Sequence[Column]) -> list[Column]:
    total = sum(p[1:], p[0])
    return [c / total for c in p]


def power_exponent(p: Column, steps: int = 60) -> Column:
    """k with sum of p**k = 1 for an array of implied probabilities, by bisection in the row itself."""
    total = lambda k: F.aggregate(p, F.lit(0.0), lambda s, x: s + F.pow(x, k))
    start = F.struct(F.lit(1e-6).alias("lo"), F.lit(1000.0).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        return let(middle, lambda k: F.when(total(k) > 1, F.struct(k.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), k.alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def power_margin(p: Column) -> Column:
    """The array raised to power_exponent, normalised: favours favourites where a margin was taken."""
    raised = let(power_exponent(p), lambda k: F.transform(p, lambda x: F.pow(x, k)))
    return let(raised, lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda s, y: s + y)))


def logit_shift(p: Column, points: Column, scale: float = 400.0) -> Column:
    q = clamp(p, 1e-9, 1 - 1e-9)
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + F.log(F.lit(10.0)) * points / scale)))


def bounded(base: Column, moved: Column, cap: float) -> Column:
    return clamp(moved, F.greatest(F.lit(0.0), base - cap), F.least(F.lit(1.0), base + cap))


def shift_outcome(p: Sequence[Column], points: Column, cap: float = 0.12, scale: float = 400.0) -> list[Column]:
    """Odds of a win moved by points of a rating, at most by cap; the draw stays."""
    decisive = p[0] + p[2]
    moved = bounded(p[0], decisive * logit_shift(p[0] / decisive, points, scale), cap)
    home = F.when((decisive <= 0) | (points == 0), p[0]).otherwise(moved)
    return [home, p[1], decisive - home]


def shift_advance(p: Column, points: Column, cap: float = 0.12, scale: float = 400.0) -> Column:
    return F.when(points == 0, p).otherwise(bounded(p, logit_shift(p, points, scale), cap))


def centred(x: Column) -> Column:
    """0-100 to [-1, 1] around 50; 0 for none."""
    return F.coalesce(clamp((x - 50) / 50, -1.0, 1.0), F.lit(0.0))


def shrunk_rate(wins: Column, losses: Column, strength: float = 6.0) -> Column:
    """Wins shrunk to one half; null only if both counts are."""
    w, n = F.coalesce(wins, F.lit(0.0)), F.coalesce(wins, F.lit(0.0)) + F.coalesce(losses, F.lit(0.0))
    return F.when(wins.isNotNull() | losses.isNotNull(), (w + 0.5 * strength) / (n + strength))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def period_sums(most: int):
    """The function behind period_outcomes: two arrays of rates to win, draw and loss."""

    def sums(home: pa.Array, away: pa.Array) -> pa.Array:
        a, b = (np.array(r.to_numpy(zero_copy_only=False), dtype=float) for r in (home, away))
        with np.errstate(all="ignore"):
            x, y = np.exp(-a), np.exp(-b)
            fewer_x, fewer_y, win, draw, loss = (np.zeros(len(a)) for _ in range(5))
            for k in range(1, most + 2):
                win += x * fewer_y
                draw += x * y
                loss += y * fewer_x
                fewer_x += x
                fewer_y += y
                x, y = x * a / k, y * b / k
        none = np.isnan(a) | np.isnan(b)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=none) for v in (win, draw, loss)], ["win", "draw", "loss"])

    return sums


def period_outcomes(a: Column, b: Column, most: int = 40) -> Column:
    """win, draw, loss of a period with Poisson goals at these rates, as a struct, in one fold over the goals.

    Each step holds the chances that either side has k goals, which follow from those of k - 1, and their running sums:
    a side wins with k goals if the other has fewer. Goals beyond `most` are left out. The fold runs over arrays of
    many rows at once, so it can't stand inside a lambda."""
    return F.arrow_udf(period_sums(most), "win double, draw double, loss double")(a.cast("double"), b.cast("double"))


def skellam_outcomes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Win, draw, loss; where more than one is used, make period_outcomes a column of its own first."""
    made = period_outcomes(a, b)
    return made["win"], made["draw"], made["loss"]
