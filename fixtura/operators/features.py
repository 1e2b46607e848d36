"""Rolling features over strictly earlier matches of a team.

History rows are ordered by (date, source_row). Everything a row may see lies before it, so one shuffle by team and
one sort serve all features of a team's rows, in one pass that keeps only what later rows can still see.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fixtura.functions.parse import competitive
from fixtura.operators.temporal import asof_join
from fixtura.shared import settle, small

ORDER = ("date", "source_row")


@dataclass(frozen=True)
class FormSettings:
    windows: tuple[int, ...] = (3, 5, 10)
    half_life_days: int = 365
    congestion_days: tuple[int, ...] = (7, 14, 30)
    long_gap_days: int = 365
    longest_gap_days: int = 1825
    sequence_days: int = 60
    goals_per_match: float = 2.6
    split: float = 1.0
    excluded: tuple[str, ...] = ("friendly",)


def team_history(matches: DataFrame, timeline: DataFrame) -> DataFrame:
    """Two rows per played match, one from each side: a single join and one explode, no second scan."""
    return both_sides(matches.where("status = 'played'").join(timeline, "match_id"))


def both_sides(both: DataFrame) -> DataFrame:
    """The history of played matches that have their ratings."""
    points = lambda win, loss: F.when(F.col("outcome") == win, 3).when(F.col("outcome") == "draw", 1).when(F.col("outcome") == loss, 0)

    def side(own: str, other: str, home: bool) -> Column:
        expected = F.col("expected_home") if home else 1 - F.col("expected_home")
        return F.struct(
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(home).alias("is_home"),
            F.col(f"{own}_score").alias("goals_for"),
            F.col(f"{other}_score").alias("goals_against"),
            F.col(f"{own}_elo_pre").alias("elo_own"),
            F.col(f"{other}_elo_pre").alias("elo_opp"),
            expected.alias("expected"),
            (points("home_win", "away_win") if home else points("away_win", "home_win")).alias("points"),
        )

    sides = F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")
    return both.select("match_id", "date", "source_row", "tournament", sides).select("match_id", "date", "source_row", "tournament", "s.*")


def split_goals(expected: Column, settings: FormSettings = FormSettings()) -> tuple[Column, Column]:
    """Goals per match shared out by strength: expected for and against."""
    e = F.greatest(F.least(expected, F.lit(1 - 1e-9)), F.lit(1e-9))
    share = F.pow(e, settings.split) / (F.pow(e, settings.split) + F.pow(1 - e, settings.split))
    return settings.goals_per_match * share, settings.goals_per_match * (1 - share)


def rolling_form(history: DataFrame, settings: FormSettings = FormSettings()) -> DataFrame:
    """match_id, is_home and the features of that side before the match.

    Rows are sorted by team and time, and streamed through in Arrow batches. What is kept of a team are its last rows, its
    counts of the last days and its running sums, however long its history is (windows would hold all of it, once each)."""
    goals_for, goals_against = split_goals(F.col("expected"), settings)
    actual = F.when(F.col("points") == 3, 1.0).when(F.col("points") == 1, 0.5).otherwise(0.0)
    day = F.datediff("date", F.lit("2000-01-01").cast("date"))
    ordered = history.select("match_id", "is_home", "team", *ORDER, "tournament", "points", "goals_for", "goals_against", "expected").repartition("team").sortWithinPartitions("team", *ORDER)
    values = {
        "points": F.col("points"),
        "winrate": F.col("points") == 3,
        "gf_per_match": F.col("goals_for"),
        "ga_per_match": F.col("goals_against"),
        "gd_per_match": F.col("goals_for") - F.col("goals_against"),
        "clean_sheet_rate": F.col("goals_against") == 0,
        "fts_rate": F.col("goals_for") == 0,
        "opp_adj_points": actual - F.col("expected"),
        "attack_resid": F.col("goals_for") - goals_for,
        "defense_resid": F.col("goals_against") - goals_against,
        # The factor of the current day cancels between numerator and denominator: one pass, not a self-join.
        "weight": F.pow(F.lit(2.0), day / settings.half_life_days),
    }
    rows = ordered.select("match_id", "is_home", "team", "tournament", day.alias("day"), F.coalesce(competitive(F.col("tournament"), settings.excluded), F.lit(False)).alias("comp"), *[c.cast("double").alias(n) for n, c in values.items()])
    kinds = {"n_prior": T.IntegerType(), "tournament_seq": T.LongType()} | {f"matches_prev_{n}d": T.LongType() for n in settings.congestion_days}
    keys = [rows.schema[c] for c in ("match_id", "is_home", "team")]
    schema = T.StructType([*keys, *[T.StructField(n, kinds.get(n, T.DoubleType())) for n in form_names(settings)]])
    return rows.mapInArrow(form_stream(settings, list(values)[:-1]), schema)


def form_names(settings: FormSettings) -> list[str]:
    widest = settings.windows[-1]
    means = ("winrate", "gf_per_match", "ga_per_match", "gd_per_match", "clean_sheet_rate", "fts_rate", "opp_adj_points", "attack_resid", "defense_resid")
    return [
        "n_prior",
        *[f"ppm_last{w}" for w in settings.windows],
        *[f"{n}_last{widest}" for n in means],
        f"gd_volatility_last{widest}",
        "recency_wpoints",
        f"ppm_comp_last{widest}",
        "days_since_prev",
        "long_inactivity",
        *[f"matches_prev_{n}d" for n in settings.congestion_days],
        "days_since_prev_competitive",
        "tournament_seq",
        "form_available",
    ]


#: Stands for a missing date: earlier than any, as it is sorted, and out of reach of any.
NO_DAY = -(1 << 31)


def form_stream(settings: FormSettings, names: list[str]):
    """The pass of rolling_form over rows in order of team and time; names are the columns that are averaged."""
    widest, deepest = settings.windows[-1], max(settings.windows)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teams, tournaments = Codes(), Codes(keep=True)
        prior, prior_comp = Places(), Places()
        last_day, last_comp_day, last_comp_mean = Latest(), Latest(), Latest()
        by_team, by_tournament = RecentDays(max(settings.congestion_days, default=0)), RecentDays(settings.sequence_days)
        tail, tail_seen = np.zeros((len(names), deepest)), np.zeros((len(names), deepest), bool)
        comp_tail, comp_seen = np.zeros((1, widest)), np.zeros((1, widest), bool)
        sums, run_before = np.zeros(4), -1
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            run = teams.runs(batch.column("team"))
            day = pc.fill_null(batch.column("day"), NO_DAY).to_numpy(zero_copy_only=False).astype(np.int64)
            dated, comp = day > NO_DAY, batch.column("comp").to_numpy(zero_copy_only=False)
            tail, tail_seen = np.concatenate([tail, np.stack([filled(batch, c) for c in names])], axis=1), np.concatenate([tail_seen, np.stack([present(batch, c) for c in names])], axis=1)
            points, seen = tail[0, -n:], tail_seen[0, -n:]
            place = prior.of(run)
            out: list[tuple[np.ndarray, np.ndarray | None]] = [(place.astype(np.int32), None)]
            out += [mean(*trailing(tail[:1], tail_seen[:1], place, w))[0] for w in settings.windows]
            out += mean(*trailing(tail[1:], tail_seen[1:], place, widest))
            gd = names.index("gd_per_match")
            out.append(deviation(tail[gd], tail_seen[gd], place, widest))

            # Running sums, in the order of the rows: weighed points and weights, and how many of each are known.
            weight = filled(batch, "weight")
            terms = np.stack([np.where(seen & dated, points * weight, 0), np.where(dated, weight, 0), seen & dated, dated])
            starts = np.flatnonzero(np.diff(run, prepend=run_before))
            before = np.empty((4, n))
            for a, b in zip([0, *starts[starts > 0]], [*starts[starts > 0], n], strict=True):
                grown = np.cumsum(np.concatenate([(sums if run[a] == run_before else np.zeros(4))[:, None], terms[:, a:b]], axis=1), axis=1)
                before[:, a:b], sums, run_before = grown[:, :-1], grown[:, -1], run[a]
            known = (before[2] > 0) & (before[3] > 0)
            out.append((before[0] / np.where(known, before[1], 1), known))

            # Competitive rows are a sequence of their own; other rows look back for the latest of their means.
            at = np.flatnonzero(comp)
            comp_tail, comp_seen = np.concatenate([comp_tail, points[None, at]], axis=1), np.concatenate([comp_seen, seen[None, at]], axis=1)
            found, has = mean(*trailing(comp_tail, comp_seen, prior_comp.of(run[at]), widest, current=True))[0]
            comp_mean, has_mean = np.zeros(n), np.zeros(n, bool)
            comp_mean[at], has_mean[at] = found, has
            out.append(last_comp_mean.before(comp_mean, has_mean, run))

            previous, met = last_day.before(day, np.ones(n, bool), run)
            rested = met & dated & (previous > NO_DAY)
            gap = day - previous
            out += [(np.minimum(gap, settings.longest_gap_days).astype(float), rested), ((gap > settings.long_gap_days).astype(float), rested)]
            out += [(c, None) for c in by_team.earlier(run, run, day, settings.congestion_days)]
            previous, met = last_comp_day.before(day, comp & dated, run)
            out.append(((day - previous).astype(float), met & dated))
            same = (run << 32) + tournaments.codes(batch.column("tournament"))
            out.append((1 + by_tournament.earlier(run, same, day, [settings.sequence_days])[0], None))
            out.append(((place >= 1).astype(float), None))

            tail, tail_seen, comp_tail, comp_seen = tail[:, -deepest:], tail_seen[:, -deepest:], comp_tail[:, -widest:], comp_seen[:, -widest:]
            columns = [pa.array(x, mask=None if ok is None else ~ok) for x, ok in out]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("match_id", "is_home", "team")], *columns], ["match_id", "is_home", "team", *form_names(settings)])

    return stream


def filled(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name), 0.0).to_numpy(zero_copy_only=False)


def present(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).is_valid().to_numpy(zero_copy_only=False)


def trailing(x: np.ndarray, seen: np.ndarray, place: np.ndarray, w: int, current: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of what is seen in the w rows of a run before each row (or the w up to it), oldest first. x and
    seen begin with the rows before the ones that place is of."""
    n, c = len(place), x.shape[1] - len(place)
    total, count = np.zeros((len(x), n)), np.zeros((len(x), n))
    for lag in range(w - current, -current, -1):
        held = seen[:, c - lag : c - lag + n] & (place >= lag)
        total += np.where(held, x[:, c - lag : c - lag + n], 0)
        count += held
    return total, count


def mean(total: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return list(zip(total / np.maximum(count, 1), count > 0, strict=True))


def deviation(x: np.ndarray, seen: np.ndarray, place: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviation of what is seen in the w rows before each row, where there are two at least."""
    n, c = len(place), len(x) - len(place)
    count, middle, squares = np.zeros(n), np.zeros(n), np.zeros(n)
    for lag in range(w, 0, -1):
        held = seen[c - lag : c - lag + n] & (place >= lag)
        count += held
        off = np.where(held, x[c - lag : c - lag + n] - middle, 0)
        step = off / np.maximum(count, 1)
        middle += step
        squares += off * (off - step)
    return np.sqrt(squares / np.maximum(count, 1)), count > 1


class Codes:
    """Numbers for values, null included: of runs of equal ones, or of the values themselves (keep)."""

    def __init__(self, keep: bool = False) -> None:
        self.known: dict = {}
        self.keep, self.last, self.number = keep, None, -1

    def codes(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        found = np.array([self.known.setdefault(v, len(self.known)) for v in coded.dictionary.to_pylist()], np.int64)
        return found[coded.indices.to_numpy(zero_copy_only=False)]

    def runs(self, column: pa.Array) -> np.ndarray:
        if not self.keep:  # equal values are neighbours, so only the last one can go on
            self.known = {}
        codes, first, last = self.codes(column), column[0].as_py(), column[len(column) - 1].as_py()
        fresh = np.diff(codes, prepend=codes[0]) != 0
        fresh[0] = self.number < 0 or first != self.last
        run = self.number + np.cumsum(fresh)
        self.last, self.number = last, int(run[-1])
        return run


class Places:
    """How many rows of its run are before each row."""

    def __init__(self) -> None:
        self.run, self.count = -1, 0

    def of(self, run: np.ndarray) -> np.ndarray:
        if not len(run):
            return run
        at = np.arange(len(run))
        starts = np.maximum.accumulate(np.where(np.diff(run, prepend=self.run) != 0, at, 0))
        place = at - starts + np.where(run == self.run, self.count, 0)
        self.run, self.count = int(run[-1]), int(place[-1]) + 1
        return place


class Latest:
    """The latest known value of its run before each row."""

    def __init__(self) -> None:
        self.run, self.value = -1, None

    def before(self, value: np.ndarray, known: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_here = np.maximum.accumulate(np.where(known, np.arange(len(run)), -1))
        at = np.concatenate([[-1], to_here[:-1]])
        here = (at >= 0) & (run[at] == run)
        held = ~here & (run == self.run) & (self.value is not None)
        found = np.where(here, value[at], 0 if self.value is None else self.value)
        end = to_here[-1]
        if end >= 0 and run[end] == run[-1]:
            self.value = value[end]
        elif run[-1] != self.run:
            self.value = None
        self.run = int(run[-1])
        return found, here | held


class RecentDays:
    """Numbers of rows by group and day, of the last run and as far back as `reach` days."""

    def __init__(self, reach: int) -> None:
        self.reach, self.run = reach, -1
        self.group = self.day = self.rows = np.zeros(0, np.int64)

    def earlier(self, run: np.ndarray, group: np.ndarray, day: np.ndarray, backs: Sequence[int]) -> list[np.ndarray]:
        """For each of backs and each row, how many rows of its group are before it and at most so many days older."""
        c = len(self.group)
        groups, days, rows = np.concatenate([self.group, group]), np.concatenate([self.day, day]), np.concatenate([self.rows, np.ones(len(group), np.int64)])
        key = (np.unique(groups, return_inverse=True)[1].astype(np.int64) << 35) + days + (1 << 33)
        order = np.argsort(key, kind="stable")
        ordered, before = key[order], np.cumsum(rows[order]) - rows[order]
        out = []
        for n in backs:
            found = np.empty(len(key), np.int64)
            found[order] = before - before[np.searchsorted(ordered, ordered - n)]
            out.append(found[c:])
        stays = np.concatenate([np.full(c, self.run == run[-1]), run == run[-1]]) & (days >= day[-1] - self.reach)
        _, at, of = np.unique(key[stays], return_index=True, return_inverse=True)
        self.run, self.group, self.day, self.rows = int(run[-1]), groups[stays][at], days[stays][at], np.bincount(of, rows[stays], len(at)).astype(np.int64)
        return out


def ranking_features(frame: DataFrame, releases: DataFrame, stale_after: int = 400, unavailable_after: int = 450, lags: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Ranking points of both sides as of the latest release strictly before the match, with momentum against the
    team's own earlier releases, staleness and disagreement with the ratings' favourite."""
    columns = ranking_columns(stale_after, unavailable_after, lags)
    return with_releases(frame, releases_seen(frame, releases, lags), unavailable_after).select("match_id", *[c.alias(n) for n, c in columns.items()])


def releases_seen(frame: DataFrame, releases: DataFrame, lags: tuple[int, ...] = (1, 3)) -> DataFrame:
    """What each team's latest release before each day of its matches says: looked up once a day, not once a match."""
    by_release = Window.partitionBy("team").orderBy("release_date")
    states = releases.withColumns({f"change_{k}": F.col("points") - F.lag("points", k).over(by_release) for k in lags})
    values = ["points", *[f"change_{k}" for k in lags]]
    days = frame.select(F.explode(F.array(*[F.struct(F.col(f"{s}_team").alias("team"), "date") for s in ("home", "away")])).alias("x")).select("x.*").distinct()
    seen = asof_join(days, states, "team", "date", "release_date", values)
    said = F.struct(F.datediff("date", "state_date").alias("age"), "state_date", *values)
    return settle(seen.select(F.col("team").alias("team_"), F.col("date").alias("date_"), said.alias("seen_")), "releases-seen")


def with_releases(frame: DataFrame, seen: DataFrame, unavailable_after: int = 450) -> DataFrame:
    """frame with the structs home_seen and away_seen, and both_ranked."""
    side = small(seen)
    for s in ("home", "away"):
        met = F.col(f"{s}_team").eqNullSafe(F.col("team_")) & F.col("date").eqNullSafe(F.col("date_"))
        frame = frame.join(side, met, "left").withColumnRenamed("seen_", f"{s}_seen").drop("team_", "date_")
    ready = [F.coalesce(F.col(f"{s}_seen.age") <= unavailable_after, F.lit(False)) & F.col(f"{s}_seen.points").isNotNull() for s in ("home", "away")]
    return frame.withColumn("both_ranked", ready[0] & ready[1])


def ranking_columns(stale_after: int = 400, unavailable_after: int = 450, lags: tuple[int, ...] = (1, 3)) -> dict[str, Column]:
    """The ranking features of a row of with_releases."""
    of = lambda s, c: F.col(f"{s}_seen.{c}")
    ready = lambda s: F.coalesce(of(s, "age") <= unavailable_after, F.lit(False))
    both = F.col("both_ranked")
    stale = F.coalesce(of("home", "age") > stale_after, F.lit(False)) | F.coalesce(of("away", "age") > stale_after, F.lit(False))
    when_ok = lambda c: F.when(both, c)
    difference = of("home", "points") - of("away", "points")
    leaning, ranked = F.signum(F.col("home_elo_pre") - F.col("away_elo_pre")), F.signum(difference)
    return {
        "fifa_available": both.cast("double"),
        "fifa_stale": stale.cast("double"),
        **{f"{s}_fifa_points": when_ok(of(s, "points")) for s in ("home", "away")},
        **{f"{s}_days_since_fifa_release": F.when(ready(s), of(s, "age")) for s in ("home", "away")},
        **{f"{s}_fifa_release_date": F.when(ready(s), of(s, "state_date")) for s in ("home", "away")},
        "fifa_points_diff": when_ok(difference),
        "fifa_release_age_days": when_ok(F.greatest(of("home", "age"), of("away", "age"))),
        **{f"{s}_fifa_points_change_{k}": when_ok(of(s, f"change_{k}")) for s in ("home", "away") for k in lags},
        "favorite_disagree": when_ok(((leaning != 0) & (ranked != 0) & (leaning != ranked)).cast("double")),
    }


def venue_features(frame: DataFrame) -> DataFrame:
    return frame.select("match_id", *[c.alias(n) for n, c in venue_columns().items()])


def venue_columns() -> dict[str, Column]:
    neutral = F.coalesce("neutral", F.lit(False))
    country = F.trim(F.coalesce("country", F.lit("")))
    known = country != ""
    home = (~neutral & known & (F.lower(country) == F.lower(F.trim("home_team")))).cast("double")
    away = (known & (F.lower(country) == F.lower(F.trim("away_team")))).cast("double")
    return {"is_neutral": neutral.cast("double"), "home_at_home_country": home, "away_at_home_country": away, "host_indicator": F.greatest(home, away), "venue_known": known.cast("double")}


def match_frame(matches: DataFrame, timeline: DataFrame) -> DataFrame:
    """Canonical rows as model rows; label -1 where the outcome is unknown, no home advantage on neutral ground."""
    label = F.when(F.col("outcome") == "home_win", 0).when(F.col("outcome") == "draw", 1).when(F.col("outcome") == "away_win", 2).otherwise(-1)
    neutral = F.coalesce("neutral", F.lit(False))
    frame = matches.where("status = 'played'").join(timeline, "match_id").withColumn("neutral", neutral)
    return frame.withColumns({"elo_diff": F.col("home_elo_pre") - F.col("away_elo_pre"), "home_adv": (~F.col("neutral")).cast("double"), "label": label})


def feature_table(matches: DataFrame, timeline: DataFrame, releases: DataFrame, settings: FormSettings = FormSettings(), places: int | None = None) -> DataFrame:
    """The wide table: one row per played match, both sides' form, rankings and venue; doubles to so many places, if given.

    Played matches are written out once, as all parts read them; only the form is joined by match, the rest is looked up or
    computed in the row. Each part is finished in its own stage: one step for all columns would be a method too long for
    the JVM to compile, and run interpreted."""
    frame = settle(match_frame(matches, timeline), "frame")
    form = rounded(rolling_form(both_sides(frame), settings).drop("team"), places)
    names = [c for c in form.columns if c not in ("match_id", "is_home")]
    # The two sides meet as one struct each: dealt once and as they are, not as rows of twice the columns.
    side = lambda home: F.max(F.when(F.col("is_home") == home, F.struct(*names)))
    wide = form.repartition("match_id").groupBy("match_id").agg(side(True).alias("home_form"), side(False).alias("away_form"))
    ranks, venue = ranking_columns(), venue_columns()
    own = with_releases(frame, releases_seen(frame, releases)).select(*frame.columns, *[c.alias(n) for n, c in (ranks | venue).items()])
    own = rounded(own.withColumns({"abs_elo_diff": F.abs("elo_diff"), "abs_elo_fifa_disagreement": F.abs(F.abs("fifa_points_diff") - F.abs("elo_diff"))}), places)
    rest = F.col("home_form.days_since_prev") - F.col("away_form.days_since_prev")
    sides = [F.col(f"{s}_form.{c}").alias(f"{s}_{c}") for s in ("home", "away") for c in names]
    return own.repartition("match_id").join(wide, "match_id", "left").select(*frame.columns, *sides, *ranks, *venue, "abs_elo_diff", rest.alias("rest_days_diff"), "abs_elo_fifa_disagreement")


def rounded(df: DataFrame, places: int | None) -> DataFrame:
    return df if places is None else df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})
