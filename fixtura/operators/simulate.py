"""Monte-Carlo tournaments as relations: one row per simulation and fixture, team or match.

Every draw is a hash of (seed, what is drawn, simulation), so a run is the same on any cluster and in any engine, and
a lost task redraws the same numbers. Simulations spread over the cluster by their number alone.

There are two forms that agree row by row. The relational one (draw_scores, standings, best_thirds) shuffles by
simulation and group. The vectorised one (GroupStage) plays whole simulations in arrays inside a task, with one number
per team that sorts like points, difference and goals, and looks at games only where these tie: no shuffle but that of
the per-team sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions.hashing import draw_uniform, draw_uniforms, hash_uniform, uniform_text
from fixtura.functions.probs import period_outcomes
from fixtura.shared import refuse, small

#: Fixtures of one group stage, which every task holds.
MOST_FIXTURES = 10_000


def cumulative(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, an array of the running sums of p over (h, a), and the width of the matrix, from a long score matrix."""
    ordered = F.sort_array(F.collect_list(F.struct("h", "a", "p")))
    rows = cells.groupBy(*keys).agg(ordered.alias("c"), (F.max("a") + 1).alias("width"))
    sums = F.aggregate("c", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x["p"])))
    return rows.select(*keys, sums.alias("cumulative"), "width")


def draw_scores(fixtures: DataFrame, table: DataFrame, n_sims: int, seed: str, keys: list[str]) -> DataFrame:
    """sim, fixture_id, grp, home, away, home_goals, away_goals: played fixtures keep their score in every simulation,
    others draw a cell of their matrix."""
    rows = fixtures.join(small(table), keys, "left") if keys else fixtures.join(small(table))
    rows = rows.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    rows = rows.withColumn("u", draw_uniform(seed, F.col("sim"), F.col("fixture_id")))
    cell = F.least(F.size(F.filter("cumulative", lambda c: c <= F.col("u"))), F.size("cumulative") - 1)
    rows = rows.withColumn("cell", cell)
    h, a = F.floor(F.col("cell") / F.col("width")).cast("int"), (F.col("cell") % F.col("width")).cast("int")
    return rows.select("sim", "fixture_id", "grp", "home", "away", F.when(F.col("played"), F.col("home_goals")).otherwise(h).alias("home_goals"), F.when(F.col("played"), F.col("away_goals")).otherwise(a).alias("away_goals"))


def sides(scores: DataFrame) -> DataFrame:
    """Two rows per game: team, opponent, points, goal difference, goals."""
    h, a = F.col("home_goals"), F.col("away_goals")
    one = lambda own, other, g, c: F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"), F.when(g > c, 3).when(g == c, 1).otherwise(0).alias("pts"), (g - c).alias("gd"), g.alias("gf"))
    return scores.select("sim", "grp", F.explode(F.array(one("home", "away", h, a), one("away", "home", a, h))).alias("s")).select("sim", "grp", "s.*")


def standings(scores: DataFrame, seed: str) -> DataFrame:
    """sim, grp, team, pts, gd, gf, position: points, goal difference, goals; teams equal on all three by the games
    among themselves, once; then by lot. A tie of a whole group has no narrower games and goes to lots at once."""
    games = sides(scores)
    records = games.groupBy("sim", "grp", "team").agg(F.sum("pts").alias("pts"), F.sum("gd").alias("gd"), F.sum("gf").alias("gf"))
    tie = Window.partitionBy("sim", "grp", "pts", "gd", "gf")
    records = records.withColumn("tied", F.count("*").over(tie))
    tied = records.where("tied > 1").select("sim", "grp", "team", "pts", "gd", "gf")
    other = tied.select("sim", "grp", F.col("team").alias("opponent"), *[F.col(c).alias(f"o_{c}") for c in ("pts", "gd", "gf")])
    among = games.select("sim", "grp", "team", "opponent", F.col("pts").alias("g_pts"), F.col("gd").alias("g_gd"), F.col("gf").alias("g_gf")).join(tied, ["sim", "grp", "team"]).join(other, ["sim", "grp", "opponent"]).where("pts = o_pts and gd = o_gd and gf = o_gf")
    head = among.groupBy("sim", "grp", "team").agg(F.sum("g_pts").alias("h_pts"), F.sum("g_gd").alias("h_gd"), F.sum("g_gf").alias("h_gf"))
    lot = hash_uniform(F.lit(seed), F.lit("lot"), F.col("sim").cast("string"), F.col("team"))
    rows = records.join(head, ["sim", "grp", "team"], "left").withColumn("lot", lot)
    order = Window.partitionBy("sim", "grp").orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), F.desc_nulls_last("h_pts"), F.desc_nulls_last("h_gd"), F.desc_nulls_last("h_gf"), "lot")
    return rows.withColumn("position", F.row_number().over(order)).select("sim", "grp", "team", "pts", "gd", "gf", "tied", "position")


def best_thirds(table: DataFrame, n: int, seed: str) -> DataFrame:
    """The n best third places of each simulation."""
    lot = hash_uniform(F.lit(seed), F.lit("third"), F.col("sim").cast("string"), F.col("team"))
    rows = table.where("position = 3").withColumn("lot", lot)
    order = Window.partitionBy("sim").orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "lot")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("sim", "grp", "team", "place")


def packed_key(pts, gd, gf):
    """One number that sorts like (points, difference, goals), of columns or of arrays."""
    return (pts * 512 + gd + 256) * 512 + gf


class GroupStage:
    """A group stage in arrays: fixtures with their cumulative score tables, and teams by number."""

    def __init__(self, fixtures: DataFrame, table: DataFrame, keys: list[str], seed: str) -> None:
        rows = (fixtures.join(table, keys, "left") if keys else fixtures.join(small(table))).orderBy("fixture_id").limit(MOST_FIXTURES + 1).collect()
        if len(rows) > MOST_FIXTURES:
            raise ValueError(f"more than {MOST_FIXTURES} fixtures")
        self.seed, self.group_type = seed, dict(fixtures.dtypes)["grp"]
        self.teams = sorted({(r["grp"], team) for r in rows for team in (r["home"], r["away"])})
        number = {team: i for i, (_, team) in enumerate(self.teams)}
        self.ids = np.array([r["fixture_id"] for r in rows], dtype=np.int64)
        self.home, self.away = (np.array([number[r[s]] for r in rows], dtype=np.int64) for s in ("home", "away"))
        self.fixed = [(r["home_goals"], r["away_goals"]) if r["played"] else None for r in rows]
        self.tables = [(np.array(r["cumulative"] or [1.0]), r["width"] or 1) for r in rows]
        groups = [g for g, _ in self.teams]
        self.groups = [np.array([i for i, x in enumerate(groups) if x == g]) for g in sorted(set(groups))]

    def scores(self, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goals of both sides, simulations by fixtures."""
        u = draw_uniforms(self.seed, sims, self.ids)
        goals = np.empty((2, *u.shape), dtype=np.int64)
        for j, (fixed, (sums, width)) in enumerate(zip(self.fixed, self.tables, strict=True)):
            if fixed:
                goals[0, :, j], goals[1, :, j] = fixed
            else:
                goals[0, :, j], goals[1, :, j] = divmod(np.minimum(np.searchsorted(sums, u[:, j], side="right"), len(sums) - 1), width)
        return goals[0], goals[1]

    def table(self, sims: np.ndarray) -> dict[str, np.ndarray]:
        """pts, gd, gf, tied, position: simulations by teams."""
        h, a = self.scores(sims)
        pts, gd, gf = (np.zeros((len(sims), len(self.teams)), dtype=np.int64) for _ in range(3))
        for j, (x, y) in enumerate(zip(self.home, self.away, strict=True)):
            d = h[:, j] - a[:, j]
            for team, own, goals in ((x, d, h[:, j]), (y, -d, a[:, j])):
                pts[:, team] += 3 * (own > 0) + (own == 0)
                gd[:, team] += own
                gf[:, team] += goals
        key = packed_key(pts, gd, gf)
        tied, position = np.empty_like(key), np.empty_like(key)
        for members in self.groups:
            own = key[:, members]
            position[:, members] = (own[:, None, :] > own[:, :, None]).sum(axis=2) + 1
            tied[:, members] = (own[:, None, :] == own[:, :, None]).sum(axis=2)
            games = [j for j in range(len(self.ids)) if self.home[j] in members]
            for r in np.flatnonzero((tied[:, members] > 1).any(axis=1)):
                for value in np.unique(own[r][tied[r, members] > 1]):
                    self.break_tie(int(sims[r]), [int(m) for m, k in zip(members, own[r], strict=True) if k == value], games, h[r], a[r], position[r])
        return {"pts": pts, "gd": gd, "gf": gf, "tied": tied, "position": position}

    def break_tie(self, sim: int, teams: list[int], games: list[int], h: np.ndarray, a: np.ndarray, position: np.ndarray) -> None:
        """Places of equal teams: by the games among themselves, once; then by lot."""
        among = {team: [-1, 0, 0] for team in teams}  # no game is less than any
        for j in games:
            x, y, d = int(self.home[j]), int(self.away[j]), int(h[j] - a[j])
            if x in among and y in among:
                for team, own, goals in ((x, d, h[j]), (y, -d, a[j])):
                    own_sums = among[team]
                    own_sums[0] = max(own_sums[0], 0) + (3 if own > 0 else 1 if own == 0 else 0)
                    own_sums[1] += own
                    own_sums[2] += int(goals)
        lot = {team: uniform_text(self.seed, "lot", sim, self.teams[team][1]) for team in teams}
        for i, team in enumerate(sorted(teams, key=lambda team: (*(-v for v in among[team]), lot[team]))):
            position[team] += i

    def best_thirds(self, sims: np.ndarray, table: dict[str, np.ndarray], n: int) -> np.ndarray:
        """Which teams are among the n best third places; lots are drawn only where the last of these ties."""
        key = np.where(table["position"] == 3, packed_key(table["pts"], table["gd"], table["gf"]), -1)
        n = min(n, len(self.groups))
        if not n:
            return np.zeros(key.shape, dtype=bool)
        last = -np.partition(-key, n - 1, axis=1)[:, n - 1 : n]
        chosen = (key >= last) & (key >= 0)
        for r in np.flatnonzero(chosen.sum(axis=1) > n):
            level = np.flatnonzero(key[r] == last[r])
            lots = sorted(level, key=lambda team: uniform_text(self.seed, "third", int(sims[r]), self.teams[team][1]))
            chosen[r, lots[n - int((key[r] > last[r]).sum()) :]] = False
        return chosen


def _slabs(batches: Iterator[pa.RecordBatch], size: int = 2_000) -> Iterator[np.ndarray]:
    for batch in batches:
        sims = batch.column(0).to_numpy()
        for i in range(0, len(sims), size):
            yield sims[i : i + size]


def _sims(spark: SparkSession, n_sims: int) -> DataFrame:
    return spark.range(0, n_sims, 1, max(1, min(n_sims, max(spark.sparkContext.defaultParallelism, n_sims // 50_000))))


def group_tables(spark: SparkSession, stage: GroupStage, n_sims: int) -> DataFrame:
    """standings of every simulation, played in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, teams = zip(*stage.teams, strict=True)
        for sims in _slabs(batches):
            table = stage.table(sims)
            columns = [pa.array(np.repeat(sims, len(teams)), pa.int32()), pa.array(list(groups) * len(sims)), pa.array(list(teams) * len(sims)), *[pa.array(table[c].ravel(), kind) for c, kind in (("pts", pa.int64()), ("gd", pa.int64()), ("gf", pa.int64()), ("tied", pa.int64()), ("position", pa.int32()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["sim", "grp", "team", "pts", "gd", "gf", "tied", "position"])

    return _sims(spark, n_sims).mapInArrow(run, f"sim int, grp {stage.group_type}, team string, pts long, gd long, gf long, tied long, position int")


def group_shares(spark: SparkSession, stage: GroupStage, n_sims: int, thirds: int = 8) -> DataFrame:
    """Per team, how often it ends in each position and among the best thirds, its mean points and the standard error
    of winning its group: simulations are added up in the task that plays them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(stage.teams)), dtype=np.int64)
        for sims in _slabs(batches):
            table = stage.table(sims)
            for k in range(4):
                sums[k] += (table["position"] == k + 1).sum(axis=0)
            sums[4] += table["pts"].sum(axis=0)
            sums[5] += stage.best_thirds(sims, table, thirds).sum(axis=0)
        groups, teams = zip(*stage.teams, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(groups)), pa.array(list(teams)), *[pa.array(v) for v in sums]], names=["grp", "team", "n_1", "n_2", "n_3", "n_4", "points", "thirds"])

    made = _sims(spark, n_sims).mapInArrow(run, f"grp {stage.group_type}, team string, n_1 long, n_2 long, n_3 long, n_4 long, points long, thirds long")
    rows = made.groupBy("grp", "team").agg(*[(F.sum(f"n_{k}") / n_sims).alias(f"p_{k}") for k in range(1, 5)], (F.sum("points") / n_sims).alias("mean_points"), (F.sum("thirds") / n_sims).alias("p_third"))
    return rows.withColumn("se_1", F.sqrt(F.col("p_1") * (1 - F.col("p_1")) / n_sims))


def position_shares(table: DataFrame, n_sims: int) -> DataFrame:
    """Per team, how often it ends in each position, its mean points, and the standard error of winning its group."""
    p = lambda k: F.count_if(F.col("position") == k) / n_sims
    rows = table.groupBy("grp", "team").agg(*[p(k).alias(f"p_{k}") for k in range(1, 5)], F.avg("pts").alias("mean_points"))
    return rows.withColumn("se_1", F.sqrt(F.col("p_1") * (1 - F.col("p_1")) / n_sims))


def share_problems(shares: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Teams whose positions don't sum to one, and groups whose first places don't."""
    team = shares.where(F.abs(F.col("p_1") + F.col("p_2") + F.col("p_3") + F.col("p_4") - 1) > tolerance).select(F.concat(F.lit("team:"), "team").alias("problem"))
    group = shares.groupBy("grp").agg(F.sum("p_1").alias("s")).where(F.abs(F.col("s") - 1) > tolerance).select(F.concat(F.lit("group:"), F.col("grp").cast("string")).alias("problem"))
    return team.union(group)


def pair_resolution(pairs: DataFrame) -> DataFrame:
    """pairs (home, away, home_rate, away_rate, and advance_home or null) with the six ways a tie is decided: in
    regulation, extra time at a third of the rates, or on penalties, for either side. Where an advance probability is
    given, each side's ways are scaled to it. One row per pair of teams, however many simulations there are."""
    rows = pairs.withColumns({"o": period_outcomes(F.col("home_rate"), F.col("away_rate")), "x": period_outcomes(F.col("home_rate") / 3, F.col("away_rate") / 3)})
    draw, late = F.col("o.draw"), F.col("x.draw")
    raw = {"reg_home": F.col("o.win"), "reg_away": F.col("o.loss"), "et_home": draw * F.col("x.win"), "et_away": draw * F.col("x.loss"), "pen_home": draw * late / 2, "pen_away": draw * late / 2}
    rows = rows.withColumns(raw)
    mass = {s: F.col(f"reg_{s}") + F.col(f"et_{s}") + F.col(f"pen_{s}") for s in ("home", "away")}
    wanted = {"home": F.col("advance_home"), "away": 1 - F.col("advance_home")}
    scaled = {f"{k}_{s}": F.when(F.col("advance_home").isNotNull(), F.col(f"{k}_{s}") * wanted[s] / mass[s]).otherwise(F.col(f"{k}_{s}")) for k in ("reg", "et", "pen") for s in ("home", "away")}
    return rows.select(*pairs.columns, *[c.alias(n) for n, c in scaled.items()])


def play_round(ties: DataFrame, resolution: DataFrame, seed: str) -> DataFrame:
    """ties (sim, match, home, away) with winner and how it was decided: one join to the table of pairs."""
    met = ties.join(small(resolution.select("home", "away", "reg_home", "reg_away", "et_home", "et_away", "pen_home", "pen_away")), ["home", "away"])
    u = hash_uniform(F.lit(seed), F.lit("tie"), F.col("sim").cast("string"), F.col("match").cast("string"))
    met = met.withColumn("u", u)
    edges, total = [], F.lit(0.0)
    for c in ("reg_home", "reg_away", "et_home", "et_away", "pen_home", "pen_away"):
        total = total + F.col(c)
        edges.append((total, c))
    way = F.lit(edges[-1][1])
    for edge, c in reversed(edges[:-1]):
        way = F.when(F.col("u") < edge, F.lit(c)).otherwise(way)
    met = met.withColumn("way", way)
    winner = F.when(F.col("way").endswith("home"), F.col("home")).otherwise(F.col("away"))
    return met.select("sim", "match", "home", "away", winner.alias("winner"), F.regexp_extract("way", "^[a-z]+", 0).alias("decided"))


def walk_bracket(first_round: DataFrame, resolution: DataFrame, rounds: int, seed: str) -> DataFrame:
    """All ties of a knockout: first_round (sim, match 0.., home, away) and, after it, winners of matches 2k and 2k+1
    meet as match k of the next round. One join and one small shuffle a round; round counts from 1."""
    ties, out = first_round, None
    for r in range(1, rounds + 1):
        played = play_round(ties.withColumn("match", F.col("match") + r * 1000), resolution, seed).withColumn("match", F.col("match") - r * 1000).withColumn("round", F.lit(r))
        out = played if out is None else out.unionByName(played)
        half = played.select("sim", F.floor(F.col("match") / 2).alias("match"), (F.col("match") % 2).alias("side"), "winner")
        ties = half.groupBy("sim", "match").agg(F.max(F.when(F.col("side") == 0, F.col("winner"))).alias("home"), F.max(F.when(F.col("side") == 1, F.col("winner"))).alias("away"))
    return out


def advancement(walk: DataFrame, n_sims: int, rounds: int) -> DataFrame:
    """Per team, the share of simulations in which it plays in each round, and in which it wins the last."""
    long = walk.select("sim", "round", F.explode(F.array("home", "away")).alias("team"), "winner")
    reach = [(F.count_if(F.col("round") == r) / n_sims).alias(f"p_round_{r}") for r in range(1, rounds + 1)]
    won = (F.count_if((F.col("round") == rounds) & (F.col("winner") == F.col("team"))) / n_sims).alias("p_champion")
    return long.groupBy("team").agg(*reach, won)


def reweighted(cells: DataFrame, keys: list[str], home: str, draw: str, away: str) -> DataFrame:
    """Score matrices whose wins, draws and losses sum to the given columns; inside each the shape stays."""
    region = F.when(F.col("h") > F.col("a"), "home").when(F.col("h") == F.col("a"), "draw").otherwise("away")
    rows = cells.withColumn("region", region)
    masses = rows.groupBy(*keys, "region").agg(F.sum("p").alias("mass"))
    target = F.when(F.col("region") == "home", F.col(home)).when(F.col("region") == "draw", F.col(draw)).otherwise(F.col(away))
    return rows.join(masses, [*keys, "region"]).withColumn("p", F.when(F.col("mass") > 1e-12, F.col("p") * target / F.col("mass")).otherwise(F.lit(0.0))).drop("mass", "region")


def completed_problems(fixtures: DataFrame, active: DataFrame) -> DataFrame:
    """fixture_id and what is wrong with it, for each active result (fixture_id, regulation_home_goals,
    regulation_away_goals) that is not fixed exactly once, with equal goals, among the fixtures (fixture_id, played,
    home_goals, away_goals). A result that is given twice is wrong too."""
    goals = F.struct(F.col("regulation_home_goals").alias("h"), F.col("regulation_away_goals").alias("a"))
    wanted = active.groupBy("fixture_id").agg(F.count("*").alias("given"), F.max(goals).alias("goals"))
    played = F.coalesce("played", F.lit(False))
    same = F.col("home_goals").eqNullSafe(F.col("goals.h")) & F.col("away_goals").eqNullSafe(F.col("goals.a"))
    sides = fixtures.select("fixture_id", played.alias("played"), "home_goals", "away_goals", F.lit(True).alias("there"))
    met = wanted.join(sides, "fixture_id", "left").groupBy("fixture_id").agg(
        F.max("given").alias("given"),
        F.count_if("played").alias("fixed"),
        F.count_if(F.col("there") & ~F.col("played")).alias("open"),
        F.count_if(F.col("played") & ~same).alias("differ"),
    )
    rules = F.array_compact(F.array(
        F.when(F.col("given") > 1, "given_twice"),
        F.when(F.col("fixed") == 0, "missing"),
        F.when(F.col("fixed") > 1, "repeated"),
        F.when(F.col("open") > 0, "not_fixed"),
        F.when(F.col("differ") > 0, "goals_differ"),
    ))
    return met.select("fixture_id", F.array_join(rules, ";").alias("problems")).where("problems <> ''")


def validate_completed(fixtures: DataFrame, active: DataFrame) -> DataFrame:
    """The fixtures that active results fix; an error if one of the results is not fixed exactly once as given."""
    refuse(completed_problems(fixtures, active), "completed overlay mismatch")
    return fixtures.join(active.select("fixture_id"), "fixture_id", "left_semi")
