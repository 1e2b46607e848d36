"""Independent probability signals: market, squad, form, venue, context, experts, knockout survival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.functions import probs
from fixtura.operators.models import davidson


def usable_quotes(odds: DataFrame) -> DataFrame:
    """Quotes whose prices are all above 1 (no draw price makes a two-way market)."""
    return odds.where("odds_a > 1 and odds_b > 1 and (odds_draw is null or odds_draw > 1)")


def rejected_quotes(odds: DataFrame) -> DataFrame:
    return odds.where("not (odds_a > 1 and odds_b > 1 and (odds_draw is null or odds_draw > 1))")


def latest_quotes(odds: DataFrame, key: str = "match_key") -> DataFrame:
    """The latest quote per key by its time as text; the later row of equals."""
    order = Window.partitionBy(key).orderBy(F.desc("quoted_at"), F.desc("row_id"))
    return odds.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def market_signal(quotes: DataFrame, method: str = "proportional") -> DataFrame:
    """p0, p1, p2 (null for two-way markets), advance_a and overround of every quote."""
    a, d, b = (probs.implied(F.col(c)) for c in ("odds_a", "odds_draw", "odds_b"))
    if method == "proportional":
        total = a + F.coalesce(d, F.lit(0.0)) + b
        rows = quotes.withColumns({"q0": a / total, "q1": d / total, "q2": b / total})
    elif method == "power":
        array = F.array_compact(F.array(a, d, b))
        rows = quotes.withColumn("q", probs.power_margin(array))
        two = F.size("q") == 2
        rows = rows.withColumns({"q0": F.get("q", F.lit(0)), "q1": F.when(~two, F.get("q", F.lit(1))), "q2": F.when(two, F.get("q", F.lit(1))).otherwise(F.get("q", F.lit(2)))})
    else:
        raise ValueError(f"unknown method {method}")
    three = F.col("q1").isNotNull()
    overround = a + F.coalesce(d, F.lit(0.0)) + b - 1
    return rows.select(*quotes.columns, *[F.when(three, F.col(f"q{k}")).alias(f"p{k}") for k in range(3)], (F.col("q0") + 0.5 * F.coalesce("q1", F.lit(0.0))).alias("advance_a"), overround.alias("overround"))


def weighted_score(table: DataFrame, key: str, weights: dict[str, tuple[float, bool]]) -> DataFrame:
    """key and score: weighted mean of the standardised indicators a row has; an indicator that hardly varies, or
    that fewer than two rows have, counts for nothing. weights: column -> (weight, larger is better)."""
    moments = table.agg(*[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))])
    rows = table.join(F.broadcast(moments))
    top, bottom = F.lit(0.0), F.lit(0.0)
    for c, (w, good) in weights.items():
        used = F.col(c).isNotNull() & (F.col(f"n_{c}") >= 2) & (F.col(f"s_{c}") > 1e-9)
        z = (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") * (1.0 if good else -1.0)
        top, bottom = top + F.when(used, w * z).otherwise(0.0), bottom + F.when(used, w).otherwise(0.0)
    return rows.select(key, (top / F.nullif(bottom, F.lit(0.0))).alias("score"))


def strength_signal(pairs: DataFrame, scores: DataFrame, key: str, points: float = 60.0) -> DataFrame:
    """pairs (home, away) with p0..p2 from the difference of their scores; null where one has none."""
    side = lambda s: scores.select(F.col(key).alias(s), F.col("score").alias(f"{s}_score"))
    met = pairs.join(side("home"), "home", "left").join(side("away"), "away", "left")
    p = davidson((F.col("home_score") - F.col("away_score")) * points, F.lit(1.0))
    return met.withColumns({f"p{k}": c for k, c in enumerate(p)})


def venue_points(travel: float = 8.0, rest: float = 6.0, zone: float = 3.0) -> Column:
    """Rating points for side a; a comparison counts only with both sides' values."""
    zero = F.lit(0.0)
    parts = [
        F.coalesce("host_boost", zero),
        F.coalesce("crowd_advantage", zero),
        -F.coalesce("heat_disadvantage_a", zero),
        F.coalesce(travel * (F.col("travel_km_b") - F.col("travel_km_a")) / 1000, zero),
        F.coalesce(rest * (F.col("rest_days_a") - F.col("rest_days_b")), zero),
        F.coalesce(zone * (F.col("timezone_shift_b") - F.col("timezone_shift_a")), zero),
    ]
    return sum(parts[1:], parts[0])


def context_points(columns: list[str], component_cap: float = 25.0, total_cap: float = 60.0) -> Column:
    """Late evidence: each component capped, their sum capped; missing ones count 0."""
    parts = [probs.clamp(F.coalesce(F.col(c), F.lit(0.0)), -component_cap, component_cap) for c in columns]
    return probs.clamp(sum(parts[1:], parts[0]), -total_cap, total_cap)


def expert_consensus(predictions: DataFrame, key: str) -> DataFrame:
    """Mean of the forecasts of a match weighted by confidence (null: 1, clipped to [0, 1], at least 1e-6), combined on the map side."""
    w = F.greatest(probs.clamp(F.coalesce("confidence", F.lit(1.0)), 0.0, 1.0), F.lit(1e-6))
    rows = predictions.withColumn("w", w)
    means = rows.groupBy(key).agg(*[(F.sum(F.col("w") * F.col(f"p{k}")) / F.sum("w")).alias(f"m{k}") for k in range(3)], F.count("*").alias("n_sources"))
    total = F.col("m0") + F.col("m1") + F.col("m2")
    return means.select(key, *[(F.col(f"m{k}") / total).alias(f"p{k}") for k in range(3)], "n_sources")


@dataclass(frozen=True)
class Survival:
    """Coefficients of the knockout survival signal (fixed values of the product configuration)."""

    base_goals: float = 2.6
    least_goals: float = 1.2
    most_goals: float = 3.6
    edge_per_advance: float = 1.6
    low_block: float = 0.7
    compactness: float = 0.5
    sterile_goals: float = 0.4
    transition_goals: float = 0.3
    creation: float = 0.3
    block_edge: float = 0.45
    sterile_edge: float = 0.30
    transition_edge: float = 0.30
    set_piece_edge: float = 0.30
    shootout_beta: float = 0.10
    shootout_cap: float = 0.12
    prior_strength: float = 6.0
    current_weight: float = 0.7
    history_weight: float = 0.3
    most_shift: float = 0.15
    tag_threshold: float = 0.2


CURRENT_RATINGS = {"penalty_strength": 1.0, "keeper_penalty_strength": 1.0, "penalty_taker_depth": 0.7, "tournament_experience": 0.4, "manager_continuity": 0.2}
HISTORIES = {"shootout": 0.5, "world_cup_shootout": 1.0, "continental_shootout": 0.7}


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are there; null if none is."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return top / F.nullif(bottom, F.lit(0.0))


def shootout_rating(side: str = "", s: Survival = Survival()) -> Column:
    """Present strength and shrunk record of a side (columns prefixed with side) in [-1, 1]."""
    col = lambda c: F.col(f"{side}{c}")
    current = weighted_mean([(F.when(col(c).isNotNull(), probs.centred(col(c))), w) for c, w in CURRENT_RATINGS.items()])
    past = weighted_mean([(2 * probs.shrunk_rate(col(f"{h}_wins"), col(f"{h}_losses"), s.prior_strength) - 1, w) for h, w in HISTORIES.items()])
    return weighted_mean([(current, s.current_weight), (past, s.history_weight)])


def shootout_favourite(favourite: Column, underdog: Column, s: Survival = Survival()) -> Column:
    gap = F.coalesce(favourite, F.lit(0.0)) - F.coalesce(underdog, F.lit(0.0))
    return 0.5 + probs.clamp(s.shootout_beta * gap, -s.shootout_cap, s.shootout_cap)


def goal_split(total: Column, skill: Column) -> tuple[Column, Column]:
    """Goal rates of favourite and underdog: half the total each, times e to the plus and minus skill."""
    half = F.greatest(total, F.lit(0.1)) / 2
    return F.greatest(half * F.exp(skill), F.lit(0.05)), F.greatest(half * F.exp(-skill), F.lit(0.05))


def staged_advance(total: Column, skill: Column, shootout: Column) -> Column:
    """The favourite's chance through regulation, extra time at a third of the rates, and a shootout."""
    a, b = goal_split(total, skill)
    o, x = probs.period_outcomes(a, b), probs.period_outcomes(a / 3, b / 3)
    return o["win"] + o["draw"] * (x["win"] + x["draw"] * shootout)


def survival_inputs(s: Survival = Survival()) -> dict[str, Column]:
    """Expressions over columns fav_* and und_* (styles 0-100), fav_rating, und_rating and p_fav."""
    n = lambda c: F.greatest(probs.centred(F.col(c)), F.lit(0.0))
    goals = s.base_goals - s.low_block * n("und_low_block_defense") - s.compactness * n("und_defensive_compactness") - s.sterile_goals * n("fav_sterile_possession_risk") + s.transition_goals * n("und_transition_threat") + s.creation * n("fav_chance_creation")
    block = n("fav_struggles_vs_low_block") * n("und_low_block_defense")
    set_piece = F.greatest((probs.centred(F.col("und_set_piece_threat")) + probs.centred(F.col("und_aerial_threat"))) / 2, F.lit(0.0))
    base = s.edge_per_advance * (F.col("p_fav") - 0.5) * 2
    skill = base - s.block_edge * block - s.sterile_edge * n("fav_sterile_possession_risk") - s.transition_edge * n("und_transition_threat") - s.set_piece_edge * set_piece
    return {
        "goals": probs.clamp(goals, s.least_goals, s.most_goals),
        "skill_base": base,
        "skill": F.greatest(skill, F.lit(0.0)),
        "block": block,
        "sterile": n("fav_sterile_possession_risk"),
        "transition": n("und_transition_threat"),
        "set_piece": set_piece,
        "shootout": shootout_favourite(F.col("fav_rating"), F.col("und_rating"), s),
    }


def knockout_survival(df: DataFrame, s: Survival = Survival()) -> DataFrame:
    """df (see survival_inputs) with shift, p_final and tags. Without evidence (column evidence false) all three are
    null: the signal abstains and a blend does without it."""
    rows = df.withColumns(survival_inputs(s))
    moved = staged_advance(F.lit(s.base_goals), F.col("skill_base"), F.lit(0.5)) - staged_advance(F.col("goals"), F.col("skill"), F.col("shootout"))
    a, b = goal_split(F.col("goals"), F.col("skill"))
    rows = rows.withColumns({"shift": probs.clamp(moved, -s.most_shift, s.most_shift), "draw": probs.period_outcomes(a, b)["draw"]})
    t = s.tag_threshold
    tags = F.array_compact(
        F.array(
            F.when(F.col("block") >= t * t, "low_block_survival_path"),
            F.when(F.col("sterile") >= t, "favorite_sterile_possession_risk"),
            F.when(F.col("transition") >= t, "transition_threat"),
            F.when(F.col("set_piece") >= t, "set_piece_underdog_path"),
            F.when((F.abs(F.col("shootout") - 0.5) >= 0.01) & (F.col("draw") >= 0.20), "penalty_path_boost"),
        )
    )
    out = {"shift": F.when(F.col("evidence"), F.col("shift")), "p_final": F.when(F.col("evidence"), probs.clamp(F.col("p_fav") - F.col("shift"), 0.02, 0.98)), "tags": F.when(F.col("evidence"), F.array_join(tags, "|"))}
    return rows.select(*df.columns, "goals", "skill", "shootout", *[c.alias(n) for n, c in out.items()])


def base_advance(*anchors: Column) -> Column:
    """The first anchor that is there: historical, market, squad; else one half."""
    return F.coalesce(*anchors, F.lit(0.5))
