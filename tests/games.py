"""Made-up matches, and ratings of them by a plain loop."""

import random

from pyspark.sql import functions as F


def matches(spark, n=120, seed=3):
    rnd = random.Random(seed)
    teams = [f"t{i}" for i in range(6)]
    rows = []
    for k in range(n):
        h, a = rnd.sample(teams, 2)
        hs, s = rnd.randint(0, 4), rnd.randint(0, 4)
        outcome = "home_win" if hs > s else "away_win" if hs < s else "draw"
        rows.append((k, k, f"2020-{1 + k // 28 % 12:02d}-{1 + k % 28:02d}", h, a, rnd.choice(["Friendly", "Cup qualification", "Cup"]), rnd.choice([True, False, None]), "played", hs, s, outcome))
    df = spark.createDataFrame(rows, "match_id long, source_row long, date string, home_team string, away_team string, tournament string, neutral boolean, status string, home_score int, away_score int, outcome string")
    return df.withColumn("date", F.col("date").cast("date")), rows


def plain_elo(rows):
    state, out = {}, {}
    for k, _, date, h, a, cup, neutral, _, hs, s, outcome in sorted(rows, key=lambda r: (r[2], r[1])):
        own, other = state.get(h, 1500.0), state.get(a, 1500.0)
        expected = 1 / (1 + 10 ** (-(own + (0 if neutral else 60) - other) / 400))
        weight = 20 * (0.5 if cup == "Friendly" else 1.25 if "qualification" in cup else 1.0)
        gd = abs(hs - s)
        weight *= 1 if gd <= 1 else 1.5 if gd == 2 else (11 + gd) / 8
        delta = weight * ({"home_win": 1, "draw": 0.5, "away_win": 0}[outcome] - expected)
        state[h], state[a] = own + delta, other - delta
        out[k] = (own, other, delta)
    return out, state
