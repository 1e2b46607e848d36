"""Connected components of a table of links, in joins and aggregates with the labels written out each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import settle


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b). Each round takes the least label around
    a node and then its label's label, so labels travel twice as far every round. Minima are combined before they
    are dealt, and links stay a plain join side, so a node with very many links is split. No links give no rows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = settle(both, "edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        seen = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        nearest = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        ahead = labels.select(F.col("node").alias("near"), F.col("component").alias("ahead"))
        moved = settle(nearest.join(ahead, "near").select("node", F.least("near", "ahead").alias("component"), "old"), "labels")
        changed = moved.where("component <> old").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
