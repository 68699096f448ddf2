"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.checkpoint import saved


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (src, dst).

    Each round takes the least label among a node's neighbours and then its
    label's own label, so paths halve; every round is written out.  Nodes
    without edges don't appear; null ends are ignored.
    """
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    both = saved(edges.union(edges.select("dst", "src")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("best"))
        root = labels.select(F.col("node").alias("at"), F.col("component").alias("root"))
        new = met.join(root, met.best == root["at"], "left").select("node", F.col("component").alias("old"), F.least("best", F.coalesce("root", "best")).alias("component"))
        new = saved(new, "labels")
        labels = new.select("node", "component")
        if not new.filter("old <> component").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
