"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Links ``(a, b)`` to ``(node, component)``, the smallest node reachable; nodes without a link don't appear.

    Each round every node takes the smallest label among its neighbours, then its label's label, so long chains shrink by
    powers. Rounds end when no label changes. Labels are written each round; only the count of changes reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both.where("a <> b"), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    changed = labels.limit(1).count()
    while changed:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = hooked.join(target, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("next", "component")).alias("component")
        )
        stored = materialise(jumped, "labels")
        changed = stored.where("old <> component").limit(1).count()
        labels = stored.select("node", "component")
    return labels
