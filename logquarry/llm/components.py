"""Connected components of an edge list, as iterated joins over saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tables import drop, save


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Each round gives a node the least label among its own and its neighbours', then follows that label
    to the label's own label; rounds end when nothing changes.  Minimum aggregates combine on the map
    side, so a hub costs no more than its edges.  An empty edge list gives an empty table.
    """
    both = save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*")
        .distinct()
    )
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("component").alias("hop"))
        new = save(
            step.join(far, "to").select(
                "node", F.least("to", "hop").alias("component"), (F.least("to", "hop") < F.col("component")).alias("moved")
            )
        )
        drop(labels)
        labels = new
        if labels.where("moved").limit(1).count() == 0:
            drop(both)
            return labels.select("node", "component")
