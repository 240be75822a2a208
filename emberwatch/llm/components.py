"""Connected components over links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.storage import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round every node takes the smallest label among its neighbours' and its own,
    then the label of that label, so long chains shorten as they go.  Rounds end when no
    label changes; each one's labels are a written table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.where("a != b").distinct(), "component_edges")
    labels = stage(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("component")),
        "component_labels",
    )
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        parents = labels.select(F.col("node").alias("component"), F.col("component").alias("parent"))
        jumped = stage(
            lowered.join(parents, "component").select(
                "node", "was", F.least("component", "parent").alias("component")
            ),
            "component_labels",
        )
        labels = jumped.select("node", "component")
        if jumped.where("component != was").isEmpty():
            return labels
