"""Connected components of link tables, with every step a join or an aggregate over the whole cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.shared import materialise, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); the component is its smallest node.

    Every round takes the smallest label among a node's neighbours and then the label of that label, so paths
    shorten geometrically; a round that changes nothing is the last. Each round is written to the shared folder, the
    one before it is deleted; nothing but one flag reaches the driver. Nulls and loops in links are ignored; an empty
    table gives an empty result.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = materialise(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").head(1):
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        low = materialise(low, "low")
        above = low.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = low.join(above, "component").select("node", F.col("top").alias("component"), (F.col("top") != F.col("was")).alias("changed"))
        before, labels = labels, materialise(jumped, "labels")
        release(before, low)
    release(edges)
    return labels.select("node", "component")
