"""Connected components by repeated smallest labels and pointer jumping, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns id, component (the smallest id in reach) of every id in a link (stored).

    Each round takes the smallest label among a node's neighbours and then the label of that label;
    minima combine before the shuffle, so a node with very many links costs little. Repeated links and links of
    an id with itself change nothing; links with a null end join nothing; no links give no rows."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy("id").agg(F.min("other").alias("component")).select("id", F.least("id", "component").alias("component")))
    while True:
        # Merge joins: nothing passes through the driver, however small a round's tables are.
        near = both.join(labels.withColumnRenamed("id", "other").hint("merge"), "other").groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        # Roots learn from their members, then members take their root's label.
        told = lower.groupBy(F.col("old").alias("id")).agg(F.min("low").alias("told"))
        roots = lower.join(told.hint("merge"), "id", "left").select("id", F.least("low", F.coalesce("told", "low")).alias("low"), "old")
        jump = roots.select(F.col("id").alias("low"), F.col("low").alias("root"))
        root = F.least("low", F.coalesce("root", "low"))
        new = cut_lineage(roots.join(jump.hint("merge"), "low", "left").select("id", root.alias("component"), (root < F.col("old")).alias("moved")))
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels
