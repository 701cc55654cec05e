"""Connected components of undirected links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.session import stage_table


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the smallest node it can reach.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so distances shrink fast. Labels are written to the
    shared folder each round. A node with very many links is pre-aggregated.
    """
    a, b = F.col("a"), F.col("b")
    apart = links.select(a, b).where(a != b)
    # every node is its own neighbour, so that one aggregate sees its label, too
    both = stage_table(
        apart.union(apart.select(b, a)).union(apart.select(a, a.alias("b"))).union(apart.select(b.alias("a"), b)).distinct(), "links")
    labels = stage_table(both.groupBy(a.alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(a.alias("node")).agg(
            F.min("label").alias("new"), F.max(F.when(a == b, F.col("label"))).alias("old"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("over"))
        done = stage_table(near.join(up, "new", "left").select("node", "old", F.least("new", F.coalesce("over", "new")).alias("label")), "labels")
        labels = done.select("node", "label")
        if done.where("old <> label").isEmpty():
            return labels
