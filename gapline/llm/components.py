"""Connected components of a graph held in Spark: smallest label, with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.runtime import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id reached) of every node of edges (a, b).

    A round takes the smallest label of the neighbours and then the label's own label,
    so long chains take few rounds. Each round is written; nothing goes to the driver
    but whether labels changed.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        new = cut_lineage(new)
        up = new.select(F.col("id").alias("up"), F.col("label").alias("top"))
        jumped = cut_lineage(new.join(up, new["label"] == up["up"]).select("id", F.least("label", "top").alias("label"), "was"))
        labels = jumped.select("id", "label")
        if jumped.where("label <> was").isEmpty():
            return labels
