"""Connected components of a graph held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import saved


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(v, label)`` for every end of ``edges(a, b)``: the smallest id that it reaches.

    Labels take the least of their neighbours' and then their label's label, so
    distances halve each round. Every round is a few joins and partial
    aggregates, and its result is written down.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "v"), "v", "left").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = saved(low.join(hop, "label", "left").select("v", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("v", "label")
        if new.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
