"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_sized, release


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b).

    Every round each node takes the least label among its neighbours', then
    the label of that label, so that chains shorten by more than half.  Labels
    are aggregated before they are shuffled and hubs' labels go out by
    broadcast, as does what many nodes have as their label, so that neither a
    node with very many edges nor a large component is a hot spot.  Each round
    is checkpointed; nothing comes to the driver but numbers of rows.  After ``rounds``, if given, labels may still be several in
    a component, but never one in two.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"), F.count(F.lit(1)).alias("degree")))
    done = 0
    while True:
        heard = join_sized(both, labels.withColumnRenamed("node", "b"), ["b"], "degree").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node").select("node", "degree", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        lower = cut(lower)
        sizes = lower.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        jump = cut(lower.select(F.col("node").alias("component"), F.col("component").alias("next")).join(sizes, "component"))
        after = cut(join_sized(lower, jump, ["component"], "size").select("node", "degree", "before", F.col("next").alias("component")))
        labels = after.select("node", "component", "degree")
        release(edges.sparkSession)
        done += 1
        if done == rounds or not after.where("before <> component").limit(1).count():
            return labels.select("node", "component")
