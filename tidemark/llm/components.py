"""Connected components over an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    edges: long columns a and b, undirected; loops, repeats and nulls are ignored. Each round takes the smallest
    label among a node's neighbours, hooks the node's old label to it as well, and then follows labels twice, so
    that long chains shorten by doubling. Every join has one row per node on one side; the aggregates are partial.
    Rounds are written to the shared folder. Raises if max_rounds don't suffice, rather than return labels too large.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = pairs.union(pairs.select("b", "a")).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(seen, "node").select("node", "component", F.least("near", "component").alias("low"))
        # what a node learnt also holds for the node that its label names
        told = hooked.where("low < component").groupBy(F.col("component").alias("node")).agg(F.min("low").alias("told"))
        step = materialise(hooked.join(told, "node", "left").select("node", "component", F.least("low", "told").alias("low")), "step")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("jumped"))
        new = materialise(step.join(jump, "low", "left").select("node", F.least("low", "jumped").alias("component"), (F.least("low", "jumped") < F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.where("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
