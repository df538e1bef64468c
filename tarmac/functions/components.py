"""Connected components of an edge list by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import stored


def smallest_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, lab``: the smallest node reachable along undirected ``edges`` (a, b), the node's own included.

    Each round takes the smallest label of all neighbours and then the label of that label, so labels
    travel twice as far every round on chains. Rounds are stored.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    label = stored(nodes.select("node", F.col("node").alias("lab")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "lab"), "b").groupBy(F.col("a").alias("node")).agg(F.min("lab").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("lab").alias("old"), F.least("lab", F.coalesce("near", "lab")).alias("lab"))
        jump = label.select(F.col("node").alias("lab"), F.col("lab").alias("further"))
        new = stored(step.join(jump, "lab").select("node", "old", F.least("lab", "further").alias("lab")), "labels")
        if new.filter("lab <> old").isEmpty():
            return new.select("node", "lab")
        label = new.select("node", "lab")


def ranked(values: DataFrame, name: str) -> DataFrame:
    """``values`` (one column, distinct) with their position in sorted order, from 0, as ``name``: ranges are
    numbered in their tasks and shifted by the sizes of the ranges before, one row a partition."""
    col = values.columns[0]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = stored(values.repartitionByRange(F.col(col)).sortWithinPartitions(col).select(col, F.spark_partition_id().alias("_part"), at.alias("_at")), "ranks")
    sizes = sorted(tuple(r) for r in part.groupBy("_part").agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    shift = part.sparkSession.createDataFrame(before, "_part int, _before long")
    return part.join(F.broadcast(shift), "_part").select(col, (F.col("_before") + F.col("_at")).alias(name))
