"""Connected components by smallest label, in DataFrames: neighbours' minimum, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import removed, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label's label, so a
    chain of n links needs about log n rounds. Labels are written to the shared folder every round; what a round
    was made from goes once it is done, the last labels stay. Null nodes link nothing; no links give no rows.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = low.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = written(new, "labels")
        removed(labels)
        labels = new
        if new.where("was <> component").isEmpty():
            removed(both)
            return new.select("node", "component")
