"""Connected components of a table of links, by the smallest node.

Each round every node takes the least label of its neighbours, then the label of its label (pointer jumping), so
long chains close in few rounds. Tables are written between rounds, which cuts the lineage and lets the joins split a
hot node; labels of a node are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component for each node that occurs in links (a, b), with the component's smallest node; a table of the scratch."""
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct()
    both = scratch.written(both, "links")
    labels = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")).withColumnRenamed("u", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("l").alias("lv")), "v").select(F.col("u").alias("node"), F.col("lv").alias("l"))
        least = scratch.written(seen.union(labels.select("node", "l")).groupBy("node").agg(F.min("l").alias("l")), "labels")
        up = least.select(F.col("node").alias("up"), F.col("l").alias("lu"))
        jumped = scratch.written(least.join(up, least["l"] == up["up"], "left").select("node", F.least("l", F.coalesce("lu", "l")).alias("l")), "labels")
        now = jumped.select(F.col("node").alias("n2"), F.col("l").alias("l2"))
        changed = labels.join(now, labels["node"] == now["n2"]).where(F.col("l") != F.col("l2")).limit(1).count()
        scratch.drop(labels, least)
        labels = jumped
        if not changed:
            scratch.drop(both)
            return labels.select("node", F.col("l").alias("component"))
