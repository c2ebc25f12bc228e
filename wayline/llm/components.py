"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm._common import forget, materialize


def components(links: DataFrame) -> DataFrame:
    """Of (a, b) links, every linked node with the smallest node that it reaches: node, component.

    Each round gives a node the smallest label next to it, then the label of its label; labels only fall, and the
    rounds grow as the logarithm of the longest path. Every round is written, so none is computed twice.
    """
    both = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jumped = lower.join(labels.select(F.col("node").alias("to"), F.col("component").alias("beyond")), "to")
        after = materialize(jumped.select("node", F.least("to", "beyond").alias("component"), (F.least("to", "beyond") < F.col("was")).alias("fell")), "labels")
        forget(labels)
        labels = after
        if after.filter("fell").isEmpty():
            forget(both)
            return labels.select("node", "component")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more (a, b) links: only the components that the links join are gone through again."""
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct()
    every = labels.unionAll(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    end = lambda c: every.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    roots = components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialize(every.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
