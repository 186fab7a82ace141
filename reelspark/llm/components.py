"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.

    Each round gives a node the least label beside it and then that label's own label, so chains shorten by more
    than half a round. Every round is a written table: lost executors cost no more than a round.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().where("a <> b"), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), F.col("a").alias("old"), "label"), "labels")
    while True:
        beside = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.drop("old").join(beside, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = written(lower, "labels")
        jumped = lower.alias("x").join(lower.select(F.col("node").alias("to"), F.col("label").alias("far")), F.col("label") == F.col("to"), "left")
        nxt = written(jumped.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        discard(labels, lower)
        if nxt.where("label <> old").isEmpty():
            discard(both)
            return nxt.select("node", "label")
        labels = nxt
