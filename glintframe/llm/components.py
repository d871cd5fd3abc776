"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, salted_join


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for every node of edges (a, b).

    A round takes each node's least label among its neighbours and then that label's own label, so a
    path of n nodes needs about log n rounds. Labels only fall, and rounds go on until none does. They
    are checkpointed each round; nothing is collected but the question whether any label changed. Nodes
    of many edges and labels of many nodes meet over salted keys.
    """
    both = checkpointed(edges.where(F.col("a") != F.col("b")).select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), gathered=True)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = checkpointed(labels, gathered=True)
    while True:
        around = salted_join(both, labels.withColumnRenamed("node", "b"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        taken = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        stepped = checkpointed(salted_join(taken, jump, "mid", "node", how="left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"), gathered=True)
        done = stepped.where(F.col("label") != F.col("old")).isEmpty()
        labels = stepped.select("node", "label")
        if done:
            return labels
