"""Connected components of an edge table as joins and minima; no group meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.registry import written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``edges`` (a, b): label is the least node it reaches.

    Each round takes the least label among the neighbours and then the label of that label.
    Labels are written after each round, so both joins read plain tables and adaptive execution
    can split a hot node.  Loops and repeated edges change nothing; no edges give no rows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = written(step, "labels")
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = written(step.join(roots, "label").select("node", F.col("root").alias("label"), "was"), "labels")
        if not jumped.where("label <> was").limit(1).count():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
