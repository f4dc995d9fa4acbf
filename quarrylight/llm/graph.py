"""Connected components over edges of any orderable node type, without ever collecting nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (u, v); the component is the smallest node that can be reached.

    Smallest labels go to neighbours, and each label then jumps to its own label, so a chain halves in
    each round. Hubs are pre-aggregated by groupBy, and rows that share a hub are split by Spark's
    skewed join. Each round is written to the shared folder. Nulls are no nodes."""
    pairs = edges.select("u", "v").dropna()
    both = materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels_now = materialise(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        discard(labels)
        if not labels_now.filter(F.col("label") != F.col("old")).head(1):
            discard(both)
            return labels_now.select("node", F.col("label").alias("component"))
        labels = labels_now
