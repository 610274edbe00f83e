"""Single-linkage clusters of many small graphs at once, by spreading the least label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators.saved import shared_folder


def clusters(nodes: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., node, cluster: the least node that ``edges`` (by..., a, b) connect it with; nodes without edges are alone.
    All graphs take a step together; each step is checkpointed, and the loop ends when no label moves."""
    by = list(by)
    shared_folder(edges.sparkSession)
    both = edges.select(*by, F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(*by, F.col("b"), F.col("a"))).distinct().checkpoint()
    labels = nodes.select(*by, "node").distinct().withColumn("cluster", F.col("node"))
    while True:
        near = both.join(labels.select(*by, F.col("node").alias("other"), F.col("cluster").alias("theirs")), [*by, "other"]).groupBy(*by, "node").agg(F.min("theirs").alias("theirs"))
        moved = labels.join(near, [*by, "node"], "left").select(*by, "node", F.least("cluster", "theirs").alias("next"), "cluster").withColumn("next", F.coalesce("next", "cluster")).checkpoint()
        labels = moved.select(*by, "node", F.col("next").alias("cluster"))
        if moved.where("next <> cluster").isEmpty():
            break
    return labels
