"""Connected components of an edge table by large-star and small-star steps.

Each step sends edges towards the least neighbour; nodes with very many edges are
handled by grouped minima and joins, never as one list in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.store import saved

#: Far above the logarithm of any corpus; each step at least halves the longest path.
MOST_STEPS = 40


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the least node it is connected with."""
    now = saved(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(MOST_STEPS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = saved(small.where("a <> b").distinct())
        last, state = state, _state(now)
        if state == last:
            break
    else:
        raise RuntimeError("components have not settled")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given by at most one parent b < a for each a, by pointer doubling."""
    now = saved(parents.select("a", "b"))
    for _ in range(MOST_STEPS):
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        now = saved(now.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    else:
        raise RuntimeError("a forest of parents has a circle")
    links = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return saved(links.union(links.select(F.col("root").alias("node"), "root").distinct()))
