"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import discard, materialise


def roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent < node and one row per node -> (node, root), by pointer jumping.

    Every round halves the longest way up, so the rounds end.
    """
    now = materialise(parents.select("node", F.col("parent").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = now.select("node", "root").join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved"))
        last, now = now, materialise(jumped, "roots")
        discard(last)
    return now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any direction -> (node, root): every node that isn't the smallest of its component, and that smallest one.

    Alternating large-star and small-star rounds: each points neighbours at
    the smallest node they know of, until a round changes nothing.  Every round
    that isn't the last brings some node a smaller neighbour, so the rounds end.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = materialise(now, "edges")
    last = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes whose neighbours are all smaller keep their link to the smallest.
        step = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        least = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        discard(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if not state[0] or tuple(state) == last and state[0] == state[2]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(state)
