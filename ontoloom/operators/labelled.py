"""Closures over labelled edges (source, target, property) and class-expression queries.

The label "is_a" stands for subclassing.  A composition table (first, last,
result) says which label a path of two labels has; labels without a row don't
compose, so their paths end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.session import settle

IS_A = "is_a"


def compositions(properties: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(first, last, result) from (property, transitive) and chains (p, q, result); is_a is neutral on both sides."""
    names = properties.select("property").where(F.col("property") != IS_A).distinct()
    p = F.col("property")
    out = names.select(F.lit(IS_A).alias("first"), p.alias("last"), p.alias("result")).union(names.select(p, F.lit(IS_A), p))
    out = out.union(properties.where("transitive").select(p, p, p))
    if chains is not None:
        out = out.union(chains.select("p", "q", "result"))
    neutral = properties.sparkSession.range(1).select(F.lit(IS_A), F.lit(IS_A), F.lit(IS_A))
    return out.union(neutral).distinct()


def labelled_closure(edges: DataFrame, table: DataFrame) -> DataFrame:
    """(source, target, property, distance): composed edges with their shortest distance, semi-naive from the left."""
    edges = settle(edges.select("source", "target", "property").where("source is not null and target is not null").distinct(), "labelled")
    table = settle(table, "compositions")  # one row a pair of properties
    step = edges.select(F.col("source").alias("_mid"), F.col("target").alias("_to"), F.col("property").alias("last"))
    found = new = settle(edges.withColumn("distance", F.lit(1).cast("long")), "labelled")
    hops = 1
    while True:
        hops += 1
        longer = new.join(step, F.col("target") == F.col("_mid")).join(table.withColumnRenamed("first", "property"), ["property", "last"])
        longer = longer.select("source", F.col("_to").alias("target"), F.col("result").alias("property")).distinct()
        new = settle(longer.join(found, ["source", "target", "property"], "left_anti").withColumn("distance", F.lit(hops).cast("long")), "labelled")
        if new.isEmpty():
            return found
        found = settle(found.union(new), "labelled")


def with_super_properties(closed: DataFrame, sub_property: DataFrame) -> DataFrame:
    """Adds every edge under the super-properties of its label; sub_property is a closure (source, target)."""
    up = sub_property.where("source <> target").select(F.col("source").alias("property"), F.col("target").alias("_p"))
    more = closed.join(up, "property").select("source", "target", F.col("_p").alias("property"), "distance")
    return closed.select("source", "target", "property", "distance").union(more).groupBy("source", "target", "property").agg(F.min("distance").alias("distance"))


def only_properties(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges whose property is in wanted (property); is_a always stays."""
    listed = edges.where(F.col("property") != IS_A).join(wanted.select("property").distinct(), "property", "left_semi")
    return edges.where(F.col("property") == IS_A).select("source", "target", "property").union(listed.select("source", "target", "property"))


def without_properties(edges: DataFrame, unwanted: DataFrame) -> DataFrame:
    return edges.join(unwanted.select("property").distinct(), "property", "left_anti").select("source", "target", "property")


def members(expression, closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (node) under a class expression.

    "id" (it and its is_a descendants), ("and", x, y...), ("or", x, y...),
    ("not", x) (the other nodes), ("some", property, x) (nodes with such an
    edge to a member of x).  closed comes from labelled_closure().
    """
    if isinstance(expression, str):
        below = closed.where((F.col("property") == IS_A) & (F.col("target") == expression)).select(F.col("source").alias("node"))
        return below.union(nodes.select("node").where(F.col("node") == expression)).distinct()
    kind, *rest = expression
    if kind == "some":
        inner = members(rest[1], closed, nodes).withColumnRenamed("node", "target")
        return closed.where(F.col("property") == rest[0]).join(inner, "target", "left_semi").select(F.col("source").alias("node")).distinct()
    found = [members(x, closed, nodes) for x in rest]
    if kind == "not":
        return nodes.select("node").distinct().join(found[0], "node", "left_anti")
    out = found[0]
    for other in found[1:]:
        if kind == "and":
            out = out.join(other, "node", "left_semi")
        elif kind == "or":
            out = out.union(other).distinct()
        else:
            raise ValueError(f"unknown expression: {kind}")
    return out
