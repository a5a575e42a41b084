"""Forests of trees by intervals: ancestors, distances and lookups without closures.

parse() numbers a tree's nodes by where they end in its text and says where their
brackets open, so a node lies under another if its interval does.  Ancestors are
found level by level: at each level above a node, its ancestor is the first node
that ends after it.  The work is the answer's size, whatever the trees' depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.session import settle


def parse(trees: DataFrame) -> DataFrame:
    """(tree_id, node, begin, level, length, name, duplication) of nested-bracket trees (tree_id, text) with NHX comments.

    A node's interval is begin to node; the root has level 0.  Names are labels, or
    else the comment's ID.  Null and empty texts have no nodes; a name may repeat.
    """
    marks = trees.select("tree_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\(|[^(),;\[\]]*(?:\[[^\]]*\])?[,);])"), 1)).alias("i", "t"))
    order = Window.partitionBy("tree_id").orderBy("i")
    opens = F.col("t") == "("
    # A token names a node; the brackets that stand before it may close a subtree that is the node's own.
    before = F.lag("t").over(order)
    closed = F.coalesce(before.endswith(")"), F.lit(False))
    depth = F.sum(F.when(opens, 1).when(F.col("t").endswith(")"), -1).otherwise(0)).over(order)
    rows = marks.select("*", depth.alias("_after"), closed.alias("_inner")).withColumn("level", F.when(F.col("t").endswith(")"), F.col("_after") + 1).otherwise(F.col("_after")))
    # The bracket that an inner node closes opened last, one level below the node's own.
    last_open = F.last(F.when(F.col("t") == "(", F.col("i")), ignorenulls=True).over(Window.partitionBy("tree_id", "_at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_at", F.when(F.col("t") == "(", F.col("_after")).otherwise(F.col("level") + 1)).withColumn("_open", last_open).where("t <> '('")
    label = F.regexp_extract("t", r"^([^:\[,);]*)", 1)
    length = F.regexp_extract("t", r"^[^:\[]*:([0-9.eE+-]+)", 1)
    name = F.when(label != "", label).otherwise(F.nullif(F.regexp_extract("t", r"[:&]ID=([^:\]]*)", 1), F.lit("")))
    begin = F.when(F.col("_inner"), F.col("_open")).otherwise(F.col("i"))
    return rows.select("tree_id", F.col("i").alias("node"), begin.alias("begin"), F.col("level").cast("int").alias("level"), F.when(length != "", length).cast("double").alias("length"), name.alias("name"), (F.regexp_extract("t", r"[:&](?:D=Y|Ev=1>0)", 0) != "").alias("duplication"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, ancestor, level): all proper ancestors, level being the ancestor's."""
    rows = nodes.select("tree_id", "node", "level")
    asked = rows.where("level > 0").select("tree_id", "node", F.explode(F.expr("sequence(0, level - 1)")).alias("level"))
    both = asked.select("tree_id", "level", "node", F.lit(None).cast("int").alias("_is")).union(rows.select("tree_id", "level", "node", F.col("node").alias("_is")))
    ahead = Window.partitionBy("tree_id", "level").orderBy("node", F.col("_is").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("ancestor", F.first("_is", ignorenulls=True).over(ahead)).where("_is is null")
    return found.select("tree_id", "node", "ancestor", "level")


def depths(nodes: DataFrame) -> DataFrame:
    """nodes with `depth`, the summed length of the way from the root; a missing length counts as 0."""
    up = ancestors(nodes).join(nodes.select("tree_id", F.col("node").alias("ancestor"), F.coalesce("length", F.lit(0.0)).alias("_l")), ["tree_id", "ancestor"])
    over = up.groupBy("tree_id", "node").agg(F.sum("_l").alias("_over"))
    return nodes.join(over, ["tree_id", "node"], "left").withColumn("depth", F.coalesce("_over", F.lit(0.0)) + F.coalesce("length", F.lit(0.0))).drop("_over")


def distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, meet, distance) for pairs (tree_id, a, b) of nodes: where their ways up meet, and the length of the way between them."""
    up = ancestors(nodes).select("tree_id", "node", "ancestor", "level")
    up = settle(up.union(nodes.select("tree_id", "node", F.col("node").alias("ancestor"), "level")), "ways")
    deep = settle(depths(nodes).select("tree_id", "node", "depth"), "depths")
    left = pairs.join(up.select("tree_id", F.col("node").alias("a"), "ancestor", "level"), ["tree_id", "a"])
    both = left.join(up.select("tree_id", F.col("node").alias("b"), "ancestor"), ["tree_id", "b", "ancestor"])
    met = both.groupBy("tree_id", "a", "b").agg(F.max_by("ancestor", "level").alias("meet"))
    for end in ("a", "b", "meet"):
        met = met.join(deep.select("tree_id", F.col("node").alias(end), F.col("depth").alias(f"_{end}")), ["tree_id", end])
    return met.select("tree_id", "a", "b", "meet", (F.col("_a") + F.col("_b") - 2 * F.col("_meet")).alias("distance"))


def relatives(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, tree_id, relative, how) for names (name): the other named leaves of their trees, by whether their ways meet in a duplication."""
    inner = nodes.select("tree_id", F.col("begin").alias("_b"), F.col("node").alias("_e")).where("_b < _e")
    leaves = nodes.where("begin = node and name is not null").select("tree_id", "node", "name")
    asked = leaves.join(names.select("name").distinct(), "name", "left_semi")
    pairs = asked.select("tree_id", F.col("node").alias("a"), F.col("name")).join(leaves.select("tree_id", F.col("node").alias("b"), F.col("name").alias("relative")), "tree_id").where("a <> b")
    pairs = settle(pairs, "relatives")
    met = distances(pairs.select("tree_id", "a", "b"), nodes).select("tree_id", "a", "b", F.col("meet"))
    kinds = nodes.select("tree_id", F.col("node").alias("meet"), "duplication").join(inner.select("tree_id", F.col("_e").alias("meet")), ["tree_id", "meet"], "left_semi")
    out = pairs.join(met, ["tree_id", "a", "b"]).join(kinds, ["tree_id", "meet"])
    return out.select("name", "tree_id", "relative", F.when(F.col("duplication"), "paralogue").otherwise("orthologue").alias("how")).distinct()
