"""Reachability over edge tables (source, target): closures, walks from seeds, roots, reduction, components, common subsumers.

Edges point from a class to its parent.  Null ends are ignored, repeated edges
count once.  Whole closures double their paths each round, so a chain of depth d
takes log2(d) rounds; walks from seeds touch only what the seeds reach, take
several steps a round, and double their steps where they are long.  Every round
writes what it found anew to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.plans.session import settle

#: Steps of a walk in one round, and rounds before jumps are doubled.
HOPS, SHORT = 8, 3


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").where("source is not null and target is not null").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(source, target, distance): every pair linked by a path of one edge or more, with the shortest distance.

    After a round all pairs up to distance `reach` are known.  A pair up to twice
    as far has a middle at distance `reach` from its source, so only pairs of
    that distance are joined with the known ones.
    """
    parts, reach = [settle(clean(edges).withColumn("distance", F.lit(1).cast("long")), "closure")], 1
    while True:
        known = reduce(DataFrame.union, parts)
        far = parts[-1].where(F.col("distance") == reach).select("source", F.col("target").alias("_mid"))
        onward = known.select(F.col("source").alias("_mid"), "target", (F.col("distance") + reach).alias("distance"))
        longer = far.join(onward, "_mid").groupBy("source", "target").agg(F.min("distance").alias("distance"))
        new = settle(longer.join(known, ["source", "target"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        parts.append(new)
        reach *= 2


def _hops(front: DataFrame, step: DataFrame, n: int) -> DataFrame:
    """(seed, node, distance) of one to n steps (_at, _to) from front, with the least distance, in one plan."""
    now, out = front, []
    for _ in range(n):
        now = now.join(step, F.col("node") == F.col("_at")).select("seed", F.col("_to").alias("node"), (F.col("distance") + 1).alias("distance")).distinct()
        out.append(now)
    return reduce(DataFrame.union, out).groupBy("seed", "node").agg(F.min("distance").alias("distance"))


def _jumps(step: DataFrame) -> DataFrame:
    """(_at, _to, hops) of one to HOPS steps."""
    ends = step.select(F.col("_at").alias("seed"), F.col("_to").alias("node"), F.lit(1).cast("long").alias("distance"))
    more = ends.union(_hops(ends, step, HOPS - 1)) if HOPS > 1 else ends
    every = more.groupBy("seed", "node").agg(F.min("distance").alias("hops"))
    return settle(every.select(F.col("seed").alias("_at"), F.col("node").alias("_to"), "hops"), "jumps")


def _grown(step: DataFrame, front: DataFrame) -> DataFrame:
    """(seed, node, distance): all that front (seed, node, distance 0) reaches by one step or more.

    A round takes HOPS steps in one plan.  Walks longer than SHORT rounds go on
    with jumps that double their reach, so that a chain of depth d takes log2(d) rounds.
    """
    parts, done, reach, jumps = [], 0, HOPS, None
    while True:
        if len(parts) < SHORT:
            new = _hops(front, step, HOPS)
        else:
            if jumps is None:
                jumps = _jumps(step)
            else:
                far = jumps.where(F.col("hops") == reach).select("_at", F.col("_to").alias("_mid"))
                onward = jumps.select(F.col("_at").alias("_mid"), "_to", (F.col("hops") + reach).alias("hops"))
                longer = far.join(onward, "_mid").groupBy("_at", "_to").agg(F.min("hops").alias("hops"))
                jumps = jumps.union(settle(longer.join(jumps, ["_at", "_to"], "left_anti"), "jumps"))
                reach *= 2
            new = front.join(jumps, F.col("node") == F.col("_at")).groupBy("seed", F.col("_to").alias("node")).agg(F.min(F.col("distance") + F.col("hops")).alias("distance"))
        if parts:
            new = new.join(reduce(DataFrame.union, parts), ["seed", "node"], "left_anti")
        parts.append(settle(new.select("seed", "node", F.col("distance").cast("long").alias("distance")), "walk"))
        done += reach if jumps is not None else HOPS
        front = parts[-1].where(F.col("distance") == done)
        if front.isEmpty():
            return reduce(DataFrame.union, parts)


def _steps(edges: DataFrame, down: bool) -> DataFrame:
    here, there = ("target", "source") if down else ("source", "target")
    return settle(clean(edges).select(F.col(here).alias("_at"), F.col(there).alias("_to")), "steps")


def walk(edges: DataFrame, seeds: DataFrame, down: bool = False) -> DataFrame:
    """(seed, node, distance): all that seeds (node) reach by one edge or more, upwards or down; a seed on a cycle reaches itself."""
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("distance")).where("node is not null").distinct()
    return _grown(_steps(edges, down), settle(front, "walk"))


def reached(edges: DataFrame, seeds: DataFrame, down: bool = False) -> DataFrame:
    """(node): seeds (node) and all that they reach; a node is expanded once, whichever seed reaches it."""
    front = settle(seeds.select(F.lit("").alias("seed"), "node", F.lit(0).cast("long").alias("distance")).where("node is not null").distinct(), "reached")
    return front.select("node").union(_grown(_steps(edges, down), front).select("node")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).where("node is not null").distinct()


def reflexive(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """The closure with every node linked to itself at distance 0."""
    closed = closed if closed is not None else closure(edges)
    own = nodes(edges).select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).cast("long").alias("distance"))
    return closed.where("source <> target").union(own)


def _one(edges: DataFrame, node) -> DataFrame:
    kind = edges.schema["source"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(node,)], f"node {kind}")


def ancestors(edges: DataFrame, node) -> DataFrame:
    return walk(edges, _one(edges, node)).select("node", "distance")


def descendants(edges: DataFrame, node) -> DataFrame:
    return walk(edges, _one(edges, node), down=True).select("node", "distance")


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return nodes(edges).join(clean(edges).select(F.col("source").alias("node")).distinct(), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes(edges).join(clean(edges).select(F.col("target").alias("node")).distinct(), "node", "left_anti")


def neighbours(edges: DataFrame) -> DataFrame:
    """Per node its number of direct parents and children."""
    up = clean(edges).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_parents"))
    down = clean(edges).groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return up.join(down, "node", "full").select("node", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path implies.

    Only sources with several parents can have such edges, so only their parents are walked from.
    """
    edges = settle(clean(edges), "reduction")
    several = edges.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("source")
    doubtful = edges.join(several, "source", "left_semi")
    above = walk(edges, doubtful.select(F.col("target").alias("node"))).select(F.col("seed").alias("mid"), F.col("node").alias("target"))
    implied = doubtful.withColumnRenamed("target", "mid").join(above, "mid").select("source", "target")
    return edges.join(implied, ["source", "target"], "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both ways, which all those of a cycle have."""
    n = edges.count()
    while n:
        alive = edges.select(F.col("source").alias("node")).intersect(edges.select("target"))
        for end in ("source", "target"):
            edges = edges.join(alive.withColumnRenamed("node", end), end, "left_semi")
        edges = settle(edges.select("source", "target"), "trimmed")
        last, n = n, edges.count()
        if n == last:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches the node, or itself."""
    now = settle(nodes(edges).select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")), "colours")
    while not now.where("moved").isEmpty():
        passed = now.where("moved").select(F.col("node").alias("source"), "colour").join(edges, "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("_c"))
        now = settle(now.join(passed, "node", "left").select("node", F.least("colour", F.coalesce("_c", "colour")).alias("colour"), F.coalesce(F.col("_c") < F.col("colour"), F.lit(False)).alias("moved")), "colours")
    return now.select("node", "colour")


def _cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles of two nodes or more; the component's name is its smallest node.

    Nodes get the colour of the smallest node that reaches them; what reaches
    that node within its colour is its component.  Then the rest goes on.
    """
    left = _trimmed(settle(clean(edges).where("source <> target"), "cycles"))
    found = []
    while not left.isEmpty():
        colour = _coloured(left)
        inside = left.join(colour.toDF("source", "_a"), "source").join(colour.toDF("target", "_b"), "target").where("_a = _b")
        back = reached(inside.select("source", "target"), colour.where("node = colour").select("node"), down=True)
        part = settle(colour.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")), "components")
        found.append(part)
        for end in ("source", "target"):
            left = left.join(part.select(F.col("node").alias(end)), end, "left_anti")
        left = _trimmed(settle(left.select("source", "target"), "cycles"))
    if not found:
        return left.select(F.col("source").alias("node"), F.col("target").alias("component"))
    all_of = reduce(DataFrame.union, found)
    return all_of.join(all_of.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "component", "left_semi").select("node", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable both ways; a node on no cycle is its own component."""
    return nodes(edges).join(_cycles(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    loops = clean(edges).where("source = target").select(F.col("source").alias("node"))
    return _cycles(edges).select("node").union(loops).distinct()


def non_redundant(sets: DataFrame, closed: DataFrame, key: str, item: str) -> DataFrame:
    """Rows (key, item) without items that are proper ancestors of another item of the key."""
    sets = sets.select(key, item).distinct()
    above = sets.join(closed.where("source <> target").select(F.col("source").alias(item), F.col("target").alias("_up")), item).select(key, F.col("_up").alias(item))
    return sets.join(above, [key, item], "left_anti")


def common_subsumers(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """(a, b, subsumer) for pairs (a, b) and a reflexive closure."""
    left = pairs.join(up.select(F.col("source").alias("a"), F.col("target").alias("subsumer")), "a")
    return left.join(up.select(F.col("source").alias("b"), F.col("target").alias("subsumer")), ["b", "subsumer"]).select("a", "b", "subsumer")


def lowest_common_subsumers(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """Common subsumers that aren't proper ancestors of another common subsumer of the pair."""
    common = common_subsumers(pairs, up)
    over = up.where("source <> target").select(F.col("source").alias("subsumer"), F.col("target").alias("_up"))
    above = common.join(over, "subsumer").select("a", "b", F.col("_up").alias("subsumer")).distinct()
    return common.join(above, ["a", "b", "subsumer"], "left_anti")


def subset_map(up: DataFrame, subset: DataFrame) -> DataFrame:
    """(term, slim): each term's most specific ancestors (itself included) in subset (node)."""
    hits = up.join(subset.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("term"), F.col("target").alias("slim"))
    return non_redundant(hits, up, "term", "slim")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, target, side): edges of both ontologies, or of one only."""
    tag = lambda df, c: clean(df).withColumn(c, F.lit(True))
    both = tag(left, "l").join(tag(right, "r"), ["source", "target"], "full")
    return both.select("source", "target", F.when(F.col("l") & F.col("r"), "common").when(F.col("l"), "left").otherwise("right").alias("side"))


def remove_and_bridge(edges: DataFrame, node) -> DataFrame:
    """Edges without node; its children are linked to its parents."""
    edges = clean(edges)
    up = edges.where(F.col("source") == node).select(F.col("source").alias("mid"), "target")
    bridged = edges.where(F.col("target") == node).withColumnRenamed("target", "mid").join(up, "mid").select("source", "target")
    return edges.where((F.col("source") != node) & (F.col("target") != node)).union(bridged).distinct()


def min_distance_rank(closed: DataFrame) -> DataFrame:
    """Ancestors of each source ranked by distance, then id."""
    return closed.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("distance", "target")))
