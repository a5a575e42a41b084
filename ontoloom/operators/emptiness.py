"""Which classes are empty, alone or in contexts, without what classes only inherit.

classify() gives every class the superclasses and links of all that stands above
it.  Emptiness needs little of that.  marked() keeps for a class only those
superclasses that an axiom waits for (marks: members of axioms of two classes,
ends of links that imply something), found by walks down the hierarchy; a link
is followed where it is said, as what it implies is inherited like any other
superclass; and what is empty is reached from the empty class by superclasses
and links.  So the work grows with classes and their marks, not with pairs of
classes.  Contexts that say the same of a class are followed once.

Tables are those of `ontoloom.operators.saturation`, without chains.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import saturation as S
from ontoloom.operators.reasoning import NOTHING
from ontoloom.plans.session import discard, settle

#: After so many rounds a walk's steps are made twice as long.
ROUNDS = 24


@dataclass
class Marked:
    """held (x, m): x is in the mark m; empty (x), the empty class included; leads (x, y): x is empty if y is; edges (x, y): x is in y."""

    held: DataFrame
    marks: DataFrame
    empty: DataFrame
    leads: DataFrame
    edges: DataFrame
    links: DataFrame  # (x, p, y), p with its super-properties
    left: DataFrame  # (p, c, b): what is p some c is in b
    pairs: DataFrame  # (k, need, b): what is in k and need is in b
    supers: DataFrame  # (p, q): q is a super-property of p


def _walk(first: DataFrame, edges: DataFrame, keys: list[str], known: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(x, *keys): first and all x that lead to it by edges (x, y), but not what is known or x that `without` has."""
    columns, parts = ["x", *keys], []
    found, rounds = first.select(*columns).distinct(), 0
    while True:
        seen = [*parts, *([known.select(*columns)] if known is not None else [])]
        if seen:
            found = found.join(S._union(seen), columns, "left_anti")
        if without is not None:
            found = found.join(without.select("x"), "x", "left_anti")
        parts.append(settle(found.select(*columns), "walk"))
        if parts[-1].isEmpty():
            break
        rounds += 1
        if rounds % ROUNDS == 0:
            twice = edges.join(edges.select(F.col("x").alias("y"), F.col("y").alias("_z")), "y").select("x", F.col("_z").alias("y"))
            edges = settle(edges.union(twice).where("x <> y").distinct(), "jumps")
        found = parts[-1].withColumnRenamed("x", "y").join(edges, "y").select(*columns).distinct()
    if len(parts) > 1:
        discard(parts.pop())
    return S._union(parts)


def _turned(both: DataFrame) -> DataFrame:
    """(k, need, b): axioms of two classes looked up by the class that stands in fewer of them."""
    n = both.select(F.explode(F.array("a1", "a2")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    counted = both.join(n.toDF("a1", "_n1"), "a1").join(n.toDF("a2", "_n2"), "a2")
    one = (F.col("_n1") < F.col("_n2")) | ((F.col("_n1") == F.col("_n2")) & (F.col("a1") <= F.col("a2")))
    return counted.select(F.when(one, F.col("a1")).otherwise(F.col("a2")).alias("k"), F.when(one, F.col("a2")).otherwise(F.col("a1")).alias("need"), "b").distinct()


def _by_links(held: DataFrame, links: DataFrame, left: DataFrame, *ctx: str) -> DataFrame:
    """(*ctx, x, b): x has a link whose end is held (*ctx, x, m) to be in a class that left waits for."""
    waiting = held.select(*ctx, F.col("x").alias("y"), F.col("m").alias("c")).join(left, "c").select(*ctx, "y", "p", "b").distinct()
    return waiting.join(links, ["y", "p"]).select(*ctx, "x", "b")


def _wants(held: DataFrame, pairs: DataFrame, *ctx: str) -> DataFrame:
    return held.withColumnRenamed("m", "k").join(pairs, "k").select(*ctx, "x", F.col("need").alias("m"), "b")


def marked(tables: S.Tables, also: DataFrame | None = None) -> Marked:
    """What the axioms say of emptiness; classes of `also` (node) are marks too."""
    tables = S.tidy(tables)
    if "chains" in tables:
        raise ValueError("chains need classify()")
    spark = tables["sub"].sparkSession
    table = lambda k: tables[k] if k in tables else spark.createDataFrame([], ", ".join(f"{c} string" for c in S.COLUMNS[k].split()))
    edges = settle(table("sub").toDF("x", "y").where("x <> y"), "edges")
    links, wider = table("right").toDF("x", "p", "y"), S._wider(tables)
    if wider is not None:
        links = links.union(links.join(wider, "p").select("x", F.col("_q").alias("p"), "y")).distinct()
    supers = table("sub_property").toDF("p", "q").limit(0) if wider is None else wider.withColumnRenamed("_q", "q")
    links, left, pairs = settle(links, "links"), table("left").toDF("p", "c", "b"), settle(_turned(table("both")), "pairs")
    marks = [left.select("c"), pairs.select("k"), pairs.select("need"), *([also.select("node")] if also is not None else [])]
    marks = settle(S._union([m.toDF("m") for m in marks]).na.drop().where(F.col("m") != NOTHING).distinct(), "marks")
    seeds = marks.select(F.col("m").alias("x"), "m")
    told = settle(_by_links(seeds, links, left).distinct(), "facts")
    edges = edges.union(told.toDF("x", "y")).where("x <> y")
    new, old = _walk(seeds, edges, ["m"]), None
    while True:
        out = [_by_links(new, links, left), _wants(new, pairs).join(new if old is None else new.union(old), ["x", "m"]).select("x", "b")]
        if old is not None:
            out.append(_wants(old, pairs).join(new, ["x", "m"]).select("x", "b"))
        more = settle(S._union(out).toDF("x", "y").where("x <> y").distinct().join(edges, ["x", "y"], "left_anti"), "facts")
        edges = edges.union(more)
        old = new if old is None else old.union(new)
        first = more.where(F.col("y") != NOTHING).join(old.select(F.col("x").alias("y"), "m"), "y").select("x", "m")
        new = _walk(first, edges, ["m"], old)
        if new.isEmpty():
            break
    edges = settle(edges.distinct(), "edges")
    leads = settle(edges.union(links.select("x", "y")).where("x <> y").distinct(), "leads")
    empty = _walk(spark.range(1).select(F.lit(NOTHING).alias("x")), leads, [])
    return Marked(settle(old.join(empty, "x", "left_anti"), "held"), marks, empty, leads, edges, links, left, pairs, supers)


def _held_in(known: Marked, classes: DataFrame) -> DataFrame:
    """(x, m): what is in the classes (m), marks or not."""
    other = settle(classes.join(known.marks, "m", "left_anti"), "classes")
    held = known.held.join(classes, "m", "left_semi").select("x", "m")
    return held if other.isEmpty() else held.union(_walk(other.select(F.col("m").alias("x"), "m"), known.edges, ["m"], without=known.empty))


def _in_contexts(known: Marked, first: DataFrame, spread: bool) -> tuple[DataFrame, DataFrame]:
    """(ctx, x) that are empty, but not always, and (ctx, x, m) held, by facts `first` (ctx, x, b): in ctx, x is in b too.

    The x of first are given with all classes under them.  Without spread, x are
    said of a context's own names: nothing stands under them or has links to them.
    """
    facts = settle(first.select("ctx", "x", "b").join(known.empty, "x", "left_anti").distinct(), "facts")
    never, every, gone, held = known.empty.withColumnRenamed("x", "b"), [], [], None
    while True:
        gone.append(facts.join(never, "b", "left_semi").select("ctx", "x"))
        every.append(facts.join(never, "b", "left_anti").select("ctx", "x", "b"))
        new = every[-1].join(known.held.withColumnRenamed("x", "b"), "b").select("x", "ctx", "m")
        if held is not None and spread:
            new = new.union(S._union(every).join(held.withColumnRenamed("x", "b"), ["ctx", "b"]).select("x", "ctx", "m"))
            new = _walk(new, known.edges, ["ctx", "m"], held, known.empty)
        elif held is not None:
            new = new.distinct().join(held, ["x", "ctx", "m"], "left_anti")
        new = settle(new.distinct().join(known.held, ["x", "m"], "left_anti").select("x", "ctx", "m"), "held")
        if new.isEmpty():
            held = new if held is None else held
            break
        of, wants = new if held is None else new.union(held), _wants(new, known.pairs, "ctx")
        out = [wants.join(known.held, ["x", "m"]), wants.join(of, ["ctx", "x", "m"]), _wants(known.held, known.pairs).join(new, ["x", "m"])]
        if held is not None:
            out.append(_wants(held, known.pairs, "ctx").join(new, ["ctx", "x", "m"]))
        if spread:
            out.append(_by_links(new, known.links, known.left, "ctx").join(known.empty, "x", "left_anti"))
        found = S._union([df.select("ctx", "x", "b") for df in out]).distinct()
        facts = settle(found.join(S._union([*every, *[g.withColumn("b", F.lit(NOTHING)) for g in gone]]), ["ctx", "x", "b"], "left_anti"), "facts")
        held = of
    more = settle(S._union(gone).distinct(), "gone")
    if not spread:
        return more, held
    said, found = S._union(every), None
    while True:
        new = _walk(more, known.leads, ["ctx"], found, known.empty)
        found = new if found is None else found.union(new)
        # What is in a class that is empty in the context alone.
        ends = settle(said.select("ctx", "b").distinct().join(new.withColumnRenamed("x", "b"), ["ctx", "b"], "left_semi"), "ends")
        if ends.isEmpty():
            return found.select("ctx", "x"), held
        more = said.join(ends, ["ctx", "b"], "left_semi").select("x", "ctx")


def _said_by(known: Marked, property_: str, held: DataFrame, empty: DataFrame) -> DataFrame:
    """(x, b): what is property_ some x is in b; held (x, m) and empty (x) are what is known of x."""
    above = known.left.join(known.supers.where(F.col("p") == property_).select(F.col("q").alias("p")).union(known.left.sparkSession.range(1).select(F.lit(property_))).distinct(), "p", "left_semi")
    return held.withColumnRenamed("m", "c").join(above, "c").select("x", "b").union(empty.select("x", F.lit(NOTHING))).distinct()


def _alike(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, ctx): one of the x with the same b for each x, and (ctx, b), for said (x, b)."""
    sets = settle(said.groupBy("x").agg(F.array_sort(F.collect_set("b")).alias("_b")), "alike")
    first = settle(sets.groupBy("_b").agg(F.min("x").alias("ctx")), "contexts")
    return settle(sets.join(first, "_b").select("x", "ctx"), "names"), first.select("ctx", F.explode("_b").alias("b"))


def outside(known: Marked, contexts: DataFrame, property_: str, root: str, only: bool = True) -> DataFrame:
    """(ctx, node): what `saturation.outside` gives, by marks."""
    ctx = settle(contexts.select(F.col("node").alias("x")).na.drop().distinct(), "contexts")
    if not only:
        within = _held_in(known, ctx.withColumnRenamed("x", "m")).select(F.col("x").alias("y"), F.col("m").alias("ctx"))
        linked = known.links.where(F.col("p") == property_).join(within, "y").select("x", "ctx")
        return _walk(linked, known.leads, ["ctx"], without=known.empty).select("ctx", F.col("x").alias("node"))
    under = settle(_held_in(known, ctx.sparkSession.range(1).select(F.lit(root).alias("m"))).select("x"), "under")
    of = lambda df: df.join(ctx, "x", "left_semi")
    said = settle(_said_by(known, property_, of(known.held), of(known.empty)), "said")
    while True:
        names, facts = _alike(said)
        gone, held = _in_contexts(known, under.join(F.broadcast(facts)), True)
        # Contexts whose own class means more in them say more.
        own = lambda df: names.join(df, ["ctx", "x"])  # noqa: E731, B023
        more = settle(_said_by(known, property_, own(held).select("x", "m"), own(gone).select("x")).join(said, ["x", "b"], "left_anti"), "said")
        if more.isEmpty():
            return names.withColumnRenamed("x", "_name").join(gone, "ctx").select(F.col("_name").alias("ctx"), F.col("x").alias("node"))
        said = said.union(more)


def contradicted(known: Marked, said: DataFrame, property_: str) -> DataFrame:
    """The rows of said (cls, taxon) for which nothing is cls and property_ some taxon."""
    taxa = settle(said.select(F.col("taxon").alias("x")).distinct(), "taxa")
    of = lambda df: df.join(taxa, "x", "left_semi")
    names, facts = _alike(settle(_said_by(known, property_, of(known.held), of(known.empty)), "said"))
    always = said.join(known.empty.withColumnRenamed("x", "cls"), "cls", "left_semi").select("cls", "taxon")
    cases = said.join(names.withColumnRenamed("x", "taxon"), "taxon").select("cls", "taxon", "ctx")
    first = cases.select("ctx", F.col("cls").alias("x")).distinct().join(facts, "ctx")
    gone, _ = _in_contexts(known, first, False)
    return always.union(cases.join(gone.withColumnRenamed("x", "cls"), ["ctx", "cls"], "left_semi").select("cls", "taxon"))
