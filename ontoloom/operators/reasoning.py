"""Classification in the EL profile by completion rules, as iterated joins.

Axioms come normalised, in tables with string columns:
  sub (a, b): a is a subclass of b;  both (a1, a2, b): a1 and a2 together imply b;
  right (a, property, b): a implies property some b;  left (property, a, b):
  property some a implies b;  sub_property (p, q);  chains (p, q, result).
NOTHING stands for the empty class.  Missing tables may be None.

A round applies every rule to what the round before found anew, on either side,
and writes the new rows to the shared folder; it ends when there are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.plans.session import settle

NOTHING, THING = "Nothing", "Thing"
#: Kinds of expressions that the profile has.
EL_KINDS = ("some", "and", "value")


def in_profile(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """The axioms (sub, sup) whose ends hold no expression outside the profile, however deep."""
    bad = expressions.where(~F.col("kind").isin(*EL_KINDS)).select(F.col("id").alias("node")).distinct()
    uses = expressions.join(expressions.select(F.col("id").alias("filler")).distinct(), "filler", "left_semi").select(F.col("id").alias("source"), F.col("filler").alias("target"))
    bad = C.reached(uses, bad, down=True)
    for end in ("sub", "sup"):
        axioms = axioms.join(bad.withColumnRenamed("node", end), end, "left_anti")
    return axioms.select("sub", "sup").distinct()


def normalised(axioms: DataFrame, expressions: DataFrame) -> dict[str, DataFrame]:
    """The tables of this module from axioms (sub, sup) and expressions (id, kind, property, filler) of kinds some and and.

    An intersection of several operands is built up two by two, in order.
    """
    some = expressions.where("kind = 'some'").select("id", "property", "filler").distinct()
    parts = expressions.where("kind = 'and'").groupBy("id").agg(F.array_sort(F.collect_set("filler")).alias("f"))
    step = lambda i: F.concat(F.col("id"), F.lit("#"), i.cast("string"))
    # id#1 is the first operand; id#k holds the first k; the last of them is id.
    rows = parts.select("id", "f", F.explode(F.sequence(F.lit(2), F.size("f"))).alias("k")).where("size(f) > 1")
    low = F.when(F.col("k") == 2, F.col("f")[0]).otherwise(step(F.col("k") - 1))
    both = rows.select(low.alias("a1"), F.get("f", F.col("k") - 1).alias("a2"), F.when(F.col("k") == F.size("f"), F.col("id")).otherwise(step(F.col("k"))).alias("b"))
    sub = axioms.select(F.col("sub").alias("a"), F.col("sup").alias("b"))
    sub = sub.union(parts.select("id", F.explode("f"))).union(parts.where("size(f) = 1").select(F.col("f")[0], "id"))
    return {"sub": sub.distinct(), "both": both.distinct(), "right": some.select(F.col("id").alias("a"), "property", F.col("filler").alias("b")), "left": some.select("property", F.col("filler").alias("a"), F.col("id").alias("b"))}


def saturate(sub: DataFrame, both: DataFrame | None = None, right: DataFrame | None = None, left: DataFrame | None = None, sub_property: DataFrame | None = None, chains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(x, a): all classes that imply a, themselves included; and (x, property, y): x implies property some y."""
    spark = sub.sparkSession
    empty = lambda *names: spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    sub = settle(sub.select("a", "b").distinct(), "sub")
    both = settle((both if both is not None else empty("a1", "a2", "b")).select("a1", "a2", "b").distinct(), "both")
    right = settle((right if right is not None else empty("a", "property", "b")).select("a", "property", "b").distinct(), "right")
    left = settle((left if left is not None else empty("property", "a", "b")).select("property", "a", "b").distinct(), "left")
    chains = settle((chains if chains is not None else empty("p", "q", "result")).select("p", "q", "result").distinct(), "chains")
    wider = C.reflexive(sub_property.toDF("source", "target")).where("source <> target").select(F.col("source").alias("property"), F.col("target").alias("_q")) if sub_property is not None else None
    names = [sub.select("a"), sub.select("b"), both.select("a1"), both.select("a2"), both.select("b"), right.select("a"), right.select("b"), left.select("a"), left.select("b")]
    start = reduce(DataFrame.union, names).toDF("x").where("x is not null").distinct()
    new_s = settle(start.select("x", F.col("x").alias("a")), "implied")
    new_r = settle(empty("x", "property", "y"), "links")
    all_s, all_r = [new_s], [new_r]
    while True:
        s, r = reduce(DataFrame.union, all_s), reduce(DataFrame.union, all_r)
        on = [new_s.join(sub, "a").select("x", F.col("b").alias("a"))]
        mine, known = new_s.select("x", F.col("a").alias("a1")), s.select("x", F.col("a").alias("a2"))
        for one, two in (("a1", "a2"), ("a2", "a1")):
            on.append(mine.withColumnRenamed("a1", one).join(both, one).join(known.withColumnRenamed("a2", two), ["x", two]).select("x", F.col("b").alias("a")))
        implied = lambda df: df.select(F.col("x").alias("y"), "a")
        for links, classes in ((new_r, s), (r, new_s)):
            on.append(links.join(implied(classes), "y").join(left, ["property", "a"]).select("x", F.col("b").alias("a")))
            on.append(links.join(implied(classes).where(F.col("a") == NOTHING), "y").select("x", "a"))
        onward = [new_s.join(right, "a").select("x", "property", F.col("b").alias("y"))]
        if wider is not None:
            onward.append(new_r.join(wider, "property").select("x", F.col("_q").alias("property"), "y"))
        first = lambda df: df.select("x", F.col("property").alias("p"), F.col("y").alias("m"))
        second = lambda df: df.select(F.col("x").alias("m"), F.col("property").alias("q"), "y")
        for one, two in ((new_r, r), (r, new_r)):
            onward.append(first(one).join(chains, "p").join(second(two), ["m", "q"]).select("x", F.col("result").alias("property"), "y"))
        new_s = settle(reduce(DataFrame.union, on).distinct().join(s, ["x", "a"], "left_anti"), "implied")
        new_r = settle(reduce(DataFrame.union, onward).distinct().join(r, ["x", "property", "y"], "left_anti"), "links")
        if new_s.isEmpty() and new_r.isEmpty():
            return s, r
        all_s.append(new_s)
        all_r.append(new_r)


def unsatisfiable(implied: DataFrame, named: DataFrame) -> DataFrame:
    """(node): named classes that imply NOTHING."""
    return implied.where((F.col("a") == NOTHING) & (F.col("x") != NOTHING)).select(F.col("x").alias("node")).join(named.select("node"), "node", "left_semi").distinct()


def equivalents(implied: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b), a < b: named, satisfiable classes that imply each other."""
    few = _satisfiable(implied, named)
    back = few.select(F.col("x").alias("a"), F.col("a").alias("x"))
    return few.join(back, ["x", "a"], "left_semi").where("x < a").select(F.col("x").alias("a"), F.col("a").alias("b"))


def _satisfiable(implied: DataFrame, named: DataFrame) -> DataFrame:
    bad = unsatisfiable(implied, named)
    few = implied.where("x <> a").join(named.select(F.col("node").alias("x")).distinct(), "x", "left_semi").join(named.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    return few.join(bad.withColumnRenamed("node", "x"), "x", "left_anti").select("x", "a").where(~F.col("a").isin(THING, NOTHING))


def inferred(implied: DataFrame, named: DataFrame, asserted: DataFrame, always: bool = False) -> DataFrame:
    """(source, target): direct inferred superclasses among named, satisfiable classes that aren't asserted (source, target).

    Equivalent classes aren't each other's superclasses.  With always, asserted ones are listed too.
    """
    few = _satisfiable(implied, named)
    strict = settle(few.join(few.select(F.col("a").alias("x"), F.col("x").alias("a")), ["x", "a"], "left_anti").select(F.col("x").alias("source"), F.col("a").alias("target")), "strict")
    over = strict.join(strict.select(F.col("source").alias("target"), F.col("target").alias("_up")), "target").select("source", F.col("_up").alias("target")).distinct()
    direct = strict.join(over, ["source", "target"], "left_anti")
    return direct if always else direct.join(C.clean(asserted), ["source", "target"], "left_anti")


def redundant(implied: DataFrame, asserted: DataFrame) -> DataFrame:
    """Asserted (source, target) that stand above another implied, strictly more specific superclass of the source."""
    edges = C.clean(asserted)
    strict = implied.where("x <> a").join(implied.select(F.col("a").alias("x"), F.col("x").alias("a")), ["x", "a"], "left_anti").select("x", "a")
    mids = strict.select(F.col("x").alias("source"), F.col("a").alias("mid"))
    over = mids.join(strict.select(F.col("x").alias("mid"), F.col("a").alias("target")), "mid").select("source", "target")
    return edges.join(over, ["source", "target"], "left_semi")


def existentials(links: DataFrame, implied: DataFrame, named: DataFrame, prop: str) -> DataFrame:
    """(source, target): named classes with prop some target, named, over all links and superclasses of their ends."""
    ends = links.where(F.col("property") == prop).select("x", F.col("y").alias("_y")).join(implied.select(F.col("x").alias("_y"), F.col("a").alias("y")), "_y").select("x", "y").distinct()
    for end in ("x", "y"):
        ends = ends.join(named.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return ends.where(~F.col("y").isin(THING, NOTHING)).select(F.col("x").alias("source"), F.col("y").alias("target"))


def also_restricted(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """(sub, property, sup): a class that is a subclass both of sup and of property some sup."""
    some = expressions.where("kind = 'some'").select(F.col("id").alias("sup"), "property", F.col("filler").alias("_f"))
    held = axioms.join(some, "sup").select("sub", "property", F.col("_f").alias("sup"))
    return held.join(axioms.select("sub", "sup"), ["sub", "sup"], "left_semi").select("sub", "property", "sup").distinct()


def unfolded(definitions: DataFrame) -> DataFrame:
    """(cls, property, filler): the parts of each definition (cls, property, filler; a null property marks a genus) with defined genera replaced by their parts.

    Definitions that lead back to themselves keep the genus that does.
    """
    parts = settle(definitions.select("cls", "property", "filler").distinct(), "definitions")
    uses = parts.where("property is null").join(parts.select(F.col("cls").alias("filler")).distinct(), "filler", "left_semi").select(F.col("cls").alias("source"), F.col("filler").alias("target"))
    up = C.reflexive(uses).join(C.on_cycles(uses).withColumnRenamed("node", "target"), "target", "left_anti").select(F.col("source").alias("_c"), F.col("target").alias("cls"))
    own = parts.select("cls").distinct()
    reach = up.where("_c <> cls").union(own.select(F.col("cls").alias("_c"), "cls")).distinct()
    full = reach.join(parts, "cls").select(F.col("_c").alias("cls"), "property", "filler")
    defined = own.join(C.on_cycles(uses).withColumnRenamed("node", "cls"), "cls", "left_anti").select(F.col("cls").alias("filler"))
    kept = full.where("property is null").join(defined, "filler", "left_anti").select("cls", "property", "filler")
    return full.where("property is not null").union(kept).distinct()
