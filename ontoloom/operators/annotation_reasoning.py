"""Annotations as axioms: checks by reasoning, predictions by folding extensions into classes.

Both classify what annotations say against a stored state of the ontology
(`ontoloom.operators.saturation`).  Annotations that say the same are one axiom,
so the reasoning grows with distinct contents, not with rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import emptiness as E
from ontoloom.operators import saturation as S
from ontoloom.operators.reasoning import NOTHING
from ontoloom.plans.session import settle

IN_TAXON = "in_taxon"


def _said(annotations: DataFrame) -> DataFrame:
    """(node, cls, taxon), one row a distinct content; the node's name is told apart by lengths, so two contents never share one."""
    said = annotations.select("cls", "taxon").where("cls is not null and taxon is not null").distinct()
    return said.withColumn("node", F.concat(F.lit("@"), F.length("cls"), F.lit(":"), "cls", F.lit("|"), "taxon"))


def taxon_axioms(said: DataFrame, property_: str = IN_TAXON) -> S.Tables:
    """A node for each content: a subclass of its class that is property_ some taxon."""
    return {"sub": said.select(F.col("node").alias("a"), F.col("cls").alias("b")), "right": said.select(F.col("node").alias("a"), F.lit(property_).alias("property"), F.col("taxon").alias("b"))}


def contradictions(annotations: DataFrame, state: S.State | E.Marked, explain: bool = False, property_: str = IN_TAXON) -> DataFrame:
    """Rows of annotations (with cls and taxon) that contradict the ontology: those whose class is empty, or empty in their taxon.

    With explain, `axioms` is a minimal set of axioms that the row contradicts
    together; axioms about the row itself begin with its node's name; this takes
    a whole state, while marked() axioms do without it.  Rows without class or
    taxon are never listed.
    """
    if isinstance(state, E.Marked):
        if explain:
            raise ValueError("explanations need classify()")
        said = settle(annotations.select("cls", "taxon").na.drop().distinct(), "said")
        return annotations.join(settle(E.contradicted(state, said, property_), "contradictions"), ["cls", "taxon"], "left_semi")
    said = settle(_said(annotations), "said")
    new = taxon_axioms(said, property_)
    bad = settle(S.emptied(state, new).withColumnRenamed("x", "node").join(said, "node"), "contradictions")
    if explain:
        both = S.extend(state, taxon_axioms(bad, property_))
        bad = settle(bad.join(S.justified(both, bad.select("node")), "node"), "explained")
    return annotations.join(bad.drop("node"), ["cls", "taxon"])


def empty_module(explained: DataFrame) -> DataFrame:
    """(axiom): the axioms of all explanations, each once: the part of the ontology that makes annotations fail."""
    return explained.select(F.explode("axioms").alias("axiom")).distinct()


def extension_axioms(contents: DataFrame) -> S.Tables:
    """Definitions of contents (node, cls, property, filler): node is the same as cls and property some filler."""
    mark = F.concat(F.col("node"), F.lit("|some"))
    return {
        "sub": contents.select(F.col("node").alias("a"), F.col("cls").alias("b")),
        "right": contents.select(F.col("node").alias("a"), "property", F.col("filler").alias("b")),
        "left": contents.select("property", F.col("filler").alias("a"), mark.alias("b")),
        "both": contents.select(F.col("cls").alias("a1"), mark.alias("a2"), F.col("node").alias("b")),
    }


def fold_predictions(annotations: DataFrame, state: S.State, relevant: DataFrame, properties: list[str]) -> DataFrame:
    """(bioentity, cls, property, filler, predicted, how): classes of relevant (node) that say what an annotation (bioentity, cls, property, filler) says.

    `how` is equivalent where a class is the same; else super for the most
    specific classes above, and the property for those that what is said is
    property some class of (for properties of the list).  What annotations of the
    bioentity say already, themselves or by their superclasses, is not predicted.
    Contents that contradict the ontology predict nothing.
    """
    spark = annotations.sparkSession
    full = settle(annotations.select("bioentity", "cls", "property", "filler").distinct(), "annotations")
    contents = full.where("cls is not null and property is not null and filler is not null").select("cls", "property", "filler").distinct()
    name = F.concat(F.lit("@"), *[x for c in ("cls", "property") for x in (F.length(c), F.lit(":"), F.col(c), F.lit("|"))], F.col("filler"))
    contents = settle(contents.withColumn("node", name), "contents")
    relevant = settle(relevant.select("node").distinct(), "relevant")
    facts = settle(S.added(state, {k: v.withColumn("ctx", F.lit("")) for k, v in extension_axioms(contents).items()}), "folded")
    own = contents.select(F.col("node").alias("x"))
    above = facts.where("p = ''").join(own, "x", "left_semi").select(F.col("x").alias("node"), F.col("y").alias("predicted"))
    empty = above.where(F.col("predicted") == NOTHING).select("node")
    above = above.join(empty, "node", "left_anti").join(relevant.withColumnRenamed("node", "predicted"), "predicted", "left_semi")
    below = facts.where("p = ''").select(F.col("x").alias("predicted"), F.col("y").alias("node"))
    same = above.join(below, ["node", "predicted"], "left_semi")
    rest = above.join(same.select("node").distinct(), "node", "left_anti")
    strict = state.implied.where("x <> a").select(F.col("x").alias("_low"), F.col("a").alias("predicted"))
    strict = strict.join(strict.select(F.col("_low").alias("predicted"), F.col("predicted").alias("_low")), ["_low", "predicted"], "left_anti")
    over = rest.withColumnRenamed("predicted", "_low").join(strict, "_low").select("node", "predicted")
    direct = rest.join(over, ["node", "predicted"], "left_anti")
    kinds = spark.createDataFrame([(p,) for p in properties], "p string")
    linked = facts.join(F.broadcast(kinds), "p").join(own, "x", "left_semi").select(F.col("x").alias("node"), "p", F.col("y").alias("predicted"))
    linked = linked.join(relevant.withColumnRenamed("node", "predicted"), "predicted", "left_semi").join(empty, "node", "left_anti").join(same.select("node").distinct(), "node", "left_anti")
    nearer = linked.withColumnRenamed("predicted", "_low").join(strict, "_low").select("node", "p", "predicted")
    linked = linked.join(nearer, ["node", "p", "predicted"], "left_anti")
    cells = lambda df, how: df.select("node", "predicted", how.alias("how"))
    found = cells(same, F.lit("equivalent")).union(cells(direct, F.lit("super"))).union(cells(linked, F.col("p")))
    known = full.select("bioentity", "cls").distinct()
    known = known.join(state.implied.select(F.col("x").alias("cls"), F.col("a").alias("predicted")), "cls").select("bioentity", "predicted").union(known.select("bioentity", "cls")).distinct()
    rows = full.join(contents, ["cls", "property", "filler"]).join(found, "node").join(known, ["bioentity", "predicted"], "left_anti")
    return rows.select("bioentity", "cls", "property", "filler", "predicted", "how").distinct()
