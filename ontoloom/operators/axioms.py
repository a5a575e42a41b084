"""Rewrites of class axioms and edge tables, class sets, lookups of entities, quality checks.

axioms (sub, sup), expressions (id, kind, property, filler, n) and edges (source,
target, property) as in operators.edges and operators.labelled; entities have id
and what a function names.  Results are distinct; null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.parsing import id_space
from ontoloom.operators import closure as C
from ontoloom.operators import labelled as L
from ontoloom.plans.session import settle

IS_A = L.IS_A


def _nodes(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def equivalents_as_axioms(equivalents: DataFrame) -> DataFrame:
    """(sub, sup): each pair of equivalent classes (a, b) as two inclusions."""
    return equivalents.select(F.col("a").alias("sub"), F.col("b").alias("sup")).union(equivalents.select("b", "a")).where("sub <> sup").distinct()


def split_intersections(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """Axioms whose right side is an intersection become one for each operand, however deep."""
    parts = expressions.where("kind = 'and'").select(F.col("id").alias("source"), F.col("filler").alias("target"))
    leaves = C.reflexive(parts).join(_nodes(parts, "source", "target"), "target", "left_anti").select(F.col("source").alias("sup"), F.col("target").alias("_leaf"))
    return axioms.join(leaves, "sup", "left").select("sub", F.coalesce("_leaf", "sup").alias("sup")).distinct()


def union_operands(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """Axioms whose left side is a union become one for each operand; others stay."""
    parts = expressions.where("kind = 'or'").select(F.col("id").alias("sub"), F.col("filler").alias("_part"))
    return axioms.join(parts, "sub", "left").select(F.coalesce("_part", "sub").alias("sub"), "sup").distinct()


def without_unions(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    bad = expressions.where("kind = 'or'").select(F.col("id").alias("node")).distinct()
    for end in ("sub", "sup"):
        axioms = axioms.join(bad.withColumnRenamed("node", end), end, "left_anti")
    return axioms.select("sub", "sup").distinct()


def cardinalities(expressions: DataFrame) -> DataFrame:
    """(id, kind, property, filler, n) of expressions with a number."""
    return expressions.where(F.col("kind").isin("min", "max", "exact"))


def without_cardinalities(expressions: DataFrame) -> DataFrame:
    """Minimal and exact numbers over 0 become existentials, the others go."""
    kept = expressions.where(~F.col("kind").isin("min", "max", "exact") | (F.col("kind").isin("min", "exact") & (F.col("n") > 0)))
    return kept.select("id", F.when(F.col("kind").isin("min", "exact"), "some").otherwise(F.col("kind")).alias("kind"), "property", "filler", F.when(~F.col("kind").isin("min", "exact"), F.col("n")).alias("n"))


def reduced_over(edges: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """Edges (source, target, property) without those of is_a and the properties in same that a longer path over them implies; all of these count as one relation."""
    alike = (F.col("property") == IS_A) | F.col("property").isin(*same)
    kept = C.reduction(edges.where(alike).select("source", "target"))
    return edges.where(alike).join(kept, ["source", "target"], "left_semi").select("source", "target", "property").union(edges.where(~alike).select("source", "target", "property")).distinct()


def related_properties(wanted: DataFrame, sub_property: DataFrame, chains: DataFrame, equivalent: DataFrame) -> DataFrame:
    """(property): wanted ones, their super-properties, and, walked on from the wanted ones, sub-properties, members of chains that make them, and equivalents."""
    down = sub_property.toDF("target", "source").select("source", "target")
    makes = chains.select(F.col("result").alias("source"), F.explode(F.array("p", "q")).alias("target"))
    same = equivalent.toDF("source", "target")
    walk = down.union(makes).union(same).union(same.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seeds = wanted.select(F.col("property").alias("node"))
    above = C.reached(sub_property.toDF("source", "target"), seeds)
    return C.reached(walk, seeds).union(above).select(F.col("node").alias("property")).distinct()


def changed_edges(edges: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, without: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, property) after removals (edges), additions (edges), and classes to drop or to keep alone (node)."""
    out = edges.select("source", "target", "property")
    if remove is not None:
        out = out.join(remove.select("source", "target", "property").distinct(), ["source", "target", "property"], "left_anti")
    if add is not None:
        out = out.union(add.select("source", "target", "property"))
    for end in ("source", "target"):
        if without is not None:
            out = out.join(without.select(F.col("node").alias(end)).distinct(), end, "left_anti")
        if only is not None:
            out = out.join(only.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return out.select("source", "target", "property").distinct()


def axioms_within(axioms: DataFrame, expressions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Axioms all of whose named classes, however deep in expressions, are among wanted (node)."""
    axioms, expressions = settle(axioms.select("sub", "sup").distinct(), "axioms"), settle(expressions.select("id", "filler").distinct(), "expressions")
    uses = expressions.select(F.col("id").alias("source"), F.col("filler").alias("target"))
    deep = C.reflexive(uses).join(_nodes(expressions, "id", "target"), "target", "left_anti").select(F.col("source").alias("e"), F.col("target").alias("named"))
    bad = settle(deep.join(wanted.select(F.col("node").alias("named")).distinct(), "named", "left_anti").select("e").distinct(), "outside")
    out = axioms
    for end in ("sub", "sup"):
        out = settle(out, "axioms")
        plain = out.join(_nodes(expressions, "id", end), end, "left_anti").join(wanted.select(F.col("node").alias(end)).distinct(), end, "left_semi")
        deepened = out.join(_nodes(expressions, "id", end), end, "left_semi").join(bad.withColumnRenamed("e", end), end, "left_anti")
        out = plain.select("sub", "sup").union(deepened.select("sub", "sup"))
    return out


def classes_of(members: DataFrame, nodes: DataFrame, subset: str | None = None, space: str | None = None, others: bool = False) -> DataFrame:
    """(node): nodes in a subset (members: node, subset) or of an id space; with others, all but those."""
    if subset is not None:
        inside = members.where(F.col("subset") == subset).select("node").distinct()
        return nodes.select("node").distinct().join(inside, "node", "left_anti" if others else "left_semi")
    mine = F.coalesce(id_space(F.col("node")) == space, F.lit(False))
    return nodes.select("node").distinct().where(~mine if others else mine)


def in_properties(edges: DataFrame, sub_property: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges whose property, or the nearest wanted super-property in its place, is wanted (property); is_a stays."""
    from ontoloom.operators.rewrite import map_relations

    return L.only_properties(map_relations(edges, sub_property, wanted), wanted).distinct()


def disjoint_expressions(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs whose intersection is empty, for groups (group_id, node) of classes that are all disjoint.

    A group of m classes has that many pairs by meaning; groups are axioms, written by hand.
    """
    pair = groups.select("group_id", F.col("node").alias("a")).join(groups.select("group_id", F.col("node").alias("b")), "group_id").where("a < b")
    return pair.select("a", "b").distinct()


def tagged(entities: DataFrame, prop: str, value: str) -> DataFrame:
    """(node): entities (id, property, value) that carry the tag."""
    return entities.where((F.col("property") == prop) & (F.col("value") == value)).select(F.col("id").alias("node")).distinct()


def about(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that start at or point to one of nodes (node)."""
    few = nodes.select("node").distinct()
    one = lambda end: edges.join(few.withColumnRenamed("node", end), end, "left_semi").select(*edges.columns)
    return one("source").union(one("target")).distinct()


def justified(edges: DataFrame) -> DataFrame:
    """source, target, inferable: whether the other edges alone imply the edge (of an acyclic graph)."""
    edges = settle(C.clean(edges), "edges")
    needed = C.reduction(edges).withColumn("_n", F.lit(True))
    return edges.join(needed, ["source", "target"], "left").select("source", "target", F.col("_n").isNull().alias("inferable"))


def explained(edges: DataFrame, cls, holders: DataFrame) -> DataFrame:
    """(holder, path): the shortest paths, as ids joined by " > ", from a class up to each of holders (node), itself included; of several the least text."""
    kind = edges.schema["source"].dataType.simpleString()
    step = settle(C.clean(edges).select(F.col("source").alias("node"), F.col("target").alias("_to")), "steps")
    front = edges.sparkSession.createDataFrame([(cls, str(cls))], f"node {kind}, path string")
    parts = [settle(front, "paths")]
    while True:
        known = parts[0].select("node")
        for p in parts[1:]:
            known = known.union(p.select("node"))
        new = parts[-1].join(step, "node").groupBy(F.col("_to").alias("node")).agg(F.min(F.concat("path", F.lit(" > "), F.col("_to").cast("string"))).alias("path"))
        parts.append(settle(new.join(known, "node", "left_anti"), "paths"))
        if parts[-1].isEmpty():
            break
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.join(holders.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("holder"), "path")


def species_view(edges: DataFrame, same: DataFrame, suffix: str) -> DataFrame:
    """Edges with classes that a species has of its own: same is (node, own), from a general class to the species' one; general classes without one get the suffix."""
    own = same.groupBy("node").agg(F.min("own").alias("_own"))
    out = edges.select("source", "target", "property")
    for end in ("source", "target"):
        out = out.join(own.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("_own", F.concat(F.col(end), F.lit(suffix)))).drop("_own")
    return out.where("source <> target").select("source", "target", "property").distinct()


def copied(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between mapped classes (node, other), copied to the classes they map to, without those that are there already."""
    out = edges.select("source", "target", "property")
    for end in ("source", "target"):
        out = out.join(mapping.select(F.col("node").alias(end), F.col("other").alias(f"_{end}")), end)
    out = out.select(F.col("_source").alias("source"), F.col("_target").alias("target"), "property").distinct()
    return out.join(edges.select("source", "target", "property"), ["source", "target", "property"], "left_anti")


def properties_used(edges: DataFrame, sub_property: DataFrame) -> DataFrame:
    """(property): those of edges and all their super-properties."""
    seeds = edges.where(F.col("property") != IS_A).select(F.col("property").alias("node")).distinct()
    return C.reached(sub_property.toDF("source", "target"), seeds).select(F.col("node").alias("property"))


def with_redundancy(edges: DataFrame) -> DataFrame:
    """Edges (source, target) with redundant: another path implies the edge."""
    return justified(edges).withColumnRenamed("inferable", "redundant")


def as_individuals(edges: DataFrame, prefix: str = "i:") -> DataFrame:
    """(a, property, b): each class as an individual, is_a as type_of_level, other properties as they are."""
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return edges.select(name("source").alias("a"), F.when(F.col("property") == IS_A, "type_of_level").otherwise(F.col("property")).alias("property"), name("target").alias("b")).distinct()


def linked_by_pattern(definitions: DataFrame, patterns: DataFrame, up: DataFrame) -> DataFrame:
    """(source, target, property): for definitions (cls, property, filler; genus with a null property) whose genus stands under a pattern's genus and that have its relation: cls result filler.

    patterns is (genus, relation, result).
    """
    genus = definitions.where("property is null").select("cls", F.col("filler").alias("source")).join(up, "source").select("cls", F.col("target").alias("genus"))
    rest = definitions.where("property is not null").select("cls", F.col("property").alias("relation"), "filler")
    return genus.join(patterns, "genus").join(rest, ["cls", "relation"]).select(F.col("cls").alias("source"), F.col("filler").alias("target"), F.col("result").alias("property")).distinct()


def edited_annotations(notes: Column, drop: tuple[str, ...] = (), rename: dict[str, str] | None = None, add: list[tuple[str, str]] | None = None) -> Column:
    """An array of (prop, value) with properties dropped and renamed and pairs added; sorted, each pair once."""
    kept = F.filter(notes, lambda s: ~s["prop"].isin(*drop)) if drop else notes

    def renamed(s: Column) -> Column:
        name = s["prop"]
        for a, b in (rename or {}).items():
            name = F.when(s["prop"] == a, b).otherwise(name)
        return F.struct(name.alias("prop"), s["value"].alias("value"))

    kept = F.transform(kept, renamed)
    more = [F.struct(F.lit(p).alias("prop"), F.lit(v).alias("value")) for p, v in add or []]
    return F.array_sort(F.array_distinct(F.concat(kept, F.array(*more)) if more else kept))


# Entities.


def real_classes(entities: DataFrame) -> DataFrame:
    """(id) of classes that aren't obsolete, no stub of an alternative id and neither Thing nor Nothing; entities has id, kind, is_obsolete, alt_ids."""
    alt = entities.select(F.explode("alt_ids").alias("id")).distinct()
    live = entities.where((F.col("kind") == "class") & ~F.coalesce("is_obsolete", F.lit(False)) & ~F.col("id").isin("owl:Thing", "owl:Nothing"))
    return live.select("id").distinct().join(alt, "id", "left_anti")


def categories(nodes: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """(node, category) by id space; table is (space, category)."""
    few = table.dropDuplicates(["space"])
    return nodes.select("node", id_space(F.col("node")).alias("space")).join(few, "space", "left").select("node", F.coalesce("category", F.lit(default)).alias("category"))


def id_of(iri: Column) -> Column:
    """The short id of an OBO address (…/obo/GO_0001 -> GO:0001, …#part_of -> part_of); others stay."""
    name = F.regexp_extract(iri, r"^https?://purl\.obolibrary\.org/obo/(?:[^#]*#)?([^/#]+)$", 1)
    coded = F.regexp_extract(name, r"^([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z]+)*)_([0-9]+)$", 1)
    return F.when(name == "", iri).when((coded != "") & ~iri.contains("#"), F.concat(coded, F.lit(":"), F.regexp_extract(name, r"_([0-9]+)$", 1))).otherwise(name)


def iri_of(short: Column) -> Column:
    """The OBO address of an id; what is an address already stays."""
    base = F.lit("http://purl.obolibrary.org/obo/")
    return F.when(short.rlike("^https?:"), short).when(F.instr(short, ":") > 0, F.concat(base, F.replace(short, F.lit(":"), F.lit("_")))).otherwise(F.concat(base, F.lit("TODO_#"), short))


def by_label(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, id, n): entities (id, label) of the wanted labels (label); id is null where several share the label."""
    found = entities.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.count_distinct("id").alias("n"), F.min("id").alias("_id"))
    return found.select("label", F.when(F.col("n") == 1, F.col("_id")).alias("id"), "n")


def by_alternative_id(entities: DataFrame) -> DataFrame:
    """(alt_id, id) over alt_ids; a class's own id isn't its alternative."""
    return entities.select(F.explode("alt_ids").alias("alt_id"), "id").where("alt_id <> id").distinct()


def merged(tables: list[DataFrame]) -> DataFrame:
    """(id, label) of several ontologies' entities (id, label): the label of the first that has one."""
    rows = None
    for i, t in enumerate(tables):
        one = t.select("id", "label", F.lit(i).alias("_i"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("id").agg(F.min(F.when(F.col("label").isNotNull(), F.struct("_i", "label"))).alias("_l")).select("id", F.col("_l.label").alias("label"))


def restricted_to_taxa(up: DataFrame, only_in: DataFrame) -> DataFrame:
    """(cls, taxon): the taxa that a class or one of its ancestors is restricted to."""
    return up.join(only_in.select(F.col("cls").alias("target"), "taxon"), "target").select(F.col("source").alias("cls"), "taxon").distinct()


# Checks of an ontology.


def signature_problems(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, problem): edges that use an obsolete class, an alternative id or an undeclared class."""
    alt = by_alternative_id(entities).select(F.col("alt_id").alias("id")).distinct().withColumn("_alt", F.lit(True))
    known = entities.groupBy("id").agg(F.max(F.coalesce("is_obsolete", F.lit(False))).alias("_gone"))
    out = None
    for end in ("source", "target"):
        one = edges.select("source", "target", F.col(end).alias("id")).join(known, "id", "left").join(alt, "id", "left")
        word = F.when(F.col("_gone"), "obsolete").when(F.col("_gone").isNull() & F.col("_alt"), "alternative_id").when(F.col("_gone").isNull(), "undeclared")
        one = one.select("source", "target", word.alias("problem")).where("problem is not null")
        out = one if out is None else out.union(one)
    return out.distinct()


def self_references(definitions: DataFrame) -> DataFrame:
    """(cls) of definitions (cls, property, filler) that mention their class, also through other definitions."""
    uses = definitions.select(F.col("cls").alias("source"), F.col("filler").alias("target"))
    return C.on_cycles(uses).withColumnRenamed("node", "cls").join(definitions.select("cls").distinct(), "cls", "left_semi")


def cross_references(entities: DataFrame) -> DataFrame:
    """(space, xref, ids): references of xrefs by their database, with the ids that have them, sorted and joined by commas."""
    x = entities.select("id", F.explode("xrefs").alias("xref"))
    return x.groupBy(F.coalesce(id_space(F.col("xref")), F.lit("")).alias("space"), "xref").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def obsolete_terms(entities: DataFrame) -> DataFrame:
    """(id, kind, other): obsolete classes with exact (replaced_by) and inexact (each of consider) successors, or none."""
    gone = entities.where("is_obsolete")
    exact = gone.where("replaced_by is not null").select("id", F.lit("exact").alias("kind"), F.col("replaced_by").alias("other"))
    inexact = gone.select("id", F.lit("inexact"), F.explode("consider"))
    none = gone.where("replaced_by is null and coalesce(size(consider), 0) <= 0").select("id", F.lit("none"), F.lit(None).cast("string"))
    return exact.union(inexact).union(none)


def check_summary(problems: DataFrame, fatal: tuple[str, ...]) -> DataFrame:
    """(severity, n_problems, n_classes) of problems (id, problem)."""
    severity = F.when(F.col("problem").isin(*fatal), "fatal").otherwise("warning")
    return problems.groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("n_problems"), F.count_distinct("id").alias("n_classes"))


def parents_by_property(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """(source, property, parents): per property the targets that no other target of it stands under, sorted and joined by commas; closed is the is_a closure."""
    above = closed.where("source <> target").select(F.col("source").alias("target"), F.col("target").alias("_up"))
    over = edges.join(above, "target").select("source", "property", F.col("_up").alias("target")).distinct()
    kept = edges.select("source", "target", "property").distinct().join(over, ["source", "property", "target"], "left_anti")
    return kept.groupBy("source", "property").agg(F.array_join(F.array_sort(F.collect_set(F.col("target").cast("string"))), ",").alias("parents"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with rank in each group of by, for reports in a stable order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*[c for c in rows.columns if c != by])))
