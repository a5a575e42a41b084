"""Edges of class axioms: quantified labels, unfolding of expressions, composition, closures, expressions of edges.

axioms is (sub, sup); either end may be an expression.  expressions is (id, kind,
property, filler, n), one row an operand: kinds some, only, value, min, max,
exact, and, or, not; n is the number of a cardinality.  An edge is (source,
target, label): label is an array of tokens, each a quantifier (SUBCLASS_OF,
INSTANCE_OF, IDENTITY) or a quantifier and a property ("SOME part_of", "ONLY p",
"VALUE p", "ASSERT p").  Null ends make no edge, repeated axioms count once.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.plans.session import settle

SUB, INSTANCE, SAME = "SUBCLASS_OF", "INSTANCE_OF", "IDENTITY"
#: Relations of the named bundles, beside subclassing.
BUNDLES = {
    "isa_partof": ["BFO:0000050"],
    "regulates": ["BFO:0000050", "RO:0002211", "RO:0002212", "RO:0002213"],
    "common": ["BFO:0000050", "BFO:0000066", "RO:0002211", "RO:0002212", "RO:0002213"],
}


def token(quantifier: str | Column, prop: Column) -> Column:
    return F.concat_ws(" ", F.lit(quantifier) if isinstance(quantifier, str) else quantifier, prop)


def last(label: str | Column) -> Column:
    return F.element_at(F.col(label) if isinstance(label, str) else label, -1)


def text(label: str | Column) -> Column:
    return F.array_join(F.col(label) if isinstance(label, str) else label, ";")


def restriction(kind: Column, prop: Column, n: Column) -> Column:
    """The token of a restriction; cardinalities over 0 count as SOME, others, and other kinds, have none."""
    at_least = kind.isin("min", "exact") & (n > 0)
    return F.when((kind == "some") | at_least, token("SOME", prop)).when(kind == "only", token("ONLY", prop)).when(kind == "value", token("VALUE", prop))


def primitive(axioms: DataFrame, expressions: DataFrame, equivalents: DataFrame | None = None, assertions: DataFrame | None = None, facts: DataFrame | None = None, relaxed: bool = True) -> DataFrame:
    """One-step edges (source, target, label with one token).

    assertions is (individual, cls), facts (a, property, b), equivalents (a, b).
    Unless relaxed, equivalent classes are edges both ways, and operands of a
    union are subclasses of it.
    """
    one = lambda c: F.array(c if isinstance(c, Column) else F.lit(c)).alias("label")
    out = [axioms.select(F.col("sub").alias("source"), F.col("sup").alias("target"), one(SUB))]
    held = restriction(F.col("kind"), F.col("property"), F.col("n"))
    out.append(expressions.where(held.isNotNull()).select(F.col("id").alias("source"), F.col("filler").alias("target"), one(held)))
    out.append(expressions.where("kind = 'and'").select(F.col("id").alias("source"), F.col("filler").alias("target"), one(SUB)))
    if not relaxed:
        out.append(expressions.where("kind = 'or'").select(F.col("filler").alias("source"), F.col("id").alias("target"), one(SUB)))
        if equivalents is not None:
            out += [equivalents.select(F.col(x).alias("source"), F.col(y).alias("target"), one(SUB)) for x, y in ("ab", "ba")]
    if assertions is not None:
        out.append(assertions.select(F.col("individual").alias("source"), F.col("cls").alias("target"), one(INSTANCE)))
    if facts is not None:
        out.append(facts.select(F.col("a").alias("source"), F.col("b").alias("target"), one(token("ASSERT", F.col("property")))))
    return reduce(DataFrame.union, out).where("source is not null and target is not null").distinct()


def rules(properties: DataFrame, chains: DataFrame | None = None, inverses: DataFrame | None = None, sub_property: DataFrame | None = None) -> DataFrame:
    """(a, b, result): which token two tokens in a row make.

    properties is (property, transitive), chains (p, q, result), inverses (p, q).
    With sub_property, a closure (source, target), a rule also holds for the
    sub-properties of its properties (the result is as general as the rule's).
    """
    p = F.col("property")
    out = []
    spark = properties.sparkSession
    out.append(spark.createDataFrame([(SUB, SUB, SUB), (INSTANCE, SUB, INSTANCE), (SAME, SUB, SUB), (SUB, SAME, SUB), (SAME, SAME, SAME)], "a string, b string, result string"))
    for q in ("SOME", "ONLY"):
        t = token(q, p)
        out += [properties.select(F.lit(SUB), t, t), properties.select(t, F.lit(SUB), t)]
    some, fact = token("SOME", p), token("ASSERT", p)
    over = properties.where("transitive")
    out += [over.select(some, some, some), over.select(fact, fact, fact)]
    if chains is not None:
        out.append(chains.select(token("SOME", F.col("p")), token("SOME", F.col("q")), token("SOME", F.col("result"))))
    if inverses is not None:
        for x, y in ("pq", "qp"):
            out.append(inverses.select(token("ASSERT", F.col(x)), token("ASSERT", F.col(y)), F.lit(SAME)))
    table = reduce(DataFrame.union, out).toDF("a", "b", "result").distinct()
    if sub_property is not None:
        below = sub_property.where("source <> target").select(token("SOME", F.col("source")).alias("_s"), token("SOME", F.col("target")).alias("_t"))
        for side in ("a", "b"):
            more = table.where("a like 'SOME %' and b like 'SOME %'").join(below, F.col(side) == F.col("_t")).withColumn(side, F.col("_s")).select("a", "b", "result")
            table = table.union(more.join(table, ["a", "b"], "left_anti")).distinct()
    return table.groupBy("a", "b").agg(F.min("result").alias("result"))


def rule_map(table: DataFrame) -> Column:
    """The rules as one constant map from "a|b" to the result; their number grows with pairs of properties, not with data."""
    found = {f"{r['a']}|{r['b']}": r["result"] for r in table.collect()}
    return F.from_json(F.lit(json.dumps(found)), "map<string,string>")


def fused(label: Column, known: Column) -> Column:
    """The label with two neighbouring tokens made one wherever a rule says so, until none does."""

    def add(done: Column, t: Column) -> Column:
        made = F.when(F.size(done) > 0, F.try_element_at(known, F.concat_ws("|", F.get(done, F.size(done) - 1), t)))
        return F.when(made.isNull(), F.concat(done, F.array(t))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(made)))

    once = lambda tokens: F.aggregate(tokens, F.array().cast("array<string>"), add)
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(label), F.lit(2))), label, lambda now, _: once(now))


def named(edges: DataFrame, anonymous: DataFrame, table: DataFrame) -> DataFrame:
    """Edges between named nodes: paths through anonymous (id) ones, unfolded and composed."""
    known = rule_map(table)
    anon = settle(anonymous.select(F.col("id").alias("target")).distinct(), "anonymous")
    inner = settle(edges.join(anon.withColumnRenamed("target", "source"), "source", "left_semi").select(F.col("source").alias("_mid"), F.col("target").alias("_to"), F.col("label").alias("_l")), "inner")
    now = edges.join(anon.withColumnRenamed("target", "source"), "source", "left_anti").select("source", "target", "label")
    done = []
    while True:
        now = settle(now.join(anon.withColumn("_open", F.lit(True)), "target", "left").select("source", "target", "label", F.col("_open").isNotNull().alias("_open")).distinct(), "unfolded")
        done.append(now.where("not _open").select("source", "target", "label"))
        open_ = now.where("_open")
        if open_.isEmpty():
            return reduce(DataFrame.union, done).distinct()
        now = open_.join(inner, F.col("target") == F.col("_mid")).select("source", F.col("_to").alias("target"), fused(F.concat("label", "_l"), known).alias("label"))


def composed_closure(edges: DataFrame, table: DataFrame) -> DataFrame:
    """(source, target, label, distance): paths with their composed labels.

    One path stays for each source, target and last token: the shortest, of
    these the one with the fewest tokens, then the least text.
    """
    known = rule_map(table)
    edges = settle(edges.select("source", "target", "label").distinct(), "steps")
    step = edges.select(F.col("source").alias("_mid"), F.col("target").alias("_to"), F.col("label").alias("_l"))
    best = lambda df: df.withColumn("_k", F.struct(F.size("label").alias("n"), text("label").alias("t"), "label")).groupBy("source", "target", last("label").alias("_last")).agg(F.min("_k").alias("_k")).select("source", "target", "_last", F.col("_k.label").alias("label"))
    front = settle(best(edges).withColumn("distance", F.lit(1).cast("long")), "paths")
    parts, hops = [front], 1
    while not front.isEmpty():
        hops += 1
        longer = front.join(step, F.col("target") == F.col("_mid")).select("source", F.col("_to").alias("target"), fused(F.concat("label", "_l"), known).alias("label"))
        new = best(longer).join(reduce(DataFrame.union, parts), ["source", "target", "_last"], "left_anti")
        front = settle(new.select("source", "target", "_last", "label", F.lit(hops).cast("long").alias("distance")), "paths")
        parts.append(front)
    return reduce(DataFrame.union, parts).select("source", "target", "label", "distance")


def of_properties(edges: DataFrame, wanted: list[str]) -> DataFrame:
    """Edges with one token that is no SOME or a SOME of a wanted property; longer labels go."""
    t = F.col("label")[0]
    return edges.where((F.size("label") == 1) & (~t.startswith("SOME ") | t.isin(*[f"SOME {p}" for p in wanted])))


def without(edges: DataFrame, properties: tuple[str, ...] = (), quantifiers: tuple[str, ...] = (), targets: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Edges that no exclusion touches: of a property, of a quantifier, to a target or to targets with a prefix."""
    bad = F.exists("label", lambda t: F.substring_index(t, " ", 1).isin(*quantifiers) if quantifiers else F.lit(False))
    if properties:
        bad = bad | F.exists("label", lambda t: (F.instr(t, " ") > 0) & F.substring_index(t, " ", -1).isin(*properties))
    if targets:
        bad = bad | F.col("target").isin(*targets)
    for p in prefixes:
        bad = bad | F.col("target").startswith(p)
    return edges.where(~bad)


def between(closed: DataFrame, source, target) -> DataFrame:
    return closed.where((F.col("source") == source) & (F.col("target") == target))


def expression(label: str = "label", target: str = "target") -> Column:
    """The class expression that an edge points to, such as (part_of some R), built from its last token outwards."""

    def wrap(inner: Column, t: Column) -> Column:
        prop = F.substring_index(t, " ", -1)
        kind = F.substring_index(t, " ", 1)
        word = F.when(kind == "SOME", " some ").when(kind == "ONLY", " only ").when(kind.isin("VALUE", "ASSERT"), " value ")
        return F.when(word.isNull(), inner).otherwise(F.concat(F.lit("("), prop, word, inner, F.lit(")")))

    return F.aggregate(F.reverse(F.col(label)), F.col(target).cast("string"), wrap)


def label_text(names: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with name: the label's tokens for readers; names is (property, name), a property without one keeps its id."""
    tokens = edges.select("source", "target", "label", F.posexplode("label").alias("i", "t"))
    tokens = tokens.withColumn("property", F.when(F.instr("t", " ") > 0, F.substring_index("t", " ", -1))).join(names.select("property", "name"), "property", "left")
    word = F.when(F.col("t") == SUB, "is a").when(F.col("t") == INSTANCE, "instance of").when(F.col("t") == SAME, "same as").otherwise(F.coalesce("name", "property"))
    return tokens.groupBy("source", "target", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))), lambda s: s["w"]), ", ").alias("name"))


def relationship(label: str = "label") -> Column:
    """identity, simplesubclass or typesubclass (any other label)."""
    joined = text(label)
    return F.when(joined == SAME, "identity").when(joined == SUB, "simplesubclass").otherwise("typesubclass")


def with_label(closed: DataFrame, label: list[str], fillers: DataFrame) -> DataFrame:
    """(node): sources of edges with exactly this label to one of fillers (node) or a subclass of it."""
    below = closed.where(text("label") == SUB).join(fillers.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("target"))
    ends = below.union(fillers.select("node")).distinct()
    return closed.where(text("label") == ";".join(label)).join(ends, "target", "left_semi").select(F.col("source").alias("node")).distinct()


def instances(closed: DataFrame) -> DataFrame:
    """(cls, individual) over the closure."""
    return closed.where(text("label") == INSTANCE).select(F.col("target").alias("cls"), F.col("source").alias("individual")).distinct()


def generalised(edges: DataFrame, sub_property: DataFrame) -> DataFrame:
    """Edges under every choice of super-properties (or the property itself) for their tokens; sub_property is a closure (source, target)."""
    up = sub_property.where("source <> target").groupBy(F.col("source").alias("property")).agg(F.collect_set("target").alias("_up"))
    tokens = edges.select("source", "target", "label", F.posexplode("label").alias("i", "t")).withColumn("property", F.when(F.instr("t", " ") > 0, F.substring_index("t", " ", -1)))
    tokens = tokens.join(up, "property", "left")
    choices = F.when(F.col("property").isNull(), F.array("t")).otherwise(F.transform(F.concat(F.array("property"), F.coalesce("_up", F.array().cast("array<string>"))), lambda p: F.concat_ws(" ", F.substring_index("t", " ", 1), p)))
    rows = tokens.groupBy("source", "target", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", choices.alias("c")))), lambda s: s["c"]).alias("_c"))
    none = F.array(F.array().cast("array<string>"))
    product = F.aggregate("_c", none, lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(c, lambda x: F.concat(a, F.array(x))))))
    return rows.select("source", "target", F.explode(product).alias("label")).distinct()


def expanded_chains(chains: DataFrame) -> DataFrame:
    """(property, parts): each property that a chain (p, q, result) makes, as the list of properties that none does.

    A property with several chains has no single expansion and gets null; one
    that its own chain leads back to is not expanded further.
    """
    single = settle(chains.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("p"), F.first("q").alias("q")), "chains")
    known = single.select(F.col("result").alias("property"), F.when(F.col("n") == 1, F.array("p", "q")).alias("parts"))
    uses = known.where("parts is not null").select(F.col("property").alias("source"), F.explode("parts").alias("target"))
    step = known.where("parts is not null").join(C.on_cycles(uses).withColumnRenamed("node", "property"), "property", "left_anti").select(F.col("property").alias("_x"), F.col("parts").alias("_p"))
    step, now = settle(step, "chains"), known
    while True:
        rows = now.select("property", F.posexplode_outer("parts").alias("i", "_x")).join(F.broadcast(step), "_x", "left")  # one row a property
        after = rows.groupBy("property").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("_p", F.array("_x")).alias("g")))), lambda s: s["g"]).alias("gs"), F.max(F.col("_p").isNotNull()).alias("more"))
        now = settle(after.select("property", F.when(F.col("gs")[0][0].isNotNull(), F.flatten("gs")).alias("parts"), "more"), "expanded")
        if now.where("more").isEmpty():
            return now.select("property", "parts")
        now = now.drop("more")


def inclusions(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """(source, target, label, gci_relation, gci_filler): edges of axioms whose left side is a class and an existential."""
    parts = expressions.where("kind = 'and'").select("id", F.col("filler").alias("part"))
    some = expressions.where("kind = 'some'").select(F.col("id").alias("part"), F.col("property").alias("gci_relation"), F.col("filler").alias("gci_filler"))
    genus = parts.join(expressions.select(F.col("id").alias("part")).distinct(), "part", "left_anti").select("id", F.col("part").alias("source"))
    left = genus.join(parts.join(some, "part").select("id", "gci_relation", "gci_filler"), "id")
    return left.join(axioms.select(F.col("sub").alias("id"), F.col("sup").alias("target")), "id").select("source", "target", F.array(F.lit(SUB)).alias("label"), "gci_relation", "gci_filler").distinct()


def inclusion_closure(edges: DataFrame, table: DataFrame, conditional: DataFrame) -> DataFrame:
    """composed_closure() over edges and conditional ones (inclusions()): a path holds under one condition at most.

    Returns source, target, label, distance, gci_relation, gci_filler.
    """
    plain = edges.select("source", "target", "label")
    tagged = plain.withColumn("gci_relation", F.lit(None).cast("string")).withColumn("gci_filler", F.lit(None).cast("string"))
    condition = F.concat_ws(" ", "gci_relation", "gci_filler")
    both = tagged.union(conditional.select("source", "target", "label", "gci_relation", "gci_filler"))
    # Nodes are told apart by condition, so that a path can take on one and keep it.
    here = F.concat_ws("\u0001", "source", F.lit(""))
    free = both.where("gci_relation is null").select(here.alias("source"), F.concat_ws("\u0001", "target", F.lit("")).alias("target"), "label")
    enter = both.where("gci_relation is not null").select(here.alias("source"), F.concat_ws("\u0001", "target", condition).alias("target"), "label")
    ends = settle(conditional.select(F.col("target").alias("node"), condition.alias("_c")).distinct(), "conditions")
    above = C.walk(plain, ends).select("seed", "node").join(ends.withColumnRenamed("node", "seed"), "seed").select("node", "_c")
    inside = plain.join(above.union(ends).distinct().withColumnRenamed("node", "source"), "source").select("source", "target", "label", "_c")
    same = both.where("gci_relation is not null").select("source", "target", "label", condition.alias("_c"))
    on = inside.union(same).select(F.concat_ws("\u0001", "source", "_c").alias("source"), F.concat_ws("\u0001", "target", "_c").alias("target"), "label")
    closed = composed_closure(free.union(enter).union(on), table).where(F.col("source").endswith("\u0001"))
    end = F.substring_index("target", "\u0001", -1)
    return closed.select(
        F.substring_index("source", "\u0001", 1).alias("source"), F.substring_index("target", "\u0001", 1).alias("target"), "label", "distance",
        F.when(end != "", F.substring_index(end, " ", 1)).alias("gci_relation"), F.when(end != "", F.substring_index(end, " ", -1)).alias("gci_filler"),
    )


def more_general_condition(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """pairs (relation_a, filler_a, relation_b, filler_b) with general: a holds wherever b does (none at all, or b's filler stands under a's)."""
    above = up.select(F.col("source").alias("filler_b"), F.col("target").alias("filler_a"), F.lit(True).alias("_under")).distinct()
    out = pairs.join(above, ["filler_a", "filler_b"], "left")
    return out.select("relation_a", "filler_a", "relation_b", "filler_b", (F.col("relation_a").isNull() | F.coalesce(F.col("_under") & (F.col("relation_a") == F.col("relation_b")), F.lit(False))).alias("general"))


def source_expression() -> Column:
    """The left side of an edge of inclusions(): its class and its condition."""
    return F.when(F.col("gci_relation").isNull(), F.col("source")).otherwise(F.concat(F.lit("("), "source", F.lit(" and ("), "gci_relation", F.lit(" some "), "gci_filler", F.lit("))")))


def segment(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges of the neighbourhood graph of seeds (node): among them and all they reach, and from their children to them."""
    near = C.reached(edges, seeds)
    down = edges.join(seeds.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)
    inside = edges
    for end in ("source", "target"):
        inside = inside.join(near.select(F.col("node").alias(end)), end, "left_semi")
    return inside.select(*edges.columns).union(down).distinct()


def graph_json(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, json): nodes {id, lbl} and edges {sub, pred, obj} of a graph (source, target, property), one document a row."""
    nodes = C.nodes(edges).join(labels.select("node", "label").dropDuplicates(["node"]), "node", "left").select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"), F.col("label").alias("lbl"))).alias("json"))
    return nodes.union(edges.select(F.lit("edge"), F.to_json(F.struct(F.col("source").alias("sub"), F.col("property").alias("pred"), F.col("target").alias("obj")))))


def neighbours_of(edges: DataFrame, node, limit: int | None = None) -> DataFrame:
    """Edges that touch the node, in order of their ends; limit keeps the first ones."""
    out = edges.where((F.col("source") == node) | (F.col("target") == node)).distinct()
    return out.orderBy("source", "target", "property").limit(limit) if limit else out
