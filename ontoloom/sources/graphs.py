"""Files of graphs: closures, edges, terms, parents, graph documents, functional-style axioms, trees.

Writers make tab-separated text; lines(...) functions give what is written, one
value a row, so that writers and tests share them.  A tab or line end inside a
value becomes a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.operators import edges as E


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")


def _line(*columns: Column) -> Column:
    return F.concat_ws("\t", *[_flat(c) for c in columns]).alias("value")


def closure_lines(closed: DataFrame) -> DataFrame:
    """source, label (tokens joined by commas), distance, target."""
    return closed.select(_line(F.col("source"), F.array_join("label", ","), F.col("distance"), F.col("target")))


def compact_closure_lines(closed: DataFrame) -> DataFrame:
    """One line a source: it, then label|distance|target of each of its edges, sorted."""
    part = F.concat_ws("|", F.array_join("label", ","), F.col("distance").cast("string"), F.col("target"))
    return closed.groupBy("source").agg(F.array_sort(F.collect_list(part)).alias("p")).select(F.concat_ws("\t", F.col("source"), F.array_join("p", "\t")).alias("value"))


def read_compact_closure(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, label, distance) as compact_closure_lines() wrote them; lines without edges are left out."""
    c = spark.read.text(path).select(F.split("value", "\t").alias("c")).where("size(c) > 1")
    cut = c.select(F.col("c")[0].alias("source"), F.explode(F.slice("c", 2, 1 << 30)).alias("p")).select("source", F.split("p", r"\|", 3).alias("p"))
    return cut.select("source", F.get("p", F.lit(2)).alias("target"), F.split(F.get("p", F.lit(0)), ",").alias("label"), F.get("p", F.lit(1)).cast("long").alias("distance"))


def database_closure_lines(closed: DataFrame) -> DataFrame:
    """Property, source, target, distance of edges with one token; longer labels are left out."""
    prop = F.when(F.col("label")[0].isin(E.SUB, E.SAME), F.lit("is_a")).otherwise(F.substring_index(F.col("label")[0], " ", -1))
    return closed.where("size(label) = 1").select(_line(prop, F.col("source"), F.col("target"), F.col("distance")))


def expression_closure_lines(closed: DataFrame) -> DataFrame:
    """Source and the class expression that each of its edges points to."""
    return closed.select(F.col("source"), E.expression().alias("x")).distinct().select(_line(F.col("source"), F.col("x")))


def edge_lines(edges: DataFrame) -> DataFrame:
    """Source, property, target."""
    return edges.select("source", "property", "target").distinct().select(_line(F.col("source"), F.col("property"), F.col("target")))


def term_lines(entities: DataFrame) -> DataFrame:
    """id, label, namespace and definition of each class."""
    return entities.select(_line(*[F.col(c) for c in ("id", "label", "namespace", "definition")]))


def parent_lines(parents: DataFrame, properties: list[str]) -> DataFrame:
    """Source, then its most specific parents by each of properties, from parents (source, property, parents)."""
    cells = [F.max(F.when(F.col("property") == p, F.col("parents"))).alias(f"c{i}") for i, p in enumerate(properties)]
    return parents.groupBy("source").agg(*cells).select(_line(F.col("source"), *[F.col(f"c{i}") for i in range(len(properties))]))


def write(lines: DataFrame, path: str) -> None:
    """Text files, one a partition."""
    lines.select("value").write.text(path)


def graph_document(entities: DataFrame, edges: DataFrame, graph_id: str) -> DataFrame:
    """(value): JSON lines of a graph: a head, then one node or edge a line, so that large graphs are written and read in parallel."""
    spark = entities.sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.lit(graph_id).alias("graph"))).alias("value"))
    nodes = entities.select(F.to_json(F.struct(F.struct("id", F.col("label").alias("lbl")).alias("node"))))
    links = edges.select(F.to_json(F.struct(F.struct(F.col("source").alias("sub"), F.col("property").alias("pred"), F.col("target").alias("obj")).alias("edge"))))
    return head.union(nodes).union(links)


def read_graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, label) and edges (source, target, property) of graph_document() files."""
    rows = spark.read.schema("graph string, node struct<id:string,lbl:string>, edge struct<sub:string,pred:string,obj:string>").json(path)
    nodes = rows.where("node is not null").select("node.id", F.col("node.lbl").alias("label"))
    return nodes, rows.where("edge is not null").select(F.col("edge.sub").alias("source"), F.col("edge.obj").alias("target"), F.col("edge.pred").alias("property"))


def read_functional(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """axioms (sub, sup) and expressions (id, kind, property, filler, n) of functional-style text, one axiom a line.

    SubClassOf, EquivalentClasses of two (both ways) and ObjectUnionOf,
    ObjectIntersectionOf, ObjectSomeValuesFrom, ObjectAllValuesFrom and
    cardinalities, of names or of one another.  An expression's id is its own
    text.  Expressions are taken apart from the innermost outwards, a round a level.
    """
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"\s+", " ").alias("l"))
    lines = lines.where(F.col("l").rlike(r"^(SubClassOf|EquivalentClasses)\("))
    return functional_axioms(lines)


_KINDS = {"ObjectSomeValuesFrom": "some", "ObjectAllValuesFrom": "only", "ObjectIntersectionOf": "and", "ObjectUnionOf": "or", "ObjectComplementOf": "not", "ObjectMinCardinality": "min", "ObjectMaxCardinality": "max", "ObjectExactCardinality": "exact", "ObjectHasValue": "value"}


def functional_axioms(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from lines (l)."""
    from ontoloom.plans.session import settle

    inner = r"(Object(?:SomeValuesFrom|AllValuesFrom|IntersectionOf|UnionOf|ComplementOf|MinCardinality|MaxCardinality|ExactCardinality|HasValue)\([^()]*\))"
    now = settle(lines.select("l").distinct(), "axioms")
    found = []
    while True:
        hit = F.regexp_extract("l", inner, 1)
        open_ = settle(now.where(F.col("l").rlike(inner)).select("l", hit.alias("x")), "open")
        done = now.where(~F.col("l").rlike(inner))
        if open_.isEmpty():
            break
        found.append(open_.select("x").distinct())
        # The text of an expression in brackets of another kind is a name from now on.
        now = settle(done.union(open_.select(F.expr("replace(l, x, translate(x, '() ', ''))"))).distinct(), "axioms")
    text = lambda c: F.translate(c, "", "() ")
    body = F.split(F.regexp_extract("l", r"^\w+\((.*)\)$", 1), " ")
    both = now.select(F.substring_index("l", "(", 1).alias("kind"), body.alias("b")).where("size(b) = 2")
    sub = both.select("kind", text(F.col("b")[0]).alias("sub"), text(F.col("b")[1]).alias("sup"))
    axioms = sub.select("sub", "sup").union(sub.where("kind = 'EquivalentClasses'").select("sup", "sub")).distinct()
    if not found:
        return axioms, lines.sparkSession.createDataFrame([], "id string, kind string, property string, filler string, n int")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    word, rest = F.substring_index("x", "(", 1), F.split(F.regexp_extract("x", r"^\w+\((.*)\)$", 1), " ")
    kinds = F.create_map(*[F.lit(v) for kv in _KINDS.items() for v in kv])
    rows = every.distinct().select(text(F.col("x")).alias("id"), F.element_at(kinds, word).alias("kind"), rest.alias("r"))
    number = F.col("kind").isin("min", "max", "exact")
    pair = rows.where(F.col("kind").isin("some", "only", "value")).select("id", "kind", F.col("r")[0].alias("property"), text(F.col("r")[1]).alias("filler"), F.lit(None).cast("int").alias("n"))
    counted = rows.where(number).select("id", "kind", F.get("r", F.lit(1)), text(F.get("r", F.lit(2))), F.get("r", F.lit(0)).cast("int"))
    many = rows.where(F.col("kind").isin("and", "or", "not")).select("id", "kind", F.explode("r").alias("f")).select("id", "kind", F.lit(None).cast("string"), text(F.col("f")), F.lit(None).cast("int"))
    return axioms, pair.union(counted).union(many).distinct()


def functional_lines(axioms: DataFrame) -> DataFrame:
    """(value): SubClassOf lines; expressions' ids are their own text, as read_functional() gives them."""
    return axioms.select(F.concat(F.lit("SubClassOf("), "sub", F.lit(" "), "sup", F.lit(")")).alias("value")).distinct()


def parse_trees(trees: DataFrame) -> DataFrame:
    """(tree_id, node, parent, length, name, duplication) of nested-bracket trees (tree_id, text) with NHX comments.

    Nodes are numbered by the place where they end in the text.  A node's parent
    is the one whose brackets close around it.
    """
    # Every node ends at , or ) or ; outside comments: its label stands before.
    marks = trees.select("tree_id", F.regexp_extract_all("text", F.lit(r"(\(|[^(),;\[\]]*(?:\[[^\]]*\])?[,);])"), 1).alias("t"))
    each = marks.select("tree_id", F.posexplode("t").alias("i", "t"))
    order = Window.partitionBy("tree_id").orderBy("i")
    depth = F.sum(F.when(F.col("t") == "(", 1).when(F.col("t").endswith(")"), -1).otherwise(0)).over(order)
    # A token that ends with ")" names a node inside the brackets that it closes.
    each = each.withColumn("_after", depth).withColumn("level", F.when(F.col("t").endswith(")"), F.col("_after") + 1).otherwise(F.col("_after"))).where("t <> '('")
    nodes = each.select("tree_id", F.col("i").alias("node"), "level", "t")
    up = nodes.select("tree_id", F.col("node").alias("_n"), F.col("level").alias("_over"))
    # The parent is the next node of one level less.
    both = nodes.select("tree_id", "node", F.col("level").alias("_l"), F.lit(0).alias("_is"), "t").union(up.select("tree_id", F.col("_n"), F.col("_over") + 1, F.lit(1), F.lit(None).cast("string")))
    ahead = Window.partitionBy("tree_id", "_l").orderBy("node", "_is").rowsBetween(1, Window.unboundedFollowing)
    linked = both.withColumn("parent", F.min(F.when(F.col("_is") == 1, F.col("node"))).over(ahead)).where("_is = 0")
    label = F.regexp_extract("t", r"^([^:\[,);]*)", 1)
    length = F.regexp_extract("t", r"^[^:\[]*:([0-9.eE+-]+)", 1)
    name = F.when(label != "", label).otherwise(F.nullif(F.regexp_extract("t", r"[:&]ID=([^:\]]*)", 1), F.lit("")))
    return linked.select("tree_id", "node", "parent", F.when(length != "", length).cast("double").alias("length"), name.alias("name"), F.regexp_extract("t", r"[:&](?:D=Y|Ev=1>0)", 0).alias("_d")).select("tree_id", "node", "parent", "length", "name", (F.col("_d") != "").alias("duplication"))
