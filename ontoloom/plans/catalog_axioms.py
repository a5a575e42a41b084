"""Queries of axiom rewrites, entity lookups, checks, and files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import axioms as A
from ontoloom.operators import closure as C
from ontoloom.operators import edges as E
from ontoloom.plans import catalog_edges as G
from ontoloom.plans import derived as D
from ontoloom.plans import derived_axioms as X
from ontoloom.plans.register import query, up_sql
from ontoloom.plans.session import shared_path
from ontoloom.sources import graphs


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def _few(spark, names, kind="node string"):
    return spark.createDataFrame([(n,) for n in names], kind)


@query("equivalents_as_axioms", "SELECT 'P:' || p_partkey AS sub, 'Q:' || p_partkey AS sup FROM part UNION SELECT 'Q:' || p_partkey, 'P:' || p_partkey FROM part")
def equivalents_as_axioms(spark, d):
    return A.equivalents_as_axioms(_part(spark, d).select(F.concat(F.lit("P:"), "p_partkey").alias("a"), F.concat(F.lit("Q:"), "p_partkey").alias("b")))


@query("split_intersections", f"SELECT DISTINCT sub, sup FROM ({X.AXIOMS}) WHERE sup NOT LIKE 'A:%' UNION SELECT 'U:' || s_suppkey, 'COMPANY' FROM supplier UNION SELECT 'U:' || s_suppkey, 'X:member_of:N:' || s_nationkey FROM supplier")
def split_intersections(spark, d):
    return A.split_intersections(X.axioms(spark, d), X.expressions(spark, d))


def _unions(spark, d):
    c = _part(spark, d)
    axioms = c.select(F.concat(F.lit("ANY:"), "p_brand").alias("sub"), F.lit("THING").alias("sup")).distinct()
    none = F.lit(None)
    return axioms, c.select(F.concat(F.lit("ANY:"), "p_brand").alias("id"), F.lit("or").alias("kind"), none.cast("string").alias("property"), F.concat(F.lit("P:"), "p_partkey").alias("filler"), none.cast("int").alias("n"))


@query("union_operands", "SELECT 'P:' || p_partkey AS sub, 'THING' AS sup FROM part")
def union_operands(spark, d):
    return A.union_operands(*_unions(spark, d))


@query("unions_removed", f"SELECT DISTINCT sub, sup FROM ({X.AXIOMS}) WHERE sub LIKE 'R:%'")
def unions_removed(spark, d):
    axioms, unions = _unions(spark, d)
    return A.without_unions(X.axioms(spark, d).where("sub like 'R:%'").union(axioms), unions)


_CARD = "SELECT 'E:' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'min' WHEN 1 THEN 'max' ELSE 'exact' END AS kind, 'has' AS property, 'S:' || p_size AS filler, p_size % 4 AS n FROM part"


def _cardinal(spark, d):
    k = F.col("p_partkey") % 3
    return _part(spark, d).select(F.concat(F.lit("E:"), "p_partkey").alias("id"), F.when(k == 0, "min").when(k == 1, "max").otherwise("exact").alias("kind"), F.lit("has").alias("property"), F.concat(F.lit("S:"), "p_size").alias("filler"), (F.col("p_size") % 4).cast("int").alias("n"))


@query("cardinalities_found", f"SELECT * FROM ({_CARD})")
def cardinalities_found(spark, d):
    return A.cardinalities(_cardinal(spark, d))


@query("cardinalities_removed", f"SELECT id, 'some' AS kind, property, filler, CAST(NULL AS INT) AS n FROM ({_CARD}) WHERE kind <> 'max' AND n > 0")
def cardinalities_removed(spark, d):
    return A.without_cardinalities(_cardinal(spark, d))


@query("reduced_over_part_of", f"SELECT source, target, property FROM ({D.LABELLED})")
def reduced_over_part_of(spark, d):
    edges = D.labelled_edges(spark, d)
    more = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), "n_nationkey").alias("source"), F.lit("ROOT").alias("target"), F.lit("part_of").alias("property"))
    return A.reduced_over(edges.union(more), ("part_of",))


@query("related_properties", "SELECT 'q:1' AS property UNION SELECT 'related' UNION SELECT 'p:' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 'm:' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 UNION SELECT unnest(['x:', 'y:', 'same:']) || n_nationkey FROM nation WHERE n_regionkey = 1")
def related_properties(spark, d):
    """What bears on q:1: m:s of suppliers under p:n of nations under q:r of regions, chains that give p:n, and their equals."""
    n, s, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "supplier", "region"))
    of = lambda a, k: F.concat(F.lit(a), F.col(k))
    pair = lambda df, a, b: df.select(a.alias("a"), b.alias("b"))
    below = pair(s, of("m:", "s_suppkey"), of("p:", "s_nationkey")).union(pair(n, of("p:", "n_nationkey"), of("q:", "n_regionkey"))).union(pair(r, of("q:", "r_regionkey"), F.lit("related")))
    chains = n.select(of("x:", "n_nationkey").alias("p"), of("y:", "n_nationkey").alias("q"), of("p:", "n_nationkey").alias("result"))
    return A.related_properties(_few(spark, ["q:1"], "property string"), below, chains, pair(n, of("same:", "n_nationkey"), of("x:", "n_nationkey")))


@query("changed_edges", f"SELECT source, target, property FROM ({D.LABELLED}) WHERE source <> 'N:1' AND target <> 'N:1' AND NOT (source = 'R:1' AND target = 'ROOT') UNION SELECT 'new', 'ROOT', 'is_a'")
def changed_edges(spark, d):
    edge = lambda *r: spark.createDataFrame([r], "source string, target string, property string")
    return A.changed_edges(D.labelled_edges(spark, d), add=edge("new", "ROOT", "is_a"), remove=edge("R:1", "ROOT", "is_a"), without=_few(spark, ["N:1"]))


@query("axioms_within", f"SELECT DISTINCT sub, sup FROM ({X.AXIOMS}) WHERE sub LIKE 'N:%' OR sub LIKE 'R:%' OR sub LIKE 'P:%'")
def axioms_within(spark, d):
    ax, ex = X.axioms(spark, d), X.expressions(spark, d)
    names = ax.select(F.col("sub").alias("node")).union(ax.select("sup")).union(ex.select("filler")).where("node like 'N:%' or node like 'R:%' or node like 'P:%' or node = 'ROOT'")
    return A.axioms_within(ax, ex, names)


@query("classes_outside_space", f"SELECT DISTINCT target AS node FROM ({D.PART}) WHERE target NOT LIKE 'S:%'")
def classes_outside_space(spark, d):
    nodes = D.part_edges(spark, d).select(F.col("target").alias("node"))
    return A.classes_of(nodes, nodes, space="S", others=True)


@query("classes_of_subset", "SELECT DISTINCT 'P:' || p_partkey AS node FROM part WHERE p_size < 10")
def classes_of_subset(spark, d):
    p = _part(spark, d).select(F.concat(F.lit("P:"), "p_partkey").alias("node"), F.when(F.col("p_size") < 10, "small").otherwise("large").alias("subset"))
    return A.classes_of(p, p, subset="small")


@query("edges_in_properties", f"SELECT source, target, CASE property WHEN 'part_of' THEN 'located_in' ELSE property END AS property FROM ({D.LABELLED}) WHERE property <> 'member_of'")
def edges_in_properties(spark, d):
    subs = spark.createDataFrame([("part_of", "located_in")], "source string, target string")
    return A.in_properties(D.labelled_edges(spark, d), subs, _few(spark, ["located_in"], "property string"))


@query("disjoint_pairs", "SELECT 'N:' || a.n_nationkey AS a, 'N:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND 'N:' || a.n_nationkey < 'N:' || b.n_nationkey")
def disjoint_pairs(spark, d):
    return A.disjoint_expressions(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("group_id"), F.concat(F.lit("N:"), "n_nationkey").alias("node")))


@query("axioms_about_tagged", f"SELECT source, target FROM ({D.PART}) WHERE source IN (SELECT 'P:' || p_partkey FROM part WHERE p_size = 1)")
def axioms_about_tagged(spark, d):
    notes = _part(spark, d).select(F.concat(F.lit("P:"), "p_partkey").alias("id"), F.lit("size").alias("property"), F.col("p_size").cast("string").alias("value"))
    return A.about(D.part_edges(spark, d), A.tagged(notes, "size", "1"))


@query("justified_edges", f"SELECT source, target, FALSE AS inferable FROM ({D.PART}) UNION ALL SELECT 'P:' || p_partkey, 'ROOT', TRUE FROM part")
def justified_edges(spark, d):
    edges = D.part_edges(spark, d)
    return A.justified(edges.union(edges.where("source like 'P:%'").select("source", F.lit("ROOT"))))


@query("explained_paths", "SELECT 'R:' || n_regionkey AS holder, 'C:1 > N:' || c_nationkey || ' > R:' || n_regionkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1 UNION ALL SELECT 'ROOT', 'C:1 > N:' || c_nationkey || ' > R:' || n_regionkey || ' > ROOT' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def explained_paths(spark, d):
    edges = D.geo_edges(spark, d)
    return A.explained(edges, "C:1", C.nodes(edges).where("node like 'R%'"))


@query("species_view", f"SELECT DISTINCT CASE WHEN source LIKE 'N:%' THEN 'own-' || source ELSE source || '-x' END AS source, CASE WHEN target LIKE 'N:%' THEN 'own-' || target ELSE target || '-x' END AS target, property FROM ({D.LABELLED})")
def species_view(spark, d):
    own = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.concat(F.lit("own-N:"), "n_nationkey").alias("own"))
    return A.species_view(D.labelled_edges(spark, d), own, "-x")


@query("copied_edges", f"SELECT 'm-' || source AS source, 'm-' || target AS target, property FROM ({D.LABELLED}) WHERE source LIKE 'N:%'")
def copied_edges(spark, d):
    edges = D.labelled_edges(spark, d)
    mapped = C.nodes(edges).where("node like 'N:%' or node like 'R:%'").select("node", F.concat(F.lit("m-"), "node").alias("other"))
    return A.copied(edges, mapped)


@query("properties_used", "SELECT unnest(['part_of', 'located_in', 'member_of']) AS property")
def properties_used(spark, d):
    return A.properties_used(D.labelled_edges(spark, d), spark.createDataFrame([("part_of", "located_in"), ("other", "located_in")], "a string, b string"))


@query("edges_as_individuals", f"SELECT 'i:' || source AS a, CASE property WHEN 'is_a' THEN 'type_of_level' ELSE property END AS property, 'i:' || target AS b FROM ({D.LABELLED})")
def edges_as_individuals(spark, d):
    return A.as_individuals(D.labelled_edges(spark, d))


@query("linked_by_pattern", "SELECT 'DP:' || p_partkey AS source, 'S:' || p_size AS target, 'sized' AS property FROM part")
def linked_by_pattern(spark, d):
    definitions = X.definitions(spark, d)
    genus = definitions.where("property is null").select(F.col("cls").alias("source"), F.col("filler").alias("target"))
    return A.linked_by_pattern(definitions, spark.createDataFrame([("ITEM", "has_size", "sized")], "genus string, relation string, result string"), C.reflexive(genus))


@query("edited_annotations", "SELECT p_partkey AS id, 'colour=' || p_brand || ';note=x' AS notes FROM part")
def edited_annotations(spark, d):
    pair = lambda p, v: F.struct(F.lit(p).alias("prop"), v.alias("value"))
    notes = F.array(pair("brand", F.col("p_brand")), pair("size", F.col("p_size").cast("string")), pair("brand", F.col("p_brand")))
    edited = A.edited_annotations(F.col("notes"), drop=("size",), rename={"brand": "colour"}, add=[("note", "x")])
    return _part(spark, d).select(F.col("p_partkey").alias("id"), notes.alias("notes")).select("id", F.array_join(F.transform(edited, lambda s: F.concat_ws("=", s["prop"], s["value"])), ";").alias("notes"))


def _entities(spark, d):
    """A class a part: every seventh is obsolete; its alternative id is that of the part 1000 further on."""
    p = _part(spark, d)
    key = F.col("p_partkey")
    follow = F.when(key % 14 == 0, F.concat(F.lit("P:"), key + 1))
    return p.select(
        F.concat(F.lit("P:"), key).alias("id"), F.lit("class").alias("kind"), F.col("p_name").alias("label"), F.lit("goods").alias("namespace"), F.col("p_type").alias("definition"), (key % 7 == 0).alias("is_obsolete"), follow.alias("replaced_by"),
        F.when(key % 21 == 7, F.array(F.concat(F.lit("P:"), key + 2))).otherwise(F.array().cast("array<string>")).alias("consider"), F.array(F.concat(F.lit("P:"), key + 100)).alias("alt_ids"), F.array(F.concat(F.lit("BR:"), F.col("p_brand"))).alias("xrefs"),
    )


@query("real_classes", "SELECT 'P:' || p_partkey AS id FROM part WHERE p_partkey % 7 <> 0 AND p_partkey - 100 NOT IN (SELECT p_partkey FROM part)")
def real_classes(spark, d):
    return A.real_classes(_entities(spark, d))


@query("node_categories", f"SELECT DISTINCT target AS node, CASE WHEN target LIKE 'S:%' THEN 'size' WHEN target LIKE 'B:%' THEN 'brand' ELSE 'other' END AS category FROM ({D.PART})")
def node_categories(spark, d):
    nodes = D.part_edges(spark, d).select(F.col("target").alias("node")).distinct()
    return A.categories(nodes, spark.createDataFrame([("S", "size"), ("B", "brand")], "space string, category string"), "other")


@query("addresses", "SELECT 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS id, 'http://purl.obolibrary.org/obo/GO_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS iri FROM part")
def addresses(spark, d):
    short = _part(spark, d).select(F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"))
    there = short.select(A.iri_of(F.col("id")).alias("iri"))
    return there.select(A.id_of(F.col("iri")).alias("id"), "iri")


@query("by_label", "SELECT p_name AS label, CASE WHEN count(*) = 1 THEN 'P:' || min(p_partkey) END AS id, count(*) AS n FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey <= 50) GROUP BY 1")
def by_label(spark, d):
    return A.by_label(_entities(spark, d), _part(spark, d).where("p_partkey <= 50").select(F.col("p_name").alias("label")))


@query("by_alternative_id", "SELECT 'P:' || (p_partkey + 100) AS alt_id, 'P:' || p_partkey AS id FROM part")
def by_alternative_id(spark, d):
    return A.by_alternative_id(_entities(spark, d))


@query("merged_labels", "SELECT 'P:' || p_partkey AS id, CASE WHEN p_size < 20 THEN p_name ELSE p_type END AS label FROM part")
def merged_labels(spark, d):
    p = _part(spark, d).withColumn("id", F.concat(F.lit("P:"), "p_partkey"))
    return A.merged([p.select("id", F.when(F.col("p_size") < 20, F.col("p_name")).alias("label")), p.select("id", F.col("p_type").alias("label"))])


@query("restricted_to_taxa", up_sql(D.PART) + " SELECT source AS cls, 'T:' || target AS taxon FROM up WHERE target LIKE 'S:%'")
def restricted_to_taxa(spark, d):
    only = C.nodes(D.part_edges(spark, d)).where("node like 'S:%'").select(F.col("node").alias("cls"), F.concat(F.lit("T:"), "node").alias("taxon"))
    return A.restricted_to_taxa(C.reflexive(D.part_edges(spark, d)), only)


_ENT = "SELECT 'P:' || p_partkey AS id, p_partkey % 7 = 0 AS gone FROM part"


@query("signature_problems", f"WITH x AS (SELECT 'L:' || l_orderkey AS source, 'P:' || (l_partkey + 150) AS target FROM lineitem UNION SELECT 'L:' || l_orderkey, 'P:' || l_partkey FROM lineitem), k AS ({_ENT}) SELECT DISTINCT source, target, CASE WHEN gone THEN 'obsolete' WHEN gone IS NULL AND target IN (SELECT 'P:' || (p_partkey + 100) FROM part) THEN 'alternative_id' ELSE 'undeclared' END AS problem FROM x LEFT JOIN k ON id = target WHERE gone IS NULL OR gone")
def signature_problems(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    edges = l.select(F.concat(F.lit("L:"), "l_orderkey").alias("source"), F.concat(F.lit("P:"), F.col("l_partkey") + 150).alias("target")).union(l.select(F.concat(F.lit("L:"), "l_orderkey"), F.concat(F.lit("P:"), "l_partkey")))
    names = edges.select(F.col("source").alias("id")).distinct()
    known = _entities(spark, d).select("id", "is_obsolete", "alt_ids").union(names.select("id", F.lit(False), F.array().cast("array<string>")))
    return A.signature_problems(edges, known)


@query("self_references", "SELECT 'Q:' || p_partkey AS cls FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 10 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part)")
def self_references(spark, d):
    p = _part(spark, d).where("p_partkey % 10 = 0")
    here, there = F.concat(F.lit("Q:"), "p_partkey"), F.concat(F.lit("Q:"), F.col("p_partkey") + 1)
    genus = F.lit(None).cast("string").alias("property")
    cyclic = p.select(here.alias("cls"), genus, there.alias("filler")).union(p.select(there, genus, here))
    return A.self_references(cyclic).join(_part(spark, d).select(F.concat(F.lit("Q:"), "p_partkey").alias("cls")), "cls", "left_semi")


@query("cross_references", "SELECT 'BR' AS space, 'BR:' || p_brand AS xref, string_agg('P:' || p_partkey, ',' ORDER BY 'P:' || p_partkey) AS ids FROM part GROUP BY p_brand")
def cross_references(spark, d):
    return A.cross_references(_entities(spark, d))


@query("obsolete_terms", "SELECT 'P:' || p_partkey AS id, CASE WHEN p_partkey % 14 = 0 THEN 'exact' WHEN p_partkey % 21 = 7 THEN 'inexact' ELSE 'none' END AS kind, CASE WHEN p_partkey % 14 = 0 THEN 'P:' || (p_partkey + 1) WHEN p_partkey % 21 = 7 THEN 'P:' || (p_partkey + 2) END AS other FROM part WHERE p_partkey % 7 = 0 UNION SELECT 'P:' || p_partkey, 'inexact', 'P:' || (p_partkey + 2) FROM part WHERE p_partkey % 21 = 7 AND p_partkey % 7 = 0")
def obsolete_terms(spark, d):
    return A.obsolete_terms(_entities(spark, d))


@query("check_summary", "WITH p AS (SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 7 = 0 THEN ['obsolete', 'odd'] ELSE ['odd'] END) AS problem FROM part WHERE p_size < 30) SELECT CASE problem WHEN 'obsolete' THEN 'fatal' ELSE 'warning' END AS severity, count(*) AS n_problems, count(DISTINCT id) AS n_classes FROM p GROUP BY 1")
def check_summary(spark, d):
    p = _part(spark, d).where("p_size < 30")
    words = F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("obsolete"), F.lit("odd"))).otherwise(F.array(F.lit("odd")))
    return A.check_summary(p.select(F.col("p_partkey").alias("id"), F.explode(words).alias("problem")), ("obsolete",))


_PARENTS = f"SELECT source, property, string_agg(target, ',' ORDER BY target) AS parents FROM ({D.LABELLED}) GROUP BY 1, 2"


def _by_property(spark, d):
    edges = D.labelled_edges(spark, d)
    shortcut = edges.where("source like 'C:%'").select("source", F.lit("ROOT").alias("target"), "property")
    return A.parents_by_property(edges.union(shortcut), C.closure(D.geo_edges(spark, d)))


@query("parents_by_property", _PARENTS)
def parents_by_property(spark, d):
    return _by_property(spark, d)


# Files, written and read again.


def _again(spark, lines, label):
    path = shared_path(spark, label)
    graphs.write(lines, path)
    return path


_FIRST = G._PATHS


@query("file_closure", _FIRST + " SELECT source || chr(9) || replace(label, ';', ',') || chr(9) || distance || chr(9) || target AS value FROM closed")
def file_closure(spark, d):
    return spark.read.text(_again(spark, graphs.closure_lines(G._closed(spark, d)), "closure-text"))


@query("file_compact_closure", _FIRST + " SELECT * FROM closed")
def file_compact_closure(spark, d):
    path = _again(spark, graphs.compact_closure_lines(G._closed(spark, d)), "closure-text")
    return G._shown(graphs.read_compact_closure(spark, path))


@query("file_database_closure", _FIRST + " SELECT CASE label WHEN 'SUBCLASS_OF' THEN 'is_a' ELSE split_part(label, ' ', 2) END || chr(9) || source || chr(9) || target || chr(9) || distance AS value FROM closed WHERE label NOT LIKE '%;%'")
def file_database_closure(spark, d):
    return spark.read.text(_again(spark, graphs.database_closure_lines(G._closed(spark, d)), "closure-text"))


@query("file_edges", f"SELECT source || chr(9) || property || chr(9) || target AS value FROM ({D.LABELLED})")
def file_edges(spark, d):
    return spark.read.text(_again(spark, graphs.edge_lines(D.labelled_edges(spark, d)), "edge-text"))


@query("file_terms", "SELECT 'P:' || p_partkey || chr(9) || p_name || chr(9) || 'goods' || chr(9) || p_type AS value FROM part")
def file_terms(spark, d):
    return spark.read.text(_again(spark, graphs.term_lines(_entities(spark, d)), "term-text"))


@query("file_parents", f"WITH p AS ({_PARENTS}) SELECT source || chr(9) || coalesce(max(parents) FILTER (WHERE property = 'is_a'), '') || chr(9) || coalesce(max(parents) FILTER (WHERE property = 'part_of'), '') AS value FROM p GROUP BY source")
def file_parents(spark, d):
    return spark.read.text(_again(spark, graphs.parent_lines(_by_property(spark, d), ["is_a", "part_of"]), "parent-text"))


@query("file_graph_document", f"SELECT source, target, property, 'node ' || n_name AS label FROM ({D.LABELLED}) LEFT JOIN nation ON source = 'N:' || n_nationkey")
def file_graph_document(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.concat(F.lit("node "), "n_name").alias("label"))
    nodes, edges = graphs.read_graph_document(spark, _again(spark, graphs.graph_document(names, D.labelled_edges(spark, d), "goods"), "graph-json"))
    return edges.join(nodes.withColumnRenamed("id", "source"), "source", "left").select("source", "target", "property", "label")


_FUNCTIONAL = "SELECT 'C:' || c_custkey AS sub, 'ObjectIntersectionOf(N:' || c_nationkey || ' ObjectSomeValuesFrom(buys ObjectUnionOf(S:' || (c_custkey % 3) || ' S:x)))' AS sup FROM customer"


def _functional(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    text = F.concat(F.lit("SubClassOf(C:"), "c_custkey", F.lit("  ObjectIntersectionOf(N:"), "c_nationkey", F.lit(" ObjectSomeValuesFrom(buys ObjectUnionOf(S:"), F.col("c_custkey") % 3, F.lit(" S:x))))"))
    path = _again(spark, c.select(text.alias("value")), "axiom-text")
    return graphs.read_functional(spark, path)


@query("file_functional_axioms", _FUNCTIONAL)
def file_functional_axioms(spark, d):
    axioms, _ = _functional(spark, d)
    return graphs.functional_lines(axioms).select(F.regexp_extract("value", r"^SubClassOf\((\S+) (.*)\)$", 1).alias("sub"), F.regexp_extract("value", r"^SubClassOf\((\S+) (.*)\)$", 2).alias("sup"))


@query("file_functional_expressions", "WITH f AS (SELECT c_custkey % 3 AS k, c_nationkey AS n FROM customer), u AS (SELECT *, 'ObjectUnionOf(S:' || k || ' S:x)' AS u FROM f), s AS (SELECT *, 'ObjectSomeValuesFrom(buys ' || u || ')' AS s FROM u), a AS (SELECT *, 'ObjectIntersectionOf(N:' || n || ' ' || s || ')' AS a FROM s) SELECT u AS id, 'or' AS kind, NULL AS property, 'S:' || k AS filler FROM a UNION SELECT u, 'or', NULL, 'S:x' FROM a UNION SELECT s, 'some', 'buys', u FROM a UNION SELECT a, 'and', NULL, s FROM a UNION SELECT a, 'and', NULL, 'N:' || n FROM a")
def file_functional_expressions(spark, d):
    return _functional(spark, d)[1].select("id", "kind", "property", "filler")


@query("tree_nodes", "SELECT r_regionkey AS tree_id, 'N:' || n_nationkey AS name, 'R:' || r_regionkey AS parent, n_nationkey / 2 AS length, n_nationkey % 2 = 0 AS duplication FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey, 'R:' || r_regionkey, 'TOP', 0.5, TRUE FROM region UNION ALL SELECT r_regionkey, 'side', 'TOP', 1.5, FALSE FROM region UNION ALL SELECT r_regionkey, 'TOP', NULL, NULL, FALSE FROM region")
def tree_nodes(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    leaf = F.concat(F.lit("N:"), "n_nationkey")
    leaf = F.concat(F.lit("[&&NHX:ID="), F.replace(leaf, F.lit(":"), F.lit("_")), F.when(F.col("n_nationkey") % 2 == 0, ":Ev=1>0").otherwise(""), F.lit("]"))
    leaf = F.concat(F.lit(":"), (F.col("n_nationkey") / 2).cast("string"), leaf)
    inner = n.groupBy(F.col("n_regionkey").alias("tree_id")).agg(F.array_join(F.array_sort(F.collect_list(leaf)), ",").alias("t"))
    nodes = graphs.parse_trees(inner.select("tree_id", F.expr("concat('((', t, ')R_', tree_id, ':0.5[&&NHX:D=Y],side:1.5)TOP;')").alias("text")))
    up = nodes.select("tree_id", F.col("node").alias("parent"), F.col("name").alias("_p"))
    colon = lambda c: F.replace(c, F.lit("_"), F.lit(":"))
    return nodes.join(up, ["tree_id", "parent"], "left").select("tree_id", colon(F.col("name")).alias("name"), colon(F.col("_p")).alias("parent"), "length", "duplication")
