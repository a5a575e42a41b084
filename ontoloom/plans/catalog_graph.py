"""Queries of labelled closures, class expressions and graph rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.operators import labelled as L
from ontoloom.operators import rewrite as R
from ontoloom.plans import derived as D
from ontoloom.plans.register import closure_sql, query, up_sql


def _table(spark):
    properties = spark.createDataFrame([("part_of", True), ("member_of", False), ("located_in", False)], "property string, transitive boolean")
    return L.compositions(properties, spark.createDataFrame([("member_of", "part_of", "located_in")], "p string, q string, result string"))


def _closed(spark, d):
    return L.labelled_closure(D.labelled_edges(spark, d), _table(spark))


_RULES = "(VALUES ('is_a', 'is_a', 'is_a'), ('is_a', 'part_of', 'part_of'), ('part_of', 'is_a', 'part_of'), ('part_of', 'part_of', 'part_of'), ('is_a', 'member_of', 'member_of'), ('member_of', 'is_a', 'member_of'), ('is_a', 'located_in', 'located_in'), ('located_in', 'is_a', 'located_in'), ('member_of', 'part_of', 'located_in')) r(a, b, result)"
_CLOSED = f"WITH RECURSIVE e AS ({D.LABELLED}), c(source, target, property, distance) AS (SELECT source, target, property, 1 FROM e UNION SELECT c.source, e.target, r.result, c.distance + 1 FROM c JOIN e ON c.target = e.source JOIN {_RULES} ON r.a = c.property AND r.b = e.property), closed AS (SELECT source, target, property, CAST(min(distance) AS BIGINT) AS distance FROM c GROUP BY 1, 2, 3), nodes AS (SELECT source AS node FROM e UNION SELECT target FROM e)"


@query("labelled_closure", _CLOSED + " SELECT * FROM closed")
def labelled_closure(spark, d):
    return _closed(spark, d)


@query("labelled_closure_super_properties", _CLOSED + ", m AS (SELECT * FROM closed UNION ALL SELECT source, target, 'located_in', distance FROM closed WHERE property = 'part_of') SELECT source, target, property, min(distance) AS distance FROM m GROUP BY 1, 2, 3")
def labelled_closure_super_properties(spark, d):
    return L.with_super_properties(_closed(spark, d), spark.createDataFrame([("part_of", "located_in")], "source string, target string"))


@query("closure_of_listed_properties", _CLOSED.replace("SELECT source, target, property, 1 FROM e", "SELECT source, target, property, 1 FROM e WHERE property <> 'member_of'") + " SELECT * FROM closed")
def closure_of_listed_properties(spark, d):
    wanted = spark.createDataFrame([("part_of",)], "property string")
    return L.labelled_closure(L.only_properties(D.labelled_edges(spark, d), wanted), _table(spark))


_SOME = "SELECT source FROM closed WHERE property = 'part_of' AND target IN (SELECT source FROM closed WHERE property = 'is_a' AND target = 'R:1' UNION SELECT 'R:1')"


def _answer(spark, d, expression):
    return L.members(expression, _closed(spark, d), C.nodes(D.labelled_edges(spark, d)))


@query("class_query_some", _CLOSED + f" SELECT DISTINCT source AS node FROM ({_SOME})")
def class_query_some(spark, d):
    return _answer(spark, d, ("some", "part_of", "R:1"))


@query("class_query_and_not", _CLOSED + f" SELECT node FROM nodes WHERE node IN ({_SOME}) AND node NOT IN (SELECT source FROM closed WHERE property = 'is_a' AND target = 'N:1' UNION SELECT 'N:1')")
def class_query_and_not(spark, d):
    return _answer(spark, d, ("and", ("some", "part_of", "R:1"), ("not", "N:1")))


@query("class_query_or", _CLOSED + " SELECT node FROM nodes WHERE node IN ('N:1', 'N:2') OR node IN (SELECT source FROM closed WHERE property = 'is_a' AND target IN ('N:1', 'N:2'))")
def class_query_or(spark, d):
    return _answer(spark, d, ("or", "N:1", "N:2"))


def _top(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


@query("filter_subgraph", up_sql(D.GEO) + ", k AS (SELECT source AS node FROM up WHERE target = 'N:1' UNION SELECT target FROM up WHERE source = 'N:1') SELECT DISTINCT source, target FROM e WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)")
def filter_subgraph(spark, d):
    return R.filter_subgraph(D.geo_edges(spark, d), _top(spark, "N:1"))


@query("remove_subgraph", up_sql(D.PART) + ", g AS (SELECT source AS node FROM up WHERE target = 'S:2') SELECT DISTINCT source, target FROM e WHERE source NOT IN (SELECT node FROM g) AND target NOT IN (SELECT node FROM g)")
def remove_subgraph(spark, d):
    return R.remove_subgraph(D.part_edges(spark, d), _top(spark, "S:2"))


@query("remove_subgraph_keep_shared", up_sql(D.PART) + ", g AS (SELECT source AS node FROM up WHERE target = 'S:2'), re AS (SELECT * FROM e WHERE source <> 'S:2' AND target <> 'S:2'), rc(source, target) AS (SELECT source, target FROM re UNION SELECT rc.source, re.target FROM rc JOIN re ON rc.target = re.source), x AS (SELECT node FROM g WHERE node NOT IN (SELECT source FROM rc WHERE target NOT IN (SELECT node FROM g))) SELECT DISTINCT source, target FROM e WHERE source NOT IN (SELECT node FROM x) AND target NOT IN (SELECT node FROM x)")
def remove_subgraph_keep_shared(spark, d):
    return R.remove_subgraph(D.part_edges(spark, d), _top(spark, "S:2"), keep_shared=True)


@query("minimal_subset", closure_sql(D.GEO) + " SELECT source, target FROM closed WHERE source LIKE 'C:%' AND target LIKE 'R:%' UNION SELECT source, target FROM closed WHERE source LIKE 'R:%'")
def minimal_subset(spark, d):
    edges = D.geo_edges(spark, d)
    return R.minimal_subset(edges, C.nodes(edges).where("node not like 'N:%'"))


@query("map_relations_to_parent", f"SELECT DISTINCT source, target, CASE WHEN property IN ('part_of', 'member_of') THEN 'located_in' ELSE property END AS property FROM ({D.LABELLED})")
def map_relations_to_parent(spark, d):
    subs = spark.createDataFrame([("member_of", "part_of"), ("part_of", "located_in"), ("located_in", "related")], "source string, target string")
    return R.map_relations(D.labelled_edges(spark, d), subs, spark.createDataFrame([("related",), ("located_in",)], "property string"))


@query("relations_removed", f"SELECT source, target, property FROM ({D.LABELLED}) WHERE property <> 'part_of'")
def relations_removed(spark, d):
    return L.without_properties(D.labelled_edges(spark, d), spark.createDataFrame([("part_of",)], "property string")).distinct()


@query("drop_edges_to_subsets", f"WITH e AS ({D.PART}) SELECT source, target FROM e WHERE target NOT LIKE 'S:%'")
def drop_edges_to_subsets(spark, d):
    edges = D.part_edges(spark, d)
    return R.drop_edges_to_subsets(edges, C.nodes(edges).where("node like 'S:%'"))


@query("obsolete_removed", f"WITH e AS ({D.PART}) SELECT source, target FROM e WHERE source NOT LIKE 'B:%' AND target NOT LIKE 'B:%'")
def obsolete_removed(spark, d):
    edges = C.clean(D.part_edges(spark, d))
    return R.without_nodes(edges, C.nodes(edges).where("node like 'B:%'"))


@query("bridging_edges", f"SELECT DISTINCT source, target, split_part(source, ':', 1) AS space_a, CASE WHEN target LIKE '%:%' THEN split_part(target, ':', 1) ELSE '' END AS space_b FROM ({D.GEO})")
def bridging_edges(spark, d):
    return R.bridging(D.geo_edges(spark, d))


@query("external_references", f"SELECT DISTINCT target AS node FROM ({D.PART}) WHERE target LIKE 'S:%'")
def external_references(spark, d):
    edges = D.part_edges(spark, d)
    return R.external_references(edges, C.nodes(edges).where("node not like 'S:%'"))


@query("reference_closure", up_sql(D.GEO) + " SELECT DISTINCT target AS node FROM up WHERE source IN ('C:1', 'C:2')")
def reference_closure(spark, d):
    return R.reference_closure(D.geo_edges(spark, d), _top(spark, "C:1", "C:2"))


@query("redundant_with_witnesses", f"SELECT source, 'ROOT' AS target, string_agg(DISTINCT target, ',' ORDER BY target) AS witnesses FROM ({D.PART}) WHERE source LIKE 'P:%' GROUP BY 1")
def redundant_with_witnesses(spark, d):
    edges = D.part_edges(spark, d)
    return R.redundant_with_witness(edges.union(edges.where("source like 'P:%'").select("source", F.lit("ROOT"))))


@query("merge_equivalents", f"WITH l AS (SELECT 'U:' || p_size AS node, min('P:' || p_partkey) AS leader FROM part GROUP BY 1), m AS (SELECT 'P:' || p_partkey AS node, leader FROM part JOIN l ON l.node = 'U:' || p_size) SELECT DISTINCT coalesce(a.leader, source) AS source, target FROM ({D.PART}) LEFT JOIN m a ON a.node = source")
def merge_equivalents(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    same = part.select(F.col("p_size").alias("group_id"), F.concat(F.lit("P:"), "p_partkey").alias("node"))
    return R.merge_equivalents(D.part_edges(spark, d), same, spark.createDataFrame([("P", 1)], "prefix string, score int"))[0]
