"""Queries of quantified edges, conditional axioms and reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.operators import edges as E
from ontoloom.operators import labelled as L
from ontoloom.operators import reasoning as R
from ontoloom.plans import derived as D
from ontoloom.plans import derived_axioms as X
from ontoloom.plans.register import closure_sql, query, up_sql

_RULES = "(VALUES ('SUBCLASS_OF', 'SUBCLASS_OF', 'SUBCLASS_OF'), ('SUBCLASS_OF', 'SOME part_of', 'SOME part_of'), ('SOME part_of', 'SUBCLASS_OF', 'SOME part_of'), ('SOME part_of', 'SOME part_of', 'SOME part_of'), ('SUBCLASS_OF', 'SOME member_of', 'SOME member_of'), ('SOME member_of', 'SUBCLASS_OF', 'SOME member_of'), ('SUBCLASS_OF', 'SOME located_in', 'SOME located_in'), ('SOME located_in', 'SUBCLASS_OF', 'SOME located_in'), ('SOME member_of', 'SOME part_of', 'SOME located_in'), ('SUBCLASS_OF', 'SOME made_in', 'SOME made_in'), ('SOME made_in', 'SUBCLASS_OF', 'SOME made_in'), ('SUBCLASS_OF', 'ONLY trades_in', 'ONLY trades_in'), ('ONLY trades_in', 'SUBCLASS_OF', 'ONLY trades_in')) r(a, b, result)"
_NAMED = f"WITH RECURSIVE e AS ({X.NAMED})"
_PATHS = _NAMED + f", c(source, target, label, distance) AS (SELECT source, target, label, 1 FROM e UNION SELECT c.source, e.target, CASE WHEN r.result IS NULL THEN c.label || ';' || e.label ELSE regexp_replace(c.label, '[^;]+$', r.result) END, c.distance + 1 FROM c JOIN e ON c.target = e.source LEFT JOIN {_RULES} ON r.a = regexp_extract(c.label, '[^;]+$') AND r.b = e.label), closed AS (SELECT source, target, min(label) AS label, CAST(min(distance) AS BIGINT) AS distance FROM c GROUP BY source, target, regexp_extract(label, '[^;]+$'))"


def _rules(spark):
    properties = spark.createDataFrame([("part_of", True), ("member_of", False), ("located_in", False), ("made_in", False), ("trades_in", False)], "property string, transitive boolean")
    return E.rules(properties, spark.createDataFrame([("member_of", "part_of", "located_in")], "p string, q string, result string"))


def _primitive(spark, d):
    return E.primitive(X.axioms(spark, d), X.expressions(spark, d))


def _edges(spark, d):
    return E.named(_primitive(spark, d), X.expressions(spark, d), _rules(spark))


def _closed(spark, d):
    return E.composed_closure(_edges(spark, d), _rules(spark))


def _shown(df):
    return df.select(*[E.text(c).alias(c) if c == "label" else F.col(c) for c in df.columns])


@query("primitive_edges", f"SELECT DISTINCT sub AS source, sup AS target, 'SUBCLASS_OF' AS label FROM ({X.AXIOMS}) UNION SELECT id, filler, CASE kind WHEN 'some' THEN 'SOME ' || property WHEN 'only' THEN 'ONLY ' || property ELSE 'SUBCLASS_OF' END FROM ({X.EXPRESSIONS})")
def primitive_edges(spark, d):
    return _shown(_primitive(spark, d))


@query("incoming_edges", f"SELECT source, label FROM ({X.NAMED}) WHERE target = 'N:1'")
def incoming_edges(spark, d):
    return _shown(_edges(spark, d)).where("target = 'N:1'").select("source", "label")


@query("named_edges", X.NAMED)
def named_edges(spark, d):
    return _shown(_edges(spark, d))


@query("composed_closure", _PATHS + " SELECT * FROM closed")
def composed_closure(spark, d):
    return _shown(_closed(spark, d))


@query("edges_between", _PATHS + " SELECT label, distance FROM closed WHERE source = 'C:7' AND target = 'ROOT'")
def edges_between(spark, d):
    return _shown(E.between(_closed(spark, d), "C:7", "ROOT")).select("label", "distance")


@query("edges_of_properties", _PATHS + " SELECT source, target, label FROM closed WHERE label NOT LIKE '%;%' AND (label NOT LIKE 'SOME %' OR label IN ('SOME part_of', 'SOME located_in'))")
def edges_of_properties(spark, d):
    return _shown(E.of_properties(_closed(spark, d), ["part_of", "located_in"])).select("source", "target", "label")


@query("edges_excluded", f"SELECT source, target, label FROM ({X.NAMED}) WHERE label NOT LIKE 'ONLY %' AND label <> 'SOME made_in' AND target <> 'ROOT' AND target NOT LIKE 'COMP%'")
def edges_excluded(spark, d):
    return _shown(E.without(_edges(spark, d), properties=("made_in",), quantifiers=("ONLY",), targets=("ROOT",), prefixes=("COMP",)))


@query("subsumer_expressions", _PATHS + ", t AS (SELECT source, target, string_split(label, ';') AS l FROM closed), w AS (SELECT source, l, CASE WHEN l[-1] LIKE 'S% %' THEN '(' || split_part(l[-1], ' ', 2) || ' some ' || target || ')' WHEN l[-1] LIKE 'ONLY %' THEN '(' || split_part(l[-1], ' ', 2) || ' only ' || target || ')' ELSE target END AS x FROM t) SELECT DISTINCT source, CASE WHEN len(l) < 2 THEN x WHEN l[1] LIKE 'SOME %' THEN '(' || split_part(l[1], ' ', 2) || ' some ' || x || ')' WHEN l[1] LIKE 'ONLY %' THEN '(' || split_part(l[1], ' ', 2) || ' only ' || x || ')' ELSE x END AS expression FROM w")
def subsumer_expressions(spark, d):
    return _closed(spark, d).select("source", E.expression().alias("expression")).distinct()


@query("relationship_kinds", _PATHS + " SELECT CASE label WHEN 'SUBCLASS_OF' THEN 'simplesubclass' ELSE 'typesubclass' END AS kind, count(*) AS n FROM closed GROUP BY 1")
def relationship_kinds(spark, d):
    return _closed(spark, d).groupBy(E.relationship().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("edge_names", f"SELECT source, target, CASE label WHEN 'SUBCLASS_OF' THEN 'is a' WHEN 'SOME part_of' THEN 'part of' ELSE split_part(label, ' ', 2) END AS name FROM ({X.NAMED})")
def edge_names(spark, d):
    names = spark.createDataFrame([("part_of", "part of")], "property string, name string")
    return E.label_text(names, _edges(spark, d)).select("source", "target", "name")


@query("query_by_label", _PATHS + " SELECT DISTINCT source AS node FROM closed WHERE label = 'SOME part_of' AND target IN ('R:1', 'R:2')")
def query_by_label(spark, d):
    return E.with_label(_closed(spark, d), ["SOME part_of"], spark.createDataFrame([("R:1",), ("R:2",)], "node string"))


@query("instances_from_closure", "SELECT 'R:' || n_regionkey AS cls, 'I:' || c_custkey AS individual FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT 'N:' || c_nationkey, 'I:' || c_custkey FROM customer")
def instances_from_closure(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), "n_nationkey").alias("sub"), F.concat(F.lit("R:"), "n_regionkey").alias("sup"))
    members = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("I:"), "c_custkey").alias("individual"), F.concat(F.lit("N:"), "c_nationkey").alias("cls"))
    edges = E.primitive(nations, spark.createDataFrame([], X.EXPRESSION), assertions=members)
    return E.instances(E.composed_closure(edges, _rules(spark)))


_UP = "(VALUES ('part_of', 'part_of'), ('part_of', 'located_in'), ('part_of', 'related'), ('located_in', 'located_in'), ('located_in', 'related'), ('related', 'related'), ('made_in', 'made_in'), ('made_in', 'located_in'), ('made_in', 'related'))"


def _property_tree(spark):
    return spark.createDataFrame([("part_of", "located_in"), ("located_in", "related"), ("made_in", "located_in")], "source string, target string")


@query("super_properties", closure_sql(D.HALF) + " SELECT 'p' || source AS property, 'p' || target AS above, CAST(distance AS INT) AS distance FROM closed UNION SELECT 'p' || source, 'p' || source, 0 FROM e UNION SELECT 'p' || target, 'p' || target, 0 FROM e")
def super_properties(spark, d):
    """A property for each part, under that of half its key."""
    tree = D.half_edges(spark, d).select(F.concat(F.lit("p"), "source").alias("source"), F.concat(F.lit("p"), "target").alias("target"))
    return C.reflexive(tree).select(F.col("source").alias("property"), F.col("target").alias("above"), F.col("distance").cast("int").alias("distance"))


@query("generalised_edges", f"SELECT source, target, 'SOME ' || b AS label FROM ({X.NAMED}) JOIN {_UP} u(a, b) ON label = 'SOME ' || a WHERE source LIKE 'N:%' UNION SELECT 'P:' || p_partkey, 'R:' || n_regionkey, 'SOME ' || x.b || ';SOME ' || y.b FROM part JOIN nation ON n_nationkey = p_partkey % 25, {_UP} x(a, b), {_UP} y(a, b) WHERE x.a = 'made_in' AND y.a = 'part_of'")
def generalised_edges(spark, d):
    closed = _closed(spark, d).where("source like 'N:%' and target like 'R:%' or source like 'P:%' and target like 'R:%'").select("source", "target", "label")
    return _shown(E.generalised(closed, C.closure(_property_tree(spark))))


@query("expanded_chains", "SELECT 'in:' || n_nationkey AS property, 'x:' || n_nationkey || ',y:' || n_regionkey || ',top' AS parts FROM nation UNION SELECT 'reg:' || r_regionkey, 'y:' || r_regionkey || ',top' FROM region UNION SELECT 'twice:' || r_regionkey, NULL FROM region UNION SELECT 'loop:' || r_regionkey, 'loop:' || r_regionkey || ',x' FROM region")
def expanded_chains(spark, d):
    """in:n is x:n and reg:r, reg:r is y:r and top; twice:r has two chains, loop:r holds itself."""
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    of = lambda a, k: F.concat(F.lit(a), F.col(k))
    row = lambda df, p, q, result: df.select(p.alias("p"), q.alias("q"), result.alias("result"))
    y, top, x = of("y:", "r_regionkey"), F.lit("top"), F.lit("x")
    chains = row(n, of("x:", "n_nationkey"), of("reg:", "n_regionkey"), of("in:", "n_nationkey")).union(row(r, y, top, of("reg:", "r_regionkey")))
    for p, q in ((x, y), (y, x)):
        chains = chains.union(row(r, p, q, of("twice:", "r_regionkey")))
    chains = chains.union(row(r, of("loop:", "r_regionkey"), x, of("loop:", "r_regionkey")))
    return E.expanded_chains(chains).select("property", F.array_join("parts", ",").alias("parts"))


@query("conditional_edges", X.CONDITIONAL)
def conditional_edges(spark, d):
    return _shown(E.inclusions(*X.conditional(spark, d)))


_COND = f"WITH RECURSIVE e AS (SELECT source, target, label, '' AS gci FROM ({X.NAMED}) WHERE source LIKE 'C:%' AND label = 'SUBCLASS_OF' UNION ALL SELECT source, target, label, gci_relation || ' ' || gci_filler FROM ({X.CONDITIONAL}) UNION ALL SELECT DISTINCT 'M:' || (n_nationkey % 3), 'TOP', 'SUBCLASS_OF', '' FROM nation), c(source, target, gci, distance) AS (SELECT source, target, gci, 1 FROM e UNION SELECT c.source, e.target, CASE WHEN c.gci = '' THEN e.gci ELSE c.gci END, c.distance + 1 FROM c JOIN e ON c.target = e.source AND (c.gci = '' OR e.gci = '' OR c.gci = e.gci))"


@query("conditional_closure", _COND + " SELECT source, target, 'SUBCLASS_OF' AS label, CAST(min(distance) AS BIGINT) AS distance, CASE WHEN gci <> '' THEN split_part(gci, ' ', 1) END AS gci_relation, CASE WHEN gci <> '' THEN split_part(gci, ' ', 2) END AS gci_filler FROM c GROUP BY source, target, gci")
def conditional_closure(spark, d):
    plain = _edges(spark, d).where("source like 'C:%' and label[0] = 'SUBCLASS_OF'")
    markets = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("M:"), F.col("n_nationkey") % 3).alias("source"), F.lit("TOP").alias("target"), F.array(F.lit(E.SUB)).alias("label")).distinct()
    return _shown(E.inclusion_closure(plain.union(markets), _rules(spark), E.inclusions(*X.conditional(spark, d))))


@query("condition_generality", up_sql(D.GEO) + ", f AS (SELECT 'N:' || n_nationkey AS x, 'R:' || r_regionkey AS y FROM nation, region) SELECT 'r' AS relation_a, y AS filler_a, 'r' AS relation_b, x AS filler_b, EXISTS (SELECT 1 FROM up WHERE source = x AND target = y) AS general FROM f")
def condition_generality(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    pairs = n.crossJoin(r).select(F.lit("r").alias("relation_a"), F.concat(F.lit("R:"), "r_regionkey").alias("filler_a"), F.lit("r").alias("relation_b"), F.concat(F.lit("N:"), "n_nationkey").alias("filler_b"))  # 25 nations, 5 regions
    return E.more_general_condition(pairs, C.reflexive(D.geo_edges(spark, d)))


@query("conditional_source_expressions", f"SELECT target, '(' || source || ' and (' || gci_relation || ' some ' || gci_filler || '))' AS expression FROM ({X.CONDITIONAL})")
def conditional_source_expressions(spark, d):
    return E.inclusions(*X.conditional(spark, d)).select("target", E.source_expression().alias("expression"))


@query("segment_graph", f"SELECT source, target, property FROM ({D.LABELLED}) WHERE target = 'N:1' OR source = 'N:1' UNION SELECT 'R:' || n_regionkey, 'ROOT', 'is_a' FROM nation WHERE n_nationkey = 1")
def segment_graph(spark, d):
    return E.segment(D.labelled_edges(spark, d), spark.createDataFrame([("N:1",)], "node string"))


@query("graph_documents", f"WITH g AS (SELECT source, target, property FROM ({D.LABELLED}) WHERE source = 'N:1' OR source LIKE 'R:%') SELECT 'edge' AS kind, '{{\"sub\":\"' || source || '\",\"pred\":\"' || property || '\",\"obj\":\"' || target || '\"}}' AS json FROM g UNION ALL SELECT 'node', CASE WHEN n_name IS NULL THEN '{{\"id\":\"' || node || '\"}}' ELSE '{{\"id\":\"' || node || '\",\"lbl\":\"' || n_name || '\"}}' END FROM (SELECT source AS node FROM g UNION SELECT target FROM g) LEFT JOIN nation ON node = 'N:' || n_nationkey")
def graph_documents(spark, d):
    labels = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.col("n_name").alias("label"))
    return E.graph_json(D.labelled_edges(spark, d).where("source = 'N:1' or source like 'R:%'"), labels)


@query("neighbours_limited", f"SELECT source, target, property FROM ({D.LABELLED}) WHERE source = 'N:1' OR target = 'N:1' ORDER BY 1, 2, 3 LIMIT 5")
def neighbours_limited(spark, d):
    return E.neighbours_of(D.labelled_edges(spark, d), "N:1", 5)


# Reasoning.


def _saturated(spark, d):
    return R.saturate(**X.profile(spark, d))


def _named(implied):
    return implied.where("x not like '\\\\_%' and x <> 'Nothing'").select(F.col("x").alias("node")).distinct()


def _asserted(spark, d):
    return X.profile(spark, d)["sub"].select(F.col("a").alias("source"), F.col("b").alias("target"))


@query("el_subsumers", f"WITH p AS ({X.PROFILE}) SELECT c AS source, 'AB' AS target FROM p WHERE r = 1 AND seg = 'BUILDING' UNION SELECT c, 'AM' FROM p WHERE r = 1 UNION SELECT c, 'LOC3' FROM p WHERE r = 3 UNION SELECT c, n FROM p UNION SELECT c, 'SEG:' || seg FROM p")
def el_subsumers(spark, d):
    implied, _ = _saturated(spark, d)
    return implied.where("x like 'C:%' and x <> a and a not like '\\\\_%' and a <> 'Nothing'").select(F.col("x").alias("source"), F.col("a").alias("target"))


@query("el_inferred", f"WITH p AS ({X.PROFILE}) SELECT 'N:' || n_nationkey AS source, 'AM' AS target FROM nation WHERE n_regionkey = 1 UNION SELECT 'N:' || n_nationkey, 'LOC3' FROM nation WHERE n_regionkey = 3 UNION SELECT c, 'AB' FROM p WHERE r = 1 AND seg = 'BUILDING'")
def el_inferred(spark, d):
    implied, _ = _saturated(spark, d)
    return R.inferred(implied, _named(implied), _asserted(spark, d))


@query("el_unsatisfiable", f"WITH p AS ({X.PROFILE}) SELECT c AS node FROM p WHERE r = 2 AND seg = 'AUTOMOBILE'")
def el_unsatisfiable(spark, d):
    implied, _ = _saturated(spark, d)
    return R.unsatisfiable(implied, _named(implied))


@query("el_equivalents", "SELECT 'R:4' AS a, 'RR:4' AS b")
def el_equivalents(spark, d):
    implied, _ = _saturated(spark, d)
    return R.equivalents(implied, _named(implied))


@query("el_existentials", f"WITH p AS ({X.PROFILE}), x AS (SELECT c AS source, r FROM p UNION SELECT 'N:' || n_nationkey, n_regionkey FROM nation) SELECT source, 'R:' || r AS target FROM x UNION SELECT source, 'RR:4' FROM x WHERE r = 4")
def el_existentials(spark, d):
    implied, links = _saturated(spark, d)
    return R.existentials(links, implied, _named(implied), "located_in")


@query("el_redundant", f"WITH p AS ({X.PROFILE}) SELECT c AS source, 'AM' AS target FROM p WHERE r = 1 AND c_custkey % 10 = 0")
def el_redundant(spark, d):
    implied, _ = _saturated(spark, d)
    return R.redundant(implied, _asserted(spark, d))


@query("el_from_expressions", f"SELECT source, target FROM ({X.NAMED}) WHERE label = 'SUBCLASS_OF' AND source NOT LIKE 'C:%' UNION SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer")
def el_from_expressions(spark, d):
    ax, ex = X.axioms(spark, d), X.expressions(spark, d)
    implied, _ = R.saturate(**R.normalised(R.in_profile(ax, ex), ex.where("kind <> 'only'")))
    anonymous = ex.select(F.col("id").alias("node")).distinct()
    names = implied.select(F.col("x").alias("node")).distinct().join(anonymous, "node", "left_anti").where("node not like '%#%'")
    return R.inferred(implied, names, C.clean(ax.toDF("source", "target")).limit(0), always=True)


@query("el_profile", f"SELECT DISTINCT sub, sup FROM ({X.AXIOMS}) WHERE sup NOT LIKE 'O:%'")
def el_profile(spark, d):
    return R.in_profile(X.axioms(spark, d), X.expressions(spark, d))


@query("classes_also_restricted", "SELECT 'N:' || n_nationkey AS sub, 'part_of' AS property, 'R:' || n_regionkey AS sup FROM nation WHERE n_nationkey % 2 = 0")
def classes_also_restricted(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 2 = 0")
    more = n.select(F.concat(F.lit("N:"), "n_nationkey").alias("sub"), F.concat(F.lit("R:"), "n_regionkey").alias("sup"))
    return R.also_restricted(X.axioms(spark, d).union(more), X.expressions(spark, d))


@query("unfolded_definitions", "SELECT 'DP:' || p_partkey AS cls, NULL AS property, 'ITEM' AS filler FROM part UNION SELECT 'DP:' || p_partkey, 'has_size', 'S:' || p_size FROM part UNION SELECT 'DP:' || p_partkey, 'made_by', p_brand FROM part UNION SELECT 'DB:' || p_brand, NULL, 'ITEM' FROM part UNION SELECT 'DB:' || p_brand, 'made_by', p_brand FROM part")
def unfolded_definitions(spark, d):
    return R.unfolded(X.definitions(spark, d))


@query("inferred_closure_diff", f"WITH RECURSIVE e AS ({D.GEO}), f AS (SELECT * FROM e WHERE source <> 'N:1'), c(source, target) AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM c JOIN e ON c.target = e.source), g(source, target) AS (SELECT source, target FROM f UNION SELECT g.source, f.target FROM g JOIN f ON g.target = f.source) SELECT source, target, 'left' AS side FROM (SELECT * FROM c EXCEPT SELECT * FROM g)")
def inferred_closure_diff(spark, d):
    edges = D.geo_edges(spark, d)
    return C.diff(C.closure(edges), C.closure(edges.where("source <> 'N:1'"))).where("side <> 'common'")


@query("property_rules_over_super_properties", "SELECT 'SOME p:' || x.n_nationkey AS a, 'SOME p:' || y.n_nationkey AS b, 'SOME q:' || x.n_regionkey AS result FROM nation AS x JOIN nation AS y ON x.n_regionkey = y.n_regionkey")
def property_rules_over_super_properties(spark, d):
    """q:r is transitive and holds p:n of each nation n in region r."""
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    properties = r.select(F.concat(F.lit("q:"), "r_regionkey").alias("property"), F.lit(True).alias("transitive"))
    below = n.select(F.concat(F.lit("p:"), "n_nationkey").alias("source"), F.concat(F.lit("q:"), "n_regionkey").alias("target"))
    return E.rules(properties, sub_property=below).where("a like 'SOME p:%' and b like 'SOME p:%'")


@query("closure_through_listed_relations", f"WITH RECURSIVE e AS ({D.LABELLED}), c(source, target) AS (SELECT source, target FROM e WHERE property IN ('is_a', 'part_of') UNION SELECT c.source, e.target FROM c JOIN e ON c.target = e.source WHERE e.property IN ('is_a', 'part_of')) SELECT source AS id, string_agg(target, ',' ORDER BY target) AS closure FROM c GROUP BY 1")
def closure_through_listed_relations(spark, d):
    wanted = spark.createDataFrame([("part_of",)], "property string")
    closed = C.closure(L.only_properties(D.labelled_edges(spark, d), wanted))
    return closed.groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("closure"))
