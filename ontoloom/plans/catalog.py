"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.operators import similarity as S
from ontoloom.plans import derived as D
from ontoloom.plans.register import QUERIES, SQL, closure_sql, query, up_sql
from ontoloom.plans.session import settle

FLAGSHIP = "term_information_content"


def _up(spark, d):
    edges = D.part_edges(spark, d)
    return C.reflexive(edges)


def _full(spark, d):
    return S.inferred(D.marks(spark, d), _up(spark, d))


def _content(spark, d):
    """The content of attributes, and the elements' sets with it."""
    up = _up(spark, d)
    ic = settle(S.information_content(S.inferred(D.marks(spark, d), up)), "content")
    return ic, S.weighed_sets(D.marks(spark, d), up, ic)


def _round(df, *names):
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


def _longs(df):
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def full_sql() -> str:
    return up_sql(D.PART) + f", marks AS ({D.MARKS}), full_ AS (SELECT DISTINCT m.element, u.target AS attribute FROM marks m JOIN up u ON m.attribute = u.source)"


def ic_sql() -> str:
    return full_sql() + ", ic AS (SELECT attribute, count(*) AS n_elements, -log2(count(*) / (SELECT count(DISTINCT element) FROM full_)) AS ic FROM full_ GROUP BY 1)"


@query("closure_geo", closure_sql(D.GEO) + " SELECT * FROM closed")
def closure_geo(spark, d):
    return C.closure(D.geo_edges(spark, d))


@query("closure_deep", closure_sql(D.HALF) + " SELECT * FROM closed")
def closure_deep(spark, d):
    return C.closure(D.half_edges(spark, d))


@query("closure_reflexive", up_sql(D.PART) + " SELECT u.source, u.target, CASE WHEN u.source = u.target THEN 0 ELSE c.distance END AS distance FROM up u LEFT JOIN closed c USING (source, target)")
def closure_reflexive(spark, d):
    return C.reflexive(D.part_edges(spark, d))


@query("ancestors_of_node", closure_sql(D.GEO) + " SELECT target AS node, distance FROM closed WHERE source = 'C:1'")
def ancestors_of_node(spark, d):
    return C.ancestors(D.geo_edges(spark, d), "C:1")


@query("descendants_of_node", closure_sql(D.GEO) + " SELECT source AS node, distance FROM closed WHERE target = 'R:1'")
def descendants_of_node(spark, d):
    return C.descendants(D.geo_edges(spark, d), "R:1")


@query("roots", f"WITH e AS ({D.HALF}) SELECT DISTINCT target AS node FROM e WHERE target NOT IN (SELECT source FROM e)")
def roots(spark, d):
    return C.roots(D.half_edges(spark, d))


@query("leaves", f"WITH e AS ({D.HALF}) SELECT DISTINCT source AS node FROM e WHERE source NOT IN (SELECT target FROM e)")
def leaves(spark, d):
    return C.leaves(D.half_edges(spark, d))


@query("direct_neighbours", f"WITH e AS ({D.PART}), n AS (SELECT source AS node, 1 AS p, 0 AS k FROM e UNION ALL SELECT target, 0, 1 FROM e) SELECT node, CAST(sum(p) AS BIGINT) AS n_parents, CAST(sum(k) AS BIGINT) AS n_children FROM n GROUP BY 1")
def direct_neighbours(spark, d):
    return _longs(C.neighbours(D.part_edges(spark, d)))


_SHORTCUTS = f"{D.PART} UNION SELECT 'P:' || p_partkey, 'ROOT' FROM part"


@query("transitive_reduction", D.PART)
def transitive_reduction(spark, d):
    edges = D.part_edges(spark, d)
    direct = edges.where("source like 'P:%'").select("source", F.lit("ROOT").alias("target"))
    return C.reduction(edges.union(direct))


@query("strong_components", f"WITH RECURSIVE e AS ({D.CYCLE}), c AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM c JOIN e ON c.target = e.source), n AS (SELECT source AS node FROM e UNION SELECT target FROM e) SELECT node, least(node, coalesce((SELECT min(a.target) FROM c a JOIN c b ON a.source = b.target AND a.target = b.source WHERE a.source = node), node)) AS component FROM n")
def strong_components(spark, d):
    return C.strong_components(D.cycle_edges(spark, d))


@query("cycle_check", f"WITH RECURSIVE e AS ({D.CYCLE}), c AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM c JOIN e ON c.target = e.source) SELECT source AS node FROM c WHERE source = target")
def cycle_check(spark, d):
    return C.on_cycles(D.cycle_edges(spark, d))


_PART_PAIRS = "SELECT 'P:' || p_partkey AS a, 'P:' || (p_partkey + 1) AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)"


def _part_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey", "left_semi")
    return both.select(F.concat(F.lit("P:"), "p_partkey").alias("a"), F.concat(F.lit("P:"), F.col("p_partkey") + 1).alias("b"))


@query("common_subsumers", up_sql(D.PART) + f", pairs AS ({_PART_PAIRS}) SELECT a, b, x.target AS subsumer FROM pairs JOIN up x ON x.source = a JOIN up y ON y.source = b AND y.target = x.target")
def common_subsumers(spark, d):
    return C.common_subsumers(_part_pairs(spark, d), _up(spark, d))


@query("lowest_common_subsumers", up_sql(D.PART) + f", pairs AS ({_PART_PAIRS}), k AS (SELECT a, b, x.target AS subsumer FROM pairs JOIN up x ON x.source = a JOIN up y ON y.source = b AND y.target = x.target) SELECT a, b, subsumer FROM k WHERE NOT EXISTS (SELECT 1 FROM k o JOIN closed c ON c.source = o.subsumer WHERE o.a = k.a AND o.b = k.b AND c.target = k.subsumer AND c.source <> c.target)")
def lowest_common_subsumers(spark, d):
    return C.lowest_common_subsumers(_part_pairs(spark, d), _up(spark, d))


@query("subset_map", up_sql(D.GEO) + ", s AS (SELECT 'N:' || n_nationkey AS node FROM nation WHERE n_nationkey < 10 UNION SELECT 'R:' || r_regionkey FROM region), h AS (SELECT source AS term, target AS slim FROM up WHERE target IN (SELECT node FROM s)) SELECT term, slim FROM h WHERE NOT EXISTS (SELECT 1 FROM h o JOIN closed c ON c.source = o.slim WHERE o.term = h.term AND c.target = h.slim)")
def subset_map(spark, d):
    nodes = C.nodes(edges := D.geo_edges(spark, d))
    few = nodes.where("node like 'R:%' or (node like 'N:%' and cast(substring(node, 3) as int) < 10)")
    return C.subset_map(C.reflexive(edges), few)


@query("annotations_to_slim", up_sql(D.PART) + f", marks AS ({D.MARKS}) SELECT DISTINCT element, target AS slim FROM marks JOIN up ON attribute = source WHERE target LIKE 'T:%' OR target LIKE 'B:%'")
def annotations_to_slim(spark, d):
    up = _up(spark, d)
    slim = C.subset_map(up, C.nodes(D.part_edges(spark, d)).where("node like 'T:%' or node like 'B:%'"))
    return D.marks(spark, d).join(slim.withColumnRenamed("term", "attribute"), "attribute").select("element", "slim").distinct()


@query("remove_redundant", up_sql(D.PART) + f", marks AS ({D.MARKS} UNION SELECT l_orderkey, 'B:' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1) SELECT element, attribute FROM marks m WHERE NOT EXISTS (SELECT 1 FROM marks o JOIN closed c ON c.source = o.attribute WHERE o.element = m.element AND c.target = m.attribute)")
def remove_redundant(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1").withColumnRenamed("l_partkey", "p_partkey")  # noqa: E741
    extra = l.join(spark.read.parquet(f"{d}/part.parquet"), "p_partkey").select(F.col("l_orderkey").alias("element"), F.concat(F.lit("B:"), "p_brand").alias("attribute"))
    return C.non_redundant(D.marks(spark, d).union(extra), C.closure(D.part_edges(spark, d)), "element", "attribute")


@query("annotation_query", full_sql() + " SELECT m.element, m.attribute FROM marks m JOIN up u ON m.attribute = u.source WHERE u.target = 'S:2'")
def annotation_query(spark, d):
    below = _up(spark, d).where("target = 'S:2'").select(F.col("source").alias("attribute"))
    return D.marks(spark, d).join(below, "attribute", "left_semi").distinct()


@query("term_counts", full_sql() + " SELECT attribute, count(*) AS n_elements FROM full_ GROUP BY 1")
def term_counts(spark, d):
    return S.frequencies(_full(spark, d))


@query("term_information_content", ic_sql() + " SELECT attribute, n_elements, round(ic, 6) + 0.0 AS ic FROM ic")
def term_information_content(spark, d):
    return _round(S.information_content(_full(spark, d)), "ic")


@query("annotation_entropy", ic_sql() + " SELECT round(sum(pow(2.0, -ic) * ic), 6) AS entropy FROM ic")
def annotation_entropy(spark, d):
    return _round(S.entropy(_full(spark, d)), "entropy")


@query("annotation_specificity", full_sql() + ", deep AS (SELECT source, max(distance) AS depth FROM closed GROUP BY 1) SELECT element, max(depth) AS max_depth, round(avg(depth), 6) AS mean_depth FROM marks JOIN deep ON attribute = source GROUP BY 1")
def annotation_specificity(spark, d):
    deep = C.closure(D.part_edges(spark, d)).groupBy(F.col("source").alias("attribute")).agg(F.max("distance").alias("depth"))
    out = D.marks(spark, d).distinct().join(deep, "attribute").groupBy("element").agg(F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"))
    return _round(out, "mean_depth")


_PAIR_SQL = ic_sql() + f", pairs AS ({D.PAIRS}), w AS (SELECT element, f.attribute, ic FROM full_ f JOIN ic USING (attribute)), own AS (SELECT element, count(*) AS n, sum(ic) AS total FROM w GROUP BY 1), k AS (SELECT a, b, count(*) AS n_common, sum(x.ic) AS w, max(x.ic) AS max_ic FROM pairs JOIN w x ON x.element = a JOIN full_ y ON y.element = b AND y.attribute = x.attribute GROUP BY 1, 2)"


@query("similarity_pairs", _PAIR_SQL + " SELECT a, b, n_common, oa.n AS n_a, ob.n AS n_b, round(n_common / (oa.n + ob.n - n_common), 6) AS simj, round(n_common / ob.n, 6) AS asym, round(CASE WHEN oa.total + ob.total - w > 0 THEN w / (oa.total + ob.total - w) ELSE 0 END, 6) + 0.0 AS simgic, round(max_ic, 6) + 0.0 AS max_ic FROM k JOIN own oa ON oa.element = a JOIN own ob ON ob.element = b")
def similarity_pairs(spark, d):
    ic, sets = _content(spark, d)
    return _round(S.pair_scores(D.pairs(spark, d), None, ic, sets), "simj", "asym", "simgic", "max_ic")


@query("best_match_average", ic_sql() + f", pairs AS ({D.PAIRS}), l AS (SELECT m.element, m.attribute, u.target AS subsumer, ic FROM marks m JOIN up u ON u.source = m.attribute JOIN ic ON ic.attribute = u.target), cells AS (SELECT a, b, x.attribute AS at_a, y.attribute AS at_b, max(x.ic) AS m FROM pairs JOIN l x ON x.element = a JOIN l y ON y.element = b AND y.subsumer = x.subsumer GROUP BY 1, 2, 3, 4), ba AS (SELECT a, b, sum(m) AS s FROM (SELECT a, b, at_a, max(m) AS m FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2), bb AS (SELECT a, b, sum(m) AS s FROM (SELECT a, b, at_b, max(m) AS m FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2), n AS (SELECT element, count(*) AS n FROM marks GROUP BY 1) SELECT a, b, round(ba.s / na.n, 6) AS bma_a, round(bb.s / nb.n, 6) AS bma_b, round((ba.s + bb.s) / (na.n + nb.n), 6) AS bma FROM ba JOIN bb USING (a, b) JOIN n na ON na.element = a JOIN n nb ON nb.element = b")
def best_match_average(spark, d):
    up = _up(spark, d)
    ic = settle(S.information_content(S.inferred(D.marks(spark, d), up)), "content")
    return _round(S.best_match_average(D.pairs(spark, d), D.marks(spark, d), up, ic), "bma_a", "bma_b", "bma")


_SAMPLE = "SELECT o_orderkey AS element FROM orders WHERE o_orderpriority = '1-URGENT'"


@query("class_enrichment", full_sql() + f", few AS (SELECT * FROM full_ WHERE attribute NOT LIKE 'P:%'), s AS (SELECT DISTINCT element FROM few WHERE element IN ({_SAMPLE})), t AS (SELECT attribute, count(*) AS c, count(*) FILTER (WHERE element IN (SELECT element FROM s)) AS k FROM few GROUP BY 1), g AS (SELECT attribute, c, k, (SELECT count(DISTINCT element) FROM few) AS m, (SELECT count(*) FROM s) AS n FROM t WHERE c > 1 AND k > 0), x AS (SELECT *, unnest(range(k, least(c, n) + 1)) AS x FROM g), p AS (SELECT attribute, k, c, sum(exp(lgamma(c + 1) - lgamma(x + 1) - lgamma(c - x + 1) + lgamma(m - c + 1) - lgamma(n - x + 1) - lgamma(m - c - n + x + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1))) AS p FROM x WHERE n - x <= m - c GROUP BY 1, 2, 3) SELECT attribute, k, c, round(least(p, 1), 6) AS p, round(least(p * (SELECT count(*) FROM g), 1), 6) AS p_corrected FROM p")
def class_enrichment(spark, d):
    sample = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("element"))
    return _round(S.enrichment(_full(spark, d).where("attribute not like 'P:%'"), sample), "p", "p_corrected")


@query("co_annotation", full_sql() + ", few AS (SELECT * FROM full_ WHERE attribute NOT LIKE 'P:%'), n AS (SELECT attribute, count(*) AS n FROM few GROUP BY 1) SELECT x.attribute AS a, y.attribute AS b, count(*) AS n_both, round(count(*) / any_value(n.n), 6) AS p_b_given_a FROM few x JOIN few y ON x.element = y.element AND x.attribute < y.attribute JOIN n ON n.attribute = x.attribute GROUP BY 1, 2")
def co_annotation(spark, d):
    within = C.nodes(D.part_edges(spark, d)).where("node not like 'P:%'").select(F.col("node").alias("attribute"))
    return _round(S.co_annotation(_full(spark, d), within), "p_b_given_a")


_STATS = ic_sql() + ", st AS (SELECT element, count(*) AS n, avg(ic) AS mean_ic, min(ic) AS min_ic, max(ic) AS max_ic, sum(ic) AS sum_ic FROM full_ JOIN ic USING (attribute) GROUP BY 1)"


@query("element_statistics", _STATS + " SELECT element, n, round(mean_ic, 6) AS mean_ic, round(min_ic, 6) + 0.0 AS min_ic, round(max_ic, 6) AS max_ic, round(sum_ic, 6) AS sum_ic FROM st")
def element_statistics(spark, d):
    ic, sets = _content(spark, d)
    return _round(S.element_statistics(None, ic, sets), "mean_ic", "min_ic", "max_ic", "sum_ic")


@query("annotation_sufficiency", _STATS + ", o AS (SELECT avg(mean_ic) AS a, max(max_ic) AS b, avg(sum_ic) AS c FROM st) SELECT element, round((least(1, mean_ic / a) + least(1, max_ic / b) + least(1, sum_ic / c)) / 3, 5) AS sufficiency FROM st, o")
def annotation_sufficiency(spark, d):
    ic, sets = _content(spark, d)
    out = S.sufficiency(settle(S.element_statistics(None, ic, sets), "statistics"))
    return out.select("element", F.round("sufficiency", 5).alias("sufficiency"))


@query("ontology_diff", f"WITH l AS ({D.PART}), r AS (SELECT * FROM l WHERE target NOT LIKE 'S:%' UNION SELECT 'X', 'ROOT') SELECT coalesce(l.source, r.source) AS source, coalesce(l.target, r.target) AS target, CASE WHEN l.source IS NULL THEN 'right' WHEN r.source IS NULL THEN 'left' ELSE 'common' END AS side FROM l FULL JOIN r ON l.source = r.source AND l.target = r.target")
def ontology_diff(spark, d):
    left = D.part_edges(spark, d)
    extra = left.sparkSession.createDataFrame([("X", "ROOT")], "source string, target string")
    return C.diff(left, left.where("target not like 'S:%'").union(extra))


@query("remove_and_bridge", f"WITH e AS ({D.GEO}) SELECT source, target FROM e WHERE source <> 'R:1' AND target <> 'R:1' UNION SELECT a.source, b.target FROM e a JOIN e b ON a.target = 'R:1' AND b.source = 'R:1'")
def remove_and_bridge(spark, d):
    return C.remove_and_bridge(D.geo_edges(spark, d), "R:1")


@query("dangling_references", "SELECT DISTINCT l_partkey AS reference FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def dangling_references(spark, d):
    declared = spark.read.parquet(f"{d}/part.parquet").where("p_size < 40").select(F.col("p_partkey").alias("reference"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("reference")).distinct().join(declared, "reference", "left_anti")


@query("duplicate_labels", "SELECT p_name AS label, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


from ontoloom.plans import catalog_annotations, catalog_axioms, catalog_compare, catalog_edges, catalog_documents, catalog_graph, catalog_reasoning, catalog_structures  # noqa: E402,F401  (they register their queries)
