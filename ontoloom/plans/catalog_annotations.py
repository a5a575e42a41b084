"""Queries of annotation checks, predictions, parsing, documents and further similarity measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.functions import parsing as P
from ontoloom.operators import annotations as A
from ontoloom.operators import closure as C
from ontoloom.operators import rewrite as R
from ontoloom.operators import similarity as S
from ontoloom.plans import derived as D
from ontoloom.plans.catalog import _content
from ontoloom.plans.register import SQL, query, up_sql
from ontoloom.plans.session import settle

_ANN = f"ann AS ({D.ANNOTATIONS})"
_UP = up_sql(D.PART) + ", " + _ANN
TODAY = "1997-06-17"


def _up(spark, d):
    return C.reflexive(D.part_edges(spark, d))


def _round(df, *names):
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


@query("rule_rows", f"WITH {_ANN} SELECT annotation_id, 'ida_forbids_with' AS rule FROM ann WHERE evidence = 'IDA' AND partner IS NOT NULL UNION ALL SELECT annotation_id, 'ipi_needs_with' FROM ann WHERE evidence = 'IPI' AND partner IS NULL UNION ALL SELECT annotation_id, 'iea_older_than_a_year' FROM ann WHERE evidence = 'IEA' AND date < DATE '{TODAY}' - INTERVAL 12 MONTH")
def rule_rows(spark, d):
    return A.row_rules(D.annotations(spark, d), A.standard_rules(TODAY))


@query("rule_binding", f"WITH {_ANN} SELECT annotation_id, 'binding_needs_with' AS rule FROM ann WHERE cls IN ('P:1', 'P:2') AND (evidence NOT IN ('IPI', 'IEA') OR partner IS NULL)")
def rule_binding(spark, d):
    rules = A.standard_rules(TODAY, "P:1", "P:2")
    return A.row_rules(D.annotations(spark, d), {"binding_needs_with": rules["binding_needs_with"]})


@query("rule_patterns", f"WITH {_ANN} SELECT annotation_id, 'odd_qualifier' AS rule FROM ann WHERE regexp_matches(qualifier, 'odd$')")
def rule_patterns(spark, d):
    return A.pattern_rules(D.annotations(spark, d), "qualifier", {"odd_qualifier": "odd$"})


@query("rule_evidence_only_under", _UP + " SELECT annotation_id, 'iea_under_size' AS rule FROM ann WHERE evidence = 'IEA' AND cls NOT IN (SELECT source FROM closed WHERE target = 'S:2')")
def rule_evidence_only_under(spark, d):
    return A.evidence_only_under(D.annotations(spark, d), C.closure(D.part_edges(spark, d)), "IEA", "S:2", "iea_under_size")


@query("rule_evidence_never_under", _UP + " SELECT annotation_id, 'ipi_under_size' AS rule FROM ann WHERE evidence = 'IPI' AND cls IN (SELECT source FROM closed WHERE target = 'S:2')")
def rule_evidence_never_under(spark, d):
    return A.evidence_never_under(D.annotations(spark, d), C.closure(D.part_edges(spark, d)), "IPI", "S:2", "ipi_under_size")


@query("rule_reciprocal", f"WITH {_ANN} SELECT DISTINCT annotation_id, 'not_reciprocal' AS rule FROM ann x WHERE cls = 'P:1' AND partner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ann y WHERE y.cls = 'P:1' AND y.bioentity = x.partner AND y.partner = x.bioentity)")
def rule_reciprocal(spark, d):
    return A.reciprocal(D.annotations(spark, d), "P:1")


@query("rule_class_references", f"WITH {_ANN} SELECT annotation_id, CASE WHEN p_size < 5 THEN 'obsolete_class' WHEN p_size BETWEEN 40 AND 44 THEN 'alternative_id' ELSE 'unknown_class' END AS rule FROM ann JOIN part ON cls = 'P:' || p_partkey WHERE p_size < 5 OR p_size >= 40")
def rule_class_references(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("id", F.concat(F.lit("P:"), "p_partkey"))
    none = F.array().cast("array<string>")
    known = part.where("p_size < 40").select("id", (F.col("p_size") < 5).alias("is_obsolete"), none.alias("alt_ids"))
    alt = part.where("p_size between 40 and 44").select(F.concat(F.lit("new "), "id").alias("id"), F.lit(False).alias("is_obsolete"), F.array("id").alias("alt_ids"))
    return A.class_references(D.annotations(spark, d), known.union(alt))


@query("rule_subset", f"WITH {_ANN} SELECT annotation_id, 'not_for_annotation' AS rule FROM ann WHERE cls IN (SELECT 'P:' || p_partkey FROM part WHERE p_size = 7)")
def rule_subset(spark, d):
    few = spark.read.parquet(f"{d}/part.parquet").where("p_size = 7").select(F.concat(F.lit("P:"), "p_partkey").alias("node"))
    return A.in_subset(D.annotations(spark, d), few, "not_for_annotation")


def _verdicts(spark, d):
    supplier = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("U:"), "s_suppkey").alias("source"), F.concat(F.lit("N:"), "s_nationkey").alias("target"))
    taxa = C.reflexive(D.geo_edges(spark, d).where("source not like 'C:%'").union(supplier))
    brands = C.nodes(D.part_edges(spark, d)).where("node like 'B:%1'")
    only = brands.select(F.col("node").alias("cls"), F.lit("R:1").alias("taxon"))
    never = spark.createDataFrame([("S:2", "N:3")], "cls string, taxon string")
    return A.applicable(D.annotations(spark, d).select("cls", "taxon"), _up(spark, d), only, never, taxa)


_TAXA = _UP + ", place AS (SELECT 'U:' || s_suppkey AS taxon, 'N:' || s_nationkey AS n, 'R:' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey), v AS (SELECT DISTINCT cls, taxon, NOT (r <> 'R:1' AND cls IN (SELECT source FROM up WHERE target LIKE 'B:%1')) AND NOT (n = 'N:3' AND cls IN (SELECT source FROM up WHERE target = 'S:2')) AS applicable FROM ann JOIN place USING (taxon))"


@query("taxon_applicability", _TAXA + " SELECT * FROM v")
def taxon_applicability(spark, d):
    return _verdicts(spark, d)


@query("rule_taxon", _TAXA + " SELECT annotation_id, 'taxon' AS rule FROM ann JOIN v USING (cls, taxon) WHERE NOT applicable")
def rule_taxon(spark, d):
    return A.taxon_violations(D.annotations(spark, d), _verdicts(spark, d))


@query("qualifier_flags", f"WITH {_ANN} SELECT annotation_id, CASE WHEN qualifier = '' THEN 0 WHEN qualifier = 'NOT' THEN 1 WHEN qualifier LIKE 'NOT|%' THEN 3 ELSE 4 END AS flags, CASE WHEN qualifier LIKE '%odd' THEN 'odd' ELSE '' END AS unknown FROM ann")
def qualifier_flags(spark, d):
    q = F.col("qualifier")
    return D.annotations(spark, d).select("annotation_id", P.qualifier_flags(q).alias("flags"), F.array_join(P.unknown_qualifiers(q), ",").alias("unknown"))


@query("extension_parse", f"WITH {_ANN} SELECT annotation_id, 'part_of(' || taxon || '),occurs_in(' || cls || ')|has_input(' || bioentity || ')' AS text, CAST(3 AS INTEGER) AS n FROM ann")
def extension_parse(spark, d):
    c = F.concat(F.lit("part_of("), "taxon", F.lit("), occurs_in("), "cls", F.lit(") | has_input("), "bioentity", F.lit(")|broken"))
    parsed = D.annotations(spark, d).select("annotation_id", P.extensions(c).alias("ext"))
    return parsed.select("annotation_id", P.extension_text(F.col("ext")).alias("text"), F.size(F.flatten("ext")).alias("n"))


@query("annotation_compare", _UP + ", l AS (SELECT DISTINCT bioentity, cls FROM ann), r AS (SELECT DISTINCT bioentity, CASE WHEN evidence = 'IPI' THEN cls ELSE 'B:' || p_brand END AS cls FROM ann JOIN part ON cls = 'P:' || p_partkey WHERE evidence <> 'IEA') SELECT bioentity, cls, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.bioentity = l.bioentity AND r.cls = l.cls) THEN 'exact' WHEN EXISTS (SELECT 1 FROM r JOIN closed c ON c.target = r.cls WHERE r.bioentity = l.bioentity AND c.source = l.cls) THEN 'more_specific' ELSE 'not_found' END AS outcome FROM l")
def annotation_compare(spark, d):
    ann = D.annotations(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P:"), "p_partkey").alias("cls"), F.concat(F.lit("B:"), "p_brand").alias("brand"))
    right = ann.where("evidence <> 'IEA'").join(part, "cls").select("bioentity", F.when(F.col("evidence") == "IPI", F.col("cls")).otherwise(F.col("brand")).alias("cls"))
    return A.compare(ann, right, C.closure(D.part_edges(spark, d)))


@query("slim_unmapped", _UP + " SELECT annotation_id, cls FROM ann WHERE cls NOT IN (SELECT source FROM up WHERE target IN ('S:1', 'S:2'))")
def slim_unmapped(spark, d):
    edges = D.part_edges(spark, d)
    slim = C.subset_map(C.reflexive(edges), C.nodes(edges).where("node in ('S:1', 'S:2')"))
    return A.to_slim(D.annotations(spark, d), slim)[1].select("annotation_id", "cls")


_LINKS = "links AS (SELECT 'P:' || p_partkey AS source, 'P:' || (p_partkey + 1) AS target FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part) UNION SELECT 'P:' || p_partkey, 'B:' || p_brand FROM part)"


@query("propagate_annotations", _UP + f", {_LINKS}, have AS (SELECT DISTINCT bioentity, target AS cls FROM ann JOIN up ON cls = source), n AS (SELECT DISTINCT bioentity, target AS cls, evidence FROM ann JOIN links ON cls = source WHERE qualifier = '' AND (bioentity, target) NOT IN (SELECT bioentity, cls FROM have)) SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n o JOIN closed c ON c.source = o.cls WHERE o.bioentity = n.bioentity AND o.evidence = n.evidence AND c.target = n.cls)")
def propagate_annotations(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    id_ = lambda c: F.concat(F.lit("P:"), c)
    after = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey", "left_semi")
    links = after.select(id_(F.col("p_partkey")).alias("source"), id_(F.col("p_partkey") + 1).alias("target")).union(part.select(id_(F.col("p_partkey")), F.concat(F.lit("B:"), "p_brand")))
    ann = D.annotations(spark, d).withColumn("flags", P.qualifier_flags(F.col("qualifier")))
    return settle(A.propagate(ann, links, _up(spark, d)), "propagated", spread=True)


@query("compositional_prediction", _UP + ", have AS (SELECT DISTINCT bioentity AS key, target AS part FROM ann JOIN up ON cls = source), d AS (SELECT DISTINCT p_type || '/' || CAST(floor(p_size / 10) AS INT) AS cls, unnest(['T:' || p_type, 'S:' || CAST(floor(p_size / 10) AS INT)]) AS part FROM part) SELECT key, cls FROM have JOIN d USING (part) GROUP BY 1, 2 HAVING count(*) = 2")
def compositional_prediction(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size = F.floor(F.col("p_size") / 10).cast("int")
    definitions = p.select(F.concat("p_type", F.lit("/"), size).alias("cls"), F.explode(F.array(F.concat(F.lit("T:"), "p_type"), F.concat(F.lit("S:"), size))).alias("part"))
    have = S.inferred(D.annotations(spark, d).select(F.col("bioentity").alias("element"), F.col("cls").alias("attribute")), _up(spark, d))
    return R.class_cover(definitions, have.toDF("key", "part"))


@query("denormalised_documents", up_sql(D.GEO) + ", names AS (SELECT 'N:' || n_nationkey AS node, n_name AS label FROM nation UNION SELECT 'R:' || r_regionkey, r_name FROM region) SELECT source AS id, any_value(own.label) AS label, string_agg(DISTINCT target, ',' ORDER BY target) AS closure_ids, coalesce(string_agg(DISTINCT n.label, ',' ORDER BY n.label), '') AS closure_labels FROM up LEFT JOIN names n ON n.node = target LEFT JOIN names own ON own.node = source GROUP BY source")
def denormalised_documents(spark, d):
    edges = D.geo_edges(spark, d)
    read = lambda t, p, k, n: spark.read.parquet(f"{d}/{t}.parquet").select(F.concat(F.lit(p), k).alias("node"), F.col(n).alias("label"))
    return A.documents(C.nodes(edges), C.reflexive(edges), read("nation", "N:", "n_nationkey", "n_name").union(read("region", "R:", "r_regionkey", "r_name")))


_CLASS_PAIRS = "SELECT 'B:' || p_brand AS a, 'T:' || p_type AS b FROM part GROUP BY 1, 2"


def _class_pairs(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("B:"), "p_brand").alias("a"), F.concat(F.lit("T:"), "p_type").alias("b")).distinct()


_FULL = up_sql(D.PART) + f", marks AS ({D.MARKS}), full_ AS (SELECT DISTINCT m.element, u.target AS attribute FROM marks m JOIN up u ON m.attribute = u.source)"
_IC = _FULL + ", ic AS (SELECT attribute, count(*) AS n_elements, -log2(count(*) / (SELECT count(DISTINCT element) FROM full_)) AS ic FROM full_ GROUP BY 1)"


@query("conditional_probability", _FULL + f", pairs AS ({_CLASS_PAIRS}), k AS (SELECT a, b, count(*) AS n_both FROM pairs JOIN full_ x ON x.attribute = a JOIN full_ y ON y.attribute = b AND y.element = x.element GROUP BY 1, 2), n AS (SELECT attribute, count(*) AS n FROM full_ GROUP BY 1) SELECT a, b, coalesce(n_both, 0) AS n_both, round(coalesce(n_both, 0) / n, 6) AS p FROM pairs JOIN n ON attribute = b LEFT JOIN k USING (a, b)")
def conditional_probability(spark, d):
    return _round(S.conditional_probability(_class_pairs(spark, d), S.inferred(D.marks(spark, d), _up(spark, d))), "p")


_PART_PAIRS = "SELECT 'P:' || p_partkey AS a, 'P:' || (p_partkey + 1) AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)"


@query("class_lin", _IC + f", pairs AS ({_PART_PAIRS}), k AS (SELECT a, b, x.target AS lcs, ic.ic AS ic, row_number() OVER (PARTITION BY a, b ORDER BY round(ic.ic, 9) DESC, x.target) AS r FROM pairs JOIN up x ON x.source = a JOIN up y ON y.source = b AND y.target = x.target JOIN ic ON ic.attribute = x.target) SELECT a, b, lcs, round(k.ic, 6) + 0.0 AS lcs_ic, round(CASE WHEN ia.ic + ib.ic > 0 THEN 2 * k.ic / (ia.ic + ib.ic) ELSE 0 END, 6) + 0.0 AS lin FROM k JOIN ic ia ON ia.attribute = a JOIN ic ib ON ib.attribute = b WHERE r = 1")
def class_lin(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    near = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey", "left_semi").select(F.concat(F.lit("P:"), "p_partkey").alias("a"), F.concat(F.lit("P:"), F.col("p_partkey") + 1).alias("b"))
    up = _up(spark, d)
    ic = S.information_content(S.inferred(D.marks(spark, d), up))
    return _round(S.lin(near, up, ic), "lcs_ic", "lin")


@query("co_annotation_weights", _FULL + ", few AS (SELECT * FROM full_ WHERE attribute NOT LIKE 'P:%'), n AS (SELECT attribute, count(*) AS n FROM few GROUP BY 1), k AS (SELECT x.attribute AS a, y.attribute AS b, count(*) AS n_both FROM few x JOIN few y ON x.element = y.element AND x.attribute <> y.attribute GROUP BY 1, 2) SELECT a, b, n_both, round(ln(n_both) * ln((SELECT count(DISTINCT element) FROM few) + n), 6) + 0.0 AS weight FROM k JOIN n ON attribute = b")
def co_annotation_weights(spark, d):
    within = C.nodes(D.part_edges(spark, d)).where("node not like 'P:%'").select(F.col("node").alias("attribute"))
    return _round(S.co_annotation_weights(S.inferred(D.marks(spark, d), _up(spark, d)), within), "weight")


_SEARCH = _IC + ", pairs AS (SELECT (SELECT min(element) FROM marks) AS a, element AS b FROM (SELECT DISTINCT element FROM marks)), w AS (SELECT element, f.attribute, ic FROM full_ f JOIN ic USING (attribute)), own AS (SELECT element, count(*) AS n FROM w GROUP BY 1), k AS (SELECT a, b, count(*) AS n_common, max(x.ic) AS max_ic FROM pairs JOIN w x ON x.element = a JOIN full_ y ON y.element = b AND y.attribute = x.attribute GROUP BY 1, 2), s AS (SELECT a, b, n_common / (oa.n + ob.n - n_common) AS simj, max_ic FROM k JOIN own oa ON oa.element = a JOIN own ob ON ob.element = b), s2 AS (SELECT * FROM s WHERE floor(100 * simj + 1e-9) >= 20 AND max_ic > 1.0), l AS (SELECT m.element, m.attribute, u.target AS subsumer, ic FROM marks m JOIN up u ON u.source = m.attribute JOIN ic ON ic.attribute = u.target), cells AS (SELECT a, b, x.attribute AS at_a, y.attribute AS at_b, max(x.ic) AS m FROM s2 JOIN l x ON x.element = a JOIN l y ON y.element = b AND y.subsumer = x.subsumer GROUP BY 1, 2, 3, 4), ba AS (SELECT a, b, sum(m) AS s FROM (SELECT a, b, at_a, max(m) AS m FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2), bb AS (SELECT a, b, sum(m) AS s FROM (SELECT a, b, at_b, max(m) AS m FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2), n AS (SELECT element, count(*) AS n FROM marks GROUP BY 1), o AS (SELECT s2.*, (ba.s + bb.s) / (na.n + nb.n) AS bma FROM s2 JOIN ba USING (a, b) JOIN bb USING (a, b) JOIN n na ON na.element = a JOIN n nb ON nb.element = b), f AS (SELECT *, CAST(floor((floor(100 * max_ic / (SELECT max(max_ic) FROM o) + 1e-9) + floor(100 * bma / (SELECT max(bma) FROM o) + 1e-9)) / 2) AS BIGINT) AS combined FROM o) SELECT a, b, round(simj, 6) AS simj, round(max_ic, 6) AS max_ic, round(bma, 6) AS bma, combined, row_number() OVER (ORDER BY combined DESC, b) - 1 AS rank FROM f WHERE a <> b"


@query("profile_search_ranked", _SEARCH)
def profile_search_ranked(spark, d):
    marks = D.marks(spark, d)
    first = marks.agg(F.min("element").alias("element"))
    return _round(S.search(first, marks.select("element"), marks, _up(spark, d), 20, 1.0), "simj", "max_ic", "bma")


@query("metric_statistics", _FULL + f", pairs AS ({D.PAIRS}), own AS (SELECT element, count(*) AS n FROM full_ GROUP BY 1), k AS (SELECT a, b, count(*) AS n FROM pairs JOIN full_ x ON x.element = a JOIN full_ y ON y.element = b AND y.attribute = x.attribute GROUP BY 1, 2), s AS (SELECT k.n / (oa.n + ob.n - k.n) AS simj, k.n / ob.n AS asym FROM k JOIN own oa ON oa.element = a JOIN own ob ON ob.element = b), m AS (SELECT 'simj' AS metric, simj AS v FROM s UNION ALL SELECT 'asym', asym FROM s) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM m GROUP BY 1")
def metric_statistics(spark, d):
    ic, sets = _content(spark, d)
    return _round(S.metric_statistics(S.pair_scores(D.pairs(spark, d), None, ic, sets), "simj", "asym"), "mean", "low", "high")


@query("name_checks", "WITH s AS (SELECT p_partkey AS id, p_brand AS label FROM part UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size = 3), n AS (SELECT p_partkey AS id, CASE WHEN p_size = 5 THEN NULL WHEN p_size = 6 THEN p_brand ELSE p_name END AS label FROM part) SELECT id, 'missing_label' AS problem FROM n WHERE label IS NULL UNION ALL SELECT id, 'duplicate_label' FROM n WHERE label IN (SELECT label FROM n WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT DISTINCT id, 'duplicate_synonym' FROM s GROUP BY id, label HAVING count(*) > 1 UNION ALL SELECT DISTINCT n.id, 'label_is_synonym' FROM n JOIN s ON s.label = n.label AND s.id <> n.id")
def name_checks(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    names = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 5, None).when(F.col("p_size") == 6, F.col("p_brand")).otherwise(F.col("p_name")).alias("label"))
    rows = p.union(p.where("p_size = 3")).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.lit("EXACT").alias("scope"))
    return A.name_checks(names, rows)


_ENRICHED = SQL["class_enrichment"].rpartition(" SELECT attribute, k, c, round(")[0]


@query("enrichment_filtered", _ENRICHED + " SELECT attribute, k, c, round(least(p, 1), 6) AS p, round(least(p * (SELECT count(*) FROM g), 1), 6) AS p_corrected FROM p WHERE NOT EXISTS (SELECT 1 FROM p o JOIN closed z ON z.source = o.attribute AND z.target = p.attribute AND z.source <> z.target WHERE round(o.p, 12) < round(p.p, 12))")
def enrichment_filtered(spark, d):
    full = S.inferred(D.marks(spark, d), _up(spark, d)).where("attribute not like 'P:%'")
    sample = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("element"))
    return _round(S.enrichment_filtered(S.enrichment(full, sample), C.closure(D.part_edges(spark, d))), "p", "p_corrected")
