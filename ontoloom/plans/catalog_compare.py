"""Queries of set scores, exact similarity joins, statistics of content, views, and further annotation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import annotations as A
from ontoloom.operators import closure as C
from ontoloom.operators import comparisons as P
from ontoloom.operators import labelled as L
from ontoloom.operators import similarity as S
from ontoloom.plans import derived as D
from ontoloom.plans.catalog import _PART_PAIRS, _content, _full, _part_pairs, _round, _up, full_sql, ic_sql
from ontoloom.plans.catalog_annotations import TODAY
from ontoloom.plans.register import query, up_sql
from ontoloom.plans.session import settle


@query("class_set_scores", up_sql(D.PART) + f", pairs AS ({_PART_PAIRS}), n AS (SELECT source, count(*) AS n FROM up GROUP BY 1), k AS (SELECT a, b, count(*) AS o FROM pairs JOIN up x ON x.source = a JOIN up y ON y.source = b AND y.target = x.target GROUP BY 1, 2) SELECT a, b, na.n AS n_a, nb.n AS n_b, o AS overlap, na.n + nb.n - o AS n_union, round(o / (na.n + nb.n - o), 6) AS jaccard, round(o / na.n, 6) AS of_a, round(o / nb.n, 6) AS of_b, round(o / (na.n + nb.n), 6) AS of_both, round(2 * o / (na.n + nb.n), 6) AS dice, round(o / least(na.n, nb.n), 6) AS of_smaller FROM k JOIN n na ON na.source = a JOIN n nb ON nb.source = b")
def class_set_scores(spark, d):
    out = P.set_scores(_part_pairs(spark, d), P.ancestors_as_sets(_up(spark, d)))
    return _round(out, "jaccard", "of_a", "of_b", "of_both", "dice", "of_smaller")


@query("similar_classes", up_sql(D.PART) + ", s AS (SELECT source AS element, target AS attribute FROM up WHERE source LIKE 'P:%'), n AS (SELECT element, count(*) AS n FROM s GROUP BY 1), k AS (SELECT x.element AS a, y.element AS b, count(*) AS o FROM s x JOIN s y ON x.attribute = y.attribute AND x.element < y.element GROUP BY 1, 2) SELECT a, b, round(o / (na.n + nb.n - o), 6) AS jaccard FROM k JOIN n na ON na.element = a JOIN n nb ON nb.element = b WHERE 100 * o >= 40 * (na.n + nb.n - o)")
def similar_classes(spark, d):
    return P.similar_pairs(P.ancestors_as_sets(_up(spark, d)).where("element like 'P:%'"), 40, digits=6)


_W = ic_sql() + f", pairs AS ({D.PAIRS}), w AS (SELECT element, f.attribute, ic FROM full_ f JOIN ic USING (attribute))"


@query("asymmetric_content", _W + ", t AS (SELECT element, sum(ic) AS t FROM w GROUP BY 1), s AS (SELECT a, b, sum(x.ic) AS s FROM pairs JOIN w x ON x.element = a JOIN w y ON y.element = b AND y.attribute = x.attribute GROUP BY 1, 2) SELECT a, b, round(CASE WHEN t > 0 THEN coalesce(s, 0) / t ELSE 0 END, 6) + 0.0 AS score FROM pairs JOIN t ON t.element = b LEFT JOIN s USING (a, b)")
def asymmetric_content(spark, d):
    ic, sets = _content(spark, d)
    return _round(P.asymmetric_content(D.pairs(spark, d), None, ic, held=sets), "score")


@query("best_subsumers", _W + ", k AS (SELECT a, b, x.attribute, x.ic FROM pairs JOIN w x ON x.element = a JOIN w y ON y.element = b AND y.attribute = x.attribute), m AS (SELECT a, b, max(ic) AS top FROM k GROUP BY 1, 2) SELECT a, b, round(max(ic), 6) AS ic, string_agg(attribute, ',' ORDER BY attribute) AS subsumers FROM k JOIN m USING (a, b) WHERE ic >= top - 0.000001 AND top >= 1 GROUP BY 1, 2")
def best_subsumers(spark, d):
    ic, sets = _content(spark, d)
    return _round(P.best_subsumers(D.pairs(spark, d), None, ic, least=1.0, held=sets), "ic")


@query("content_with_tie_break", ic_sql() + ", n AS (SELECT source, count(*) AS n FROM up GROUP BY 1) SELECT source AS attribute, round(coalesce(i.ic, (SELECT max(j.ic) FROM e JOIN ic j ON j.attribute = e.target WHERE e.source = n.source)) + n / 1000, 6) AS ic FROM n LEFT JOIN ic i ON i.attribute = n.source")
def content_with_tie_break(spark, d):
    edges = D.part_edges(spark, d)
    up = settle(C.reflexive(edges), "up")
    return _round(P.full_content(S.inferred(D.marks(spark, d), up), up, edges, tie_break=True), "ic")


@query("subsumer_scores", ic_sql() + f", pairs AS ({_PART_PAIRS}), k AS (SELECT a, b, x.target AS subsumer FROM pairs JOIN up x ON x.source = a JOIN up y ON y.source = b AND y.target = x.target), l AS (SELECT a, b, subsumer FROM k WHERE NOT EXISTS (SELECT 1 FROM k o JOIN closed c ON c.source = o.subsumer WHERE o.a = k.a AND o.b = k.b AND c.target = k.subsumer AND c.source <> c.target)), z AS (SELECT a, b, count(*) AS n_lcs, sum(ic) AS sum_ic, avg(ic) AS mean_ic FROM l JOIN ic ON attribute = subsumer GROUP BY 1, 2), h AS (SELECT a, b, element FROM l JOIN full_ f ON f.attribute = subsumer GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM l q WHERE q.a = l.a AND q.b = l.b)), g AS (SELECT a, b, -log2(count(*) / (SELECT count(DISTINCT element) FROM full_)) AS conjunction FROM h GROUP BY 1, 2) SELECT a, b, n_lcs, round(sum_ic, 6) + 0.0 AS sum_ic, round(mean_ic, 6) + 0.0 AS mean_ic, round(conjunction, 6) + 0.0 AS conjunction, round(CASE WHEN least(p.ic, q.ic) > 0 THEN conjunction / least(p.ic, q.ic) END, 6) + 0.0 AS ratio FROM z LEFT JOIN g USING (a, b) JOIN ic p ON p.attribute = a JOIN ic q ON q.attribute = b")
def subsumer_scores(spark, d):
    up = settle(_up(spark, d), "up")
    full = settle(S.inferred(D.marks(spark, d), up), "full")
    return _round(P.subsumer_scores(_part_pairs(spark, d), up, full, settle(S.information_content(full), "ic")), "sum_ic", "mean_ic", "conjunction", "ratio")


@query("set_frequencies", full_sql() + ", s AS (SELECT o_custkey AS set_id, attribute FROM orders JOIN marks ON element = o_orderkey GROUP BY 1, 2), z AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1), h AS (SELECT s.set_id, element FROM s JOIN full_ f USING (attribute) JOIN z USING (set_id) GROUP BY s.set_id, element, z.n HAVING count(*) = z.n) SELECT set_id, count(element) AS n FROM z LEFT JOIN h USING (set_id) GROUP BY 1")
def set_frequencies(spark, d):
    full = _full(spark, d)
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("element"))
    return P.set_frequency(orders.join(D.marks(spark, d), "element").select("set_id", "attribute"), full)


@query("profile_scores", full_sql() + ", o AS (SELECT o_custkey AS k, o_orderkey AS e FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey IN (SELECT element FROM full_)), p AS (SELECT DISTINCT k, f.attribute FROM o JOIN full_ f ON f.element = e), n AS (SELECT element, count(*) AS n FROM full_ GROUP BY 1), z AS (SELECT k, count(*) AS n FROM p GROUP BY 1), x AS (SELECT o.k, o.e, count(*) AS o FROM o JOIN p ON p.k = o.k JOIN full_ f ON f.element = o.e AND f.attribute = p.attribute GROUP BY 1, 2) SELECT 'K:' || x.k AS a, 'O:' || e AS b, round(o / (z.n + n.n - o), 6) AS jaccard FROM x JOIN z ON z.k = x.k JOIN n ON n.element = e")
def profile_scores(spark, d):
    up = settle(_up(spark, d), "up")
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey % 5 = 0").select(F.concat(F.lit("K:"), "o_custkey").alias("a"), F.col("o_orderkey").alias("element"))
    marked = o.join(D.marks(spark, d), "element")
    profiles = P.profile_marks(marked.select(F.col("a").alias("profile"), "attribute"), up)
    single = P.profile_marks(marked.select(F.concat(F.lit("O:"), "element").alias("profile"), "attribute"), up)
    pairs = marked.select("a", F.concat(F.lit("O:"), "element").alias("b")).distinct()
    return _round(P.set_scores(pairs, profiles.union(single)), "jaccard").select("a", "b", "jaccard")


_FEW = full_sql() + ", few AS (SELECT * FROM full_ WHERE attribute LIKE 'S:%' OR attribute LIKE 'B:%')"
_TAIL = "sum(exp(lgamma(n_b + 1) - lgamma(x + 1) - lgamma(n_b - x + 1) + lgamma(m - n_b + 1) - lgamma(n_a - x + 1) - lgamma(m - n_b - n_a + x + 1) - lgamma(m + 1) + lgamma(n_a + 1) + lgamma(m - n_a + 1)))"


def _tail_sql(rows: str) -> str:
    """P(X >= n_both) by the whole sum, for rows a, b, n_a, n_b, n_both, m."""
    return f"SELECT a, b, n_a, n_b, n_both, least({_TAIL}, 1) AS p FROM (SELECT *, unnest(range(n_both, least(n_a, n_b) + 1)) AS x FROM ({rows})) WHERE n_a - x <= m - n_b GROUP BY 1, 2, 3, 4, 5"


@query("overlap_enrichment", _FEW + ", n AS (SELECT attribute, count(*) AS n FROM few GROUP BY 1), k AS (SELECT x.attribute AS a, y.attribute AS b, count(*) AS n_both FROM few x JOIN few y ON x.element = y.element WHERE x.attribute < y.attribute GROUP BY 1, 2), r AS (SELECT a, b, p.n AS n_a, q.n AS n_b, n_both, (SELECT count(DISTINCT element) FROM full_) AS m FROM k JOIN n p ON p.attribute = a JOIN n q ON q.attribute = b) SELECT a, b, n_a, n_b, n_both, round(p, 6) + 0.0 AS p FROM (" + _tail_sql("SELECT * FROM r") + ")")
def overlap_enrichment(spark, d):
    marks, up = D.marks(spark, d), settle(_up(spark, d), "up")
    few = S.inferred(marks, up.where("target like 'S:%' or target like 'B:%'")).select(F.col("attribute").alias("cls"), "element")
    population = marks.join(up.select(F.col("source").alias("attribute")), "attribute", "left_semi").agg(F.count_distinct("element")).first()[0]
    return _round(P.overlap_enrichment(few, few, population).where("a < b"), "p")


@query("homologous_classes", "WITH o AS (SELECT p_partkey AS l, p_partkey + 1 AS r FROM part WHERE p_partkey % 2 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)), x AS (SELECT 'B:' || p_brand AS c, l AS k FROM part JOIN o ON l = p_partkey), y AS (SELECT 'B:' || p_brand AS c, l AS k FROM part JOIN o ON r = p_partkey), nx AS (SELECT c, count(*) AS n FROM x GROUP BY 1), ny AS (SELECT c, count(*) AS n FROM y GROUP BY 1), r AS (SELECT x.c AS a, y.c AS b, any_value(nx.n) AS n_a, any_value(ny.n) AS n_b, count(*) AS n_both, (SELECT count(*) FROM o) AS m FROM x JOIN y USING (k) JOIN nx ON nx.c = x.c JOIN ny ON ny.c = y.c GROUP BY 1, 2) SELECT a, b, n_a, n_b, n_both, round(p, 6) + 0.0 AS p FROM (" + _tail_sql("SELECT * FROM r") + ")")
def homologous_classes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    marks = p.select(F.concat(F.lit("B:"), "p_brand").alias("cls"), F.col("p_partkey").alias("element"))
    pairs = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("left_gene")).join(p.select((F.col("p_partkey") - 1).alias("left_gene")), "left_gene", "left_semi").select("left_gene", (F.col("left_gene") + 1).alias("right_gene"))
    return _round(P.homologous_classes(marks, marks, pairs), "p")


@query("content_tests", _W + ", v AS (SELECT element, ic, round(ic, 9) AS v FROM w), mo AS (SELECT element, count(*) AS n, avg(ic) AS mean, sum(ic * ic) AS sq FROM v GROUP BY 1), z AS (SELECT a, b, x.n AS na, y.n AS nb, x.mean - y.mean AS gap, (x.sq - x.n * x.mean ** 2 + y.sq - y.n * y.mean ** 2) AS inside FROM pairs JOIN mo x ON x.element = a JOIN mo y ON y.element = b), s AS (SELECT a, b, v, 1 AS x, 0 AS y FROM pairs JOIN v ON element = a UNION ALL SELECT a, b, v, 0, 1 FROM pairs JOIN v ON element = b), g AS (SELECT a, b, v, sum(x) AS x, sum(y) AS y FROM s GROUP BY 1, 2, 3), steps AS (SELECT a, b, abs(sum(x) OVER u / sum(x) OVER w0 - sum(y) OVER u / sum(y) OVER w0) AS d FROM g WINDOW u AS (PARTITION BY a, b ORDER BY v), w0 AS (PARTITION BY a, b)), ks AS (SELECT a, b, max(d) AS ks FROM steps GROUP BY 1, 2) SELECT a, b, round(gap / sqrt(inside / (na + nb - 2) * (1 / na + 1 / nb)), 4) + 0.0 AS t, round(ks, 6) + 0.0 AS ks, na + nb - 2 AS df FROM z JOIN ks USING (a, b)")
def content_tests(spark, d):
    ic, sets = _content(spark, d)
    out = P.content_tests(D.pairs(spark, d), None, ic, held=sets)
    return out.select("a", "b", (F.round("t", 4) + 0.0).alias("t"), (F.round("ks", 6) + 0.0).alias("ks"), "df")


@query("nearest_in_variance", _W + ", m AS (SELECT avg(ic) AS m FROM w WHERE element = 1), z AS (SELECT element, round(sum((ic - m) ** 2) / (count(*) - 1), 9) AS variance FROM w, m WHERE element <> 1 GROUP BY 1 HAVING count(*) > 1) SELECT element, round(variance, 5) AS variance FROM z ORDER BY z.variance, element LIMIT 10")
def nearest_in_variance(spark, d):
    ic, sets = _content(spark, d)
    return P.nearest_in_variance(None, ic, 1, 10, held=sets).select("element", F.round("variance", 5).alias("variance"))


@query("property_view", f"SELECT 'in:' || 'R:' || r_regionkey AS source, 'in:ROOT' AS target FROM region UNION SELECT 'in:C:' || c_custkey, 'in:N:' || c_nationkey FROM customer UNION SELECT 'N:' || n_nationkey, 'in:R:' || n_regionkey FROM nation UNION SELECT 'N:' || n_nationkey, 'in:ROOT' FROM nation UNION SELECT 'C:' || c_custkey, 'in:R:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT 'C:' || c_custkey, 'in:ROOT' FROM customer")
def property_view(spark, d):
    edges = D.labelled_edges(spark, d)
    table = L.compositions(spark.createDataFrame([("part_of", True), ("member_of", False)], "property string, transitive boolean"))
    return P.property_view(edges.where("property = 'is_a'"), L.labelled_closure(edges, table), "part_of", "in:")


@query("subsumer_classes", up_sql(D.PART) + f", pairs AS ({_PART_PAIRS}), k AS (SELECT a, b, x.target AS subsumer FROM pairs JOIN up x ON x.source = a JOIN up y ON y.source = b AND y.target = x.target), l AS (SELECT a, b, string_agg(subsumer, ',' ORDER BY subsumer) AS s, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM k o JOIN closed c ON c.source = o.subsumer WHERE o.a = k.a AND o.b = k.b AND c.target = k.subsumer AND c.source <> c.target) GROUP BY 1, 2) SELECT a, b, CASE WHEN n = 1 THEN s ELSE 'and(' || s || ')' END AS cls FROM l")
def subsumer_classes(spark, d):
    return P.subsumer_classes(_part_pairs(spark, d), settle(_up(spark, d), "up"))


@query("co_annotated_ranked", full_sql() + ", few AS (SELECT * FROM full_ WHERE attribute NOT LIKE 'P:%'), n AS (SELECT attribute, count(*) AS n FROM few GROUP BY 1), k AS (SELECT x.attribute AS a, y.attribute AS b, count(*) AS n_both FROM few x JOIN few y ON x.element = y.element AND x.attribute <> y.attribute GROUP BY 1, 2), w AS (SELECT a, b, n_both, ln(n_both) * ln((SELECT count(DISTINCT element) FROM few) + n) AS weight FROM k JOIN n ON attribute = b), r AS (SELECT a, b, n_both, weight, row_number() OVER (PARTITION BY a ORDER BY round(weight, 9) DESC, b) AS rank FROM w WHERE a LIKE 'S:%' AND weight >= 1) SELECT a, b, n_both, rank FROM r WHERE rank <= 5")
def co_annotated_ranked(spark, d):
    classes = C.nodes(D.part_edges(spark, d)).where("node not like 'P:%'").select(F.col("node").alias("attribute"))
    weights = S.co_annotation_weights(_full(spark, d), classes)
    return P.co_annotated(weights, classes.where("attribute like 'S:%'"), 1.0, 5).select("a", "b", "n_both", "rank")


@query("term_count_documents", full_sql() + " SELECT attribute, '{\"n_elements\":' || count(*) || '}' AS json FROM full_ GROUP BY 1")
def term_count_documents(spark, d):
    return P.as_json(S.frequencies(_full(spark, d)), "attribute")


# Annotation checks together.

_ANN = f"ann AS ({D.ANNOTATIONS})"


@query("check_report", f"WITH {_ANN}, r AS (SELECT 'ida_forbids_with' AS rule FROM ann WHERE evidence = 'IDA' AND partner IS NOT NULL UNION ALL SELECT 'ipi_needs_with' FROM ann WHERE evidence = 'IPI' AND partner IS NULL UNION ALL SELECT 'iea_older_than_a_year' FROM ann WHERE evidence = 'IEA' AND date < DATE '{TODAY}' - INTERVAL 12 MONTH UNION ALL SELECT 'odd_qualifier' FROM ann WHERE regexp_matches(qualifier, 'odd$')) SELECT rule, CASE rule WHEN 'odd_qualifier' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM r GROUP BY 1, 2")
def check_report(spark, d):
    ann = D.annotations(spark, d)
    found = [A.row_rules(ann, A.standard_rules(TODAY)), A.pattern_rules(ann, "qualifier", {"odd_qualifier": "odd$"})]
    return A.report(found, {"odd_qualifier": "warning"})


@query("rule_one_row_each", f"WITH {_ANN} SELECT annotation_id, 'nd_to_roots_only' AS rule FROM ann WHERE (evidence = 'IEA') <> (cls IN ('P:3', 'P:4')) UNION ALL SELECT annotation_id, 'no_iss_to_protein_binding' FROM ann WHERE cls = 'P:2' AND evidence = 'IPI'")
def rule_one_row_each(spark, d):
    recoded = D.annotations(spark, d).withColumn("evidence", F.when(F.col("evidence") == "IEA", "ND").when(F.col("evidence") == "IPI", "ISS").otherwise(F.col("evidence")))
    rules = A.standard_rules(TODAY, "P:1", "P:2", ("P:3", "P:4"))
    return A.row_rules(recoded, {r: rules[r] for r in ("nd_to_roots_only", "no_iss_to_protein_binding")})


@query("rule_two_taxa", up_sql(D.PART) + f", {_ANN} SELECT annotation_id, 'two_taxa' AS rule FROM ann WHERE taxon LIKE '%1' AND cls NOT IN (SELECT source FROM up WHERE target = 'S:2')")
def rule_two_taxa(spark, d):
    ann = D.annotations(spark, d).withColumn("interacting_taxon", F.when(F.col("taxon").endswith("1"), "T:2"))
    return A.two_taxa(ann, _up(spark, d), "S:2")


@query("taxon_matrix", up_sql(D.PART) + ", x AS (SELECT 'P:' || p_partkey AS cls FROM part WHERE p_partkey % 10 = 0), t AS (SELECT cls, 'N:' || n_nationkey AS taxon FROM x, nation) SELECT cls, string_agg(taxon, ',' ORDER BY taxon) AS taxa FROM t WHERE NOT EXISTS (SELECT 1 FROM up WHERE source = cls AND target = 'S:1') OR taxon IN (SELECT 'N:' || n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def taxon_matrix(spark, d):
    up, taxa = _up(spark, d), C.reflexive(D.geo_edges(spark, d))
    classes = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 10 = 0").select(F.concat(F.lit("P:"), "p_partkey").alias("cls"))
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), "n_nationkey").alias("taxon"))
    only = spark.createDataFrame([("S:1", "R:1")], "cls string, taxon string")
    return A.taxon_matrix(classes, nations, up, only, only.limit(0), taxa)


@query("redundant_predictions", up_sql(D.PART) + f", {_ANN}, p AS (SELECT DISTINCT bioentity, 'B:' || p_brand AS cls FROM ann JOIN part ON cls = 'P:' || p_partkey WHERE annotation_id % 3 = 0 UNION SELECT DISTINCT bioentity, cls FROM ann WHERE annotation_id % 2 = 0), h AS (SELECT DISTINCT bioentity, target AS cls FROM ann JOIN up ON source = cls WHERE annotation_id % 2 = 1), o AS (SELECT DISTINCT q.bioentity, u.target AS cls FROM p q JOIN up u ON u.source = q.cls AND u.target <> q.cls) SELECT p.bioentity, p.cls, h.cls IS NOT NULL AS by_annotation, o.cls IS NOT NULL AS by_prediction FROM p LEFT JOIN h USING (bioentity, cls) LEFT JOIN o USING (bioentity, cls)")
def redundant_predictions(spark, d):
    ann, up = D.annotations(spark, d), _up(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P:"), "p_partkey").alias("cls"), F.concat(F.lit("B:"), "p_brand").alias("_b"))
    brands = ann.where("annotation_id % 3 = 0").join(part, "cls").select("bioentity", F.col("_b").alias("cls"))
    predicted = brands.union(ann.where("annotation_id % 2 = 0").select("bioentity", "cls")).distinct()
    return A.flagged(predicted, ann.where("annotation_id % 2 = 1"), up)


@query("unfolded_annotations", f"WITH {_ANN} SELECT annotation_id, 'DB:' || p_brand AS cls, 'has_size(S:' || p_size || ')' AS extension FROM ann JOIN part ON cls = 'P:' || p_partkey")
def unfolded_annotations(spark, d):
    from ontoloom.plans.derived_axioms import definitions

    ann = D.annotations(spark, d).withColumn("cls", F.concat(F.lit("D"), "cls"))
    return A.unfold(ann, definitions(spark, d).where("cls like 'DP:%'")).select("annotation_id", "cls", "extension")


@query("folded_into_known_classes", f"WITH {_ANN} SELECT annotation_id, 'DP:' || min(q.p_partkey) AS cls FROM ann JOIN part p ON cls = 'P:' || p.p_partkey JOIN part q ON q.p_brand = p.p_brand AND q.p_size = p.p_size GROUP BY 1")
def folded_into_known_classes(spark, d):
    from ontoloom.plans.derived_axioms import definitions

    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P:"), "p_partkey").alias("cls"), F.concat(F.lit("DB:"), "p_brand").alias("_b"), F.concat(F.lit("S:"), "p_size").alias("_s"))
    ann = D.annotations(spark, d).join(part, "cls").select("annotation_id", F.col("_b").alias("cls"), F.array(F.array(F.struct(F.lit("has_size").alias("relation"), F.col("_s").alias("cls")))).alias("ext"))
    number = F.substring("cls", 4, 20).cast("long")
    found = A.folded(ann, definitions(spark, d).where("cls like 'DP:%'"), first=number)
    return found.groupBy("annotation_id").agg(F.min(number).alias("k")).select("annotation_id", F.concat(F.lit("DP:"), "k").alias("cls"))


@query("evidence_classes", f"WITH {_ANN} SELECT annotation_id, CASE evidence WHEN 'IPI' THEN 'ECO:0000353' WHEN 'IEA' THEN 'ECO:0000501' ELSE 'ECO:0000314' END AS eco FROM ann")
def evidence_classes(spark, d):
    table = spark.createDataFrame([("IPI", None, "ECO:0000353"), ("IDA", None, "ECO:0000314"), ("IEA", None, "ECO:0000501"), ("IEA", "REF:2", "ECO:0000256")], "evidence string, ref string, eco string")
    return A.to_eco(D.annotations(spark, d).withColumn("refs", F.array(F.lit("REF:1"))), table).select("annotation_id", "eco")


@query("database_tables", f"WITH {_ANN}, t AS (SELECT DISTINCT cls FROM ann), g AS (SELECT DISTINCT bioentity FROM ann) SELECT 'term' AS kind, count(*) AS n, CAST(sum(length(cls)) AS BIGINT) AS chars FROM t UNION ALL SELECT 'gene_product', count(*), CAST(sum(length(bioentity)) AS BIGINT) FROM g UNION ALL SELECT 'association', count(*), CAST(sum(length(cls) + length(bioentity)) AS BIGINT) FROM ann")
def database_tables(spark, d):
    tables = A.database_tables(D.annotations(spark, d))
    ids = lambda t: tables[t].select("id", "acc")
    terms, genes = ids("term"), ids("gene_product")
    linked = tables["association"].join(terms.toDF("term_id", "_t"), "term_id").join(genes.toDF("gene_product_id", "_g"), "gene_product_id")
    count = lambda df, kind, chars: df.agg(F.count(F.lit(1)).alias("n"), F.sum(chars).cast("long").alias("chars")).select(F.lit(kind).alias("kind"), "n", "chars")
    return count(terms, "term", F.length("acc")).union(count(genes, "gene_product", F.length("acc"))).union(count(linked, "association", F.length("_t") + F.length("_g")))
