"""Queries of documents that are written from the tables and read again: ontologies with imports, annotation files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.functions import parsing as P
from ontoloom.operators import annotations as A
from ontoloom.operators import closure as C
from ontoloom.plans import derived as D
from ontoloom.plans import derived_axioms as X
from ontoloom.plans.register import query, up_sql
from ontoloom.plans.session import settle, shared_path
from ontoloom.sources import annotation_files, owl_xml
from ontoloom.sources.annotations import joined

_BASE, _MID, _TOP = ("http://ontoloom.test/" + x for x in ("base", "mid", "top"))


def _documents(spark, d):
    """Regions, nations and suppliers in one RDF/XML document; customers in an OWL/XML one that imports it; parts in one that imports both."""
    ax, ex = X.axioms(spark, d), X.expressions(spark, d)
    low = F.col("sub").rlike("^[RNU]:")
    folder = shared_path(spark, "documents")
    places = {_BASE: f"{folder}/base", _MID: f"{folder}/mid", _TOP: f"{folder}/top"}
    owl_xml.write_rdf_xml(ax.where(low), ex, places[_BASE], _BASE, [_TOP])  # a cycle of imports
    owl_xml.write_owl_xml(ax.where(F.col("sub").like("C:%")), ex, places[_MID], _MID, [_BASE])
    owl_xml.write_owl_xml(ax.where(F.col("sub").like("P:%")), ex, places[_TOP], _TOP, [_BASE, _MID])
    owl_xml.write_catalog(spark, places, f"{folder}/catalog")
    return owl_xml.load(spark, places[_TOP], owl_xml.read_catalog(spark, f"{folder}/catalog"))


#: An expression's text, of the derived axioms' ids.
_TEXT = "CASE WHEN sup LIKE 'X:%' THEN 'ObjectSomeValuesFrom(' || split_part(sup, ':', 2) || ' ' || regexp_extract(sup, '^X:[^:]*:(.*)$', 1) || ')' WHEN sup LIKE 'O:%' THEN 'ObjectAllValuesFrom(trades_in ' || regexp_extract(sup, '^O:[^:]*:(.*)$', 1) || ')' WHEN sup LIKE 'A:%' THEN 'ObjectIntersectionOf(ObjectSomeValuesFrom(member_of N:' || substr(sup, 3) || ') COMPANY)' ELSE sup END"
_NAMES = lambda c: f"replace(replace(replace(replace({c}, 'ROOT', '{_BASE[:-4]}ROOT'), 'COMPANY', '{_BASE[:-4]}COMPANY'), '(part_of ', '({_BASE[:-4]}part_of '), '(member_of ', '({_BASE[:-4]}member_of ')"
_TOPS = lambda c: f"replace(replace({c}, '(made_in ', '({_BASE[:-4]}made_in '), '(trades_in ', '({_BASE[:-4]}trades_in ')"


@query("ontology_with_imports", f"SELECT DISTINCT sub, {_TOPS(_NAMES(_TEXT))} AS sup, CASE WHEN sub LIKE 'P:%' THEN '{_TOP}' WHEN sub LIKE 'C:%' THEN '{_MID}' ELSE '{_BASE}' END AS document FROM ({X.AXIOMS})")
def ontology_with_imports(spark, d):
    """Names without an id space are relative to their document."""
    return _documents(spark, d).subclasses()


@query("imported_superclasses", f"WITH RECURSIVE e AS (SELECT source, target FROM ({X.NAMED}) WHERE label = 'SUBCLASS_OF' AND target NOT IN ('COMPANY', 'ROOT')), c(source, target) AS (SELECT source, target FROM e UNION SELECT c.source, e.target FROM c JOIN e ON c.target = e.source) SELECT source, target FROM c UNION SELECT source, '{_BASE[:-4]}ROOT' FROM ({X.NAMED}) WHERE target = 'ROOT'")
def imported_superclasses(spark, d):
    """Closure over the named superclasses of all documents."""
    named = _documents(spark, d).subclasses().where("sup not like 'Object%' and sub not like 'Object%'")
    return C.closure(named.select(F.col("sub").alias("source"), F.col("sup").alias("target"))).select("source", "target")


# Annotation files.

TODAY = "1997-06-17"


def _file_rows(spark, d):
    """The 17 columns of an annotation file: derived annotations, with faults in some."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("annotation_id"), F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("s"))
    ann = D.annotations(spark, d).drop("taxon", "assigned_by").join(line, "annotation_id")
    k, text = F.col("k"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    return ann.select(
        F.when(k == 4, "X").otherwise("O").alias("db"), F.col("object_id").cast("string").alias("object_id"), text("s", F.col("object_id")).alias("symbol"), "qualifier", "cls", text("REF:", F.col("annotation_id")).alias("reference"), "evidence",
        F.array_join("with_from", "|").alias("with_from"), F.element_at(F.array(*map(F.lit, "FPC")), (k % 3 + 1).cast("int")).alias("aspect"), F.lit("an order").alias("name"), F.lit("a b|c d").alias("synonym"), F.lit("gene").alias("type"),
        F.when(F.col("s") % 10 == 3, text("tax:", F.col("s"))).when(k == 5, text("taxon:", F.col("s"), "|taxon:1")).otherwise(text("taxon:", F.col("s"))).alias("taxon"), F.date_format("date", "yyyyMMdd").alias("date"), F.when(k == 7, "").otherwise("me").alias("assigned_by"),
        F.when(k == 3, "part_of(N:1),occurs_in(N:2)|part_of(N:3)").when(k == 6, "part_of(nowhere)").otherwise("").alias("extension"), F.lit("").alias("isoform"),
    )


def _read_back(spark, d):
    path = shared_path(spark, "gaf")
    annotation_files.write_gaf(_file_rows(spark, d), path, ("derived",), "gzip")
    return annotation_files.read_gaf(spark, path)


def _id():
    return F.substring_index("reference", ":", -1).cast("long")


_ANN = f"ann AS (SELECT a.*, l_linenumber AS k, l_suppkey AS s, l_orderkey AS o FROM ({D.ANNOTATIONS}) AS a JOIN lineitem ON l_orderkey * 10 + l_linenumber = annotation_id)"


@query("file_annotations", f"WITH {_ANN} SELECT annotation_id, CASE k WHEN 4 THEN 'X:' ELSE 'O:' END || o AS bioentity, cls, evidence, coalesce(partner, '') AS partners, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END AS flags, CASE k % 4 WHEN 2 THEN 'contributes_to' WHEN 3 THEN 'colocalizes_with' ELSE ['enables', 'involved_in', 'part_of'][k % 3 + 1] END AS relation, date, CASE WHEN s % 10 = 3 THEN 'tax:' ELSE 'taxon:' END || s AS taxon, CASE WHEN k = 5 AND s % 10 <> 3 THEN 'taxon:1' END AS interacting_taxon, CASE k WHEN 3 THEN 'part_of(N:1),occurs_in(N:2)|part_of(N:3)' WHEN 6 THEN 'part_of(nowhere)' ELSE '' END AS extension FROM ann")
def file_annotations(spark, d):
    found = annotation_files.annotations(_read_back(spark, d), _id())
    return found.select("annotation_id", "bioentity", "cls", "evidence", F.array_join("with_from", "|").alias("partners"), "flags", "relation", "date", "taxon", "interacting_taxon", P.extension_text(F.col("ext")).alias("extension"))


_ECO = [("IEA", "ECO:0000501"), ("IDA", "ECO:0000314")]


@query("file_associations", f"WITH {_ANN} SELECT CASE k WHEN 4 THEN 'X' ELSE 'O' END AS db, CAST(o AS VARCHAR) AS object_id, cls, 'REF:' || annotation_id AS reference, CASE evidence WHEN 'IEA' THEN 'ECO:0000501' WHEN 'IDA' THEN 'ECO:0000314' ELSE evidence END AS eco, CASE WHEN k % 4 IN (1, 2) THEN 'NOT|' ELSE '' END || CASE k % 4 WHEN 2 THEN 'contributes_to' WHEN 3 THEN 'colocalizes_with' ELSE ['enables', 'involved_in', 'part_of'][k % 3 + 1] END AS qualifier, 's' || o AS symbol, 'gene' AS type FROM ann")
def file_associations(spark, d):
    """Annotations written as association and entity files, read again and joined; the X entities come from a file of the older form."""
    gpad, gpi = annotation_files.to_associations(_read_back(spark, d), spark.createDataFrame(_ECO, "evidence string, eco string"))
    paths = [shared_path(spark, x) for x in ("gpad", "gpi", "gpi-old")]
    annotation_files.write_gpad(gpad, paths[0], "gzip")
    annotation_files.write_gpi(gpi.where("db <> 'X'"), paths[1], compression="gzip")
    annotation_files.write_gpi(gpi, paths[2], "X", "gzip")
    entities = annotation_files.read_gpi(spark, paths[1]).union(annotation_files.read_gpi(spark, paths[2]))
    return joined(annotation_files.read_gpad(spark, paths[0]), entities).select("db", "object_id", "cls", "reference", "eco", "qualifier", "symbol", "type")


_FAULTS = [
    ("unknown_database", "k = 4", "error"), ("taxon_format", "s % 10 = 3", "error"), ("assigned_by_missing", "k = 7", "error"), ("missing_assigned_by", "k = 7", "error"), ("extension_without_id_space", "k = 6", "error"), ("qualifier_blank_inside", "k % 4 = 2", "error"),
    ("electronic_older_than_a_year", f"evidence = 'IEA' AND date < DATE '{TODAY}' - INTERVAL 12 MONTH", "error"), ("iea_older_than_a_year", f"evidence = 'IEA' AND date < DATE '{TODAY}' - INTERVAL 12 MONTH", "error"),
    ("ida_forbids_with", "evidence = 'IDA' AND partner IS NOT NULL", "error"), ("ipi_needs_with", "evidence = 'IPI' AND partner IS NULL", "error"), ("binding_needs_with", "cls IN ('P:1', 'P:2') AND (evidence NOT IN ('IPI', 'IEA') OR partner IS NULL)", "warning"),
    ("odd_qualifier", "regexp_matches(qualifier, 'odd$')", "warning"), ("high_level", "cls IN (SELECT 'P:' || p_partkey FROM part WHERE p_size = 7)", "error"),
    ("iep_only_under", "evidence = 'IPI' AND cls NOT IN (SELECT source FROM closed WHERE target = 'S:2')", "error"), ("ipi_never_under", "evidence = 'IPI' AND cls IN (SELECT source FROM closed WHERE target = 'S:1')", "warning"),
    ("not_reciprocal", "cls = 'P:1' AND partner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ann AS y WHERE y.cls = 'P:1' AND CASE y.k WHEN 4 THEN 'X:' ELSE 'O:' END || y.o = ann.partner AND y.partner = CASE ann.k WHEN 4 THEN 'X:' ELSE 'O:' END || ann.o)", "error"),
]


@query("file_violations", up_sql(D.PART) + f", {_ANN} " + " UNION ALL ".join(f"SELECT {'DISTINCT ' * (rule == 'not_reciprocal')}annotation_id, '{rule}' AS rule, '{level}' AS severity FROM ann WHERE {test}" for rule, test, level in _FAULTS))
def file_violations(spark, d):
    """All checks of an annotation file that was written and read again: its columns, rules on rows, patterns, classes, evidence, partners."""
    rows = _read_back(spark, d)
    ann = settle(annotation_files.annotations(rows, _id()), "annotations")
    closed = C.closure(D.part_edges(spark, d))
    rules = A.standard_rules(TODAY, "P:1", "P:2")
    top = spark.read.parquet(f"{d}/part.parquet").where("p_size = 7").select(F.concat(F.lit("P:"), "p_partkey").alias("node"))
    found = [
        annotation_files.column_checks(rows, TODAY, spark.createDataFrame([("O",)], "node string"), line_id=_id()),
        A.row_rules(ann, rules),
        A.pattern_rules(ann, "qualifier", {"odd_qualifier": "odd$"}),
        A.in_subset(ann, top, "high_level"),
        A.evidence_only_under(ann, closed, "IPI", "S:2", "iep_only_under"),
        A.evidence_never_under(ann, closed, "IPI", "S:1", "ipi_never_under"),
        A.reciprocal(ann, "P:1"),
    ]
    return annotation_files.violations(found, {rule: level for rule, _, level in _FAULTS})
