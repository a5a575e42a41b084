"""Annotation tables: readers and writers of 15/17-column annotation files, 12-column associations, 10-column entities.

Lines that begin with ! are comments.  A line with too few columns keeps its
text and gets status "short"; one with more than known gets "long" and its
first columns; others are "ok".  Empty lines are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import parsing as P

#: Columns of the file formats, in order.
GAF = ("db", "object_id", "symbol", "qualifier", "cls", "reference", "evidence", "with_from", "aspect", "name", "synonym", "type", "taxon", "date", "assigned_by", "extension", "isoform")
GPAD = ("db", "object_id", "qualifier", "cls", "reference", "eco", "with_from", "interacting_taxon", "date", "assigned_by", "extension", "properties")
GPI = ("db", "object_id", "symbol", "name", "synonym", "type", "taxon", "parent_id", "xref", "properties")


def _rows(spark: SparkSession, path: str, names: tuple[str, ...], least: int) -> DataFrame:
    lines = spark.read.text(path).where("value not like '!%' and trim(value) <> ''")
    cut = lines.select(F.col("value").alias("line"), F.split("value", "\t", -1).alias("_c"))
    n = F.size("_c")
    status = F.when(n < least, "short").when(n > len(names), "long").otherwise("ok").alias("status")
    return cut.select(*[F.get("_c", F.lit(i)).alias(x) for i, x in enumerate(names)], status, "line")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The 15 or 17 columns as text, with status and line; columns 16 and 17 are null in the older form."""
    return _rows(spark, path, GAF, 15)


def typed(rows: DataFrame) -> DataFrame:
    """Annotations with arrays and flags out of read_rows(); date is null where it is no yyyyMMdd."""
    c = F.col
    return rows.where("status <> 'short'").select(
        F.concat_ws(":", "db", "object_id").alias("bioentity"), "symbol", P.qualifier_flags(c("qualifier")).alias("flags"), P.relation(c("aspect"), c("qualifier")).alias("relation"), "cls",
        P.parts(c("reference")).alias("refs"), "evidence", P.parts(c("with_from"), "[|,]").alias("with"), "aspect", "name", P.parts(c("synonym")).alias("synonyms"), "type",
        P.taxon_pair(c("taxon"))["taxon"].alias("taxon"), P.taxon_pair(c("taxon"))["interacting"].alias("interacting_taxon"),
        F.try_to_date("date", "yyyyMMdd").alias("date") if hasattr(F, "try_to_date") else F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date").alias("date"),
        "assigned_by", P.extensions(c("extension")).alias("ext"), "isoform",
    )


def entities(rows: DataFrame) -> DataFrame:
    """One row a bioentity: the one that sorts first where lines differ."""
    return rows.where("status <> 'short'").groupBy(F.concat_ws(":", "db", "object_id").alias("id")).agg(F.min(F.struct("symbol", "name", "synonym", "type", "taxon")).alias("e")).select("id", "e.*")


def read_gpad(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, GPAD, 10)


def read_gpi(spark: SparkSession, path: str, before_1_2: bool = False) -> DataFrame:
    """Entities; in files before version 1.2 the first column (the database) is missing."""
    return _rows(spark, path, GPI[1:] if before_1_2 else GPI, 6)


def joined(gpad: DataFrame, gpi: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Associations with symbol, name, type and taxon of their entities."""
    known = gpi.where("status <> 'short'").dropDuplicates(["db", "object_id"]).select("db", "object_id", "symbol", "name", "type", "taxon")
    return gpad.where("status <> 'short'").join(known, ["db", "object_id"], "left" if keep_unknown else "inner")


def _line(names: tuple[str, ...]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(x), F.lit("")) for x in names])


def write_rows(rows: DataFrame, path: str) -> None:
    """17-column lines; the version header is a part of its own, so parts can be written in parallel."""
    rows.select(_line(GAF).alias("value")).write.text(path)


def write_gpad(rows: DataFrame, path: str) -> None:
    rows.select(_line(GPAD).alias("value")).write.text(path)


def write_gpi(rows: DataFrame, path: str) -> None:
    rows.select(_line(GPI).alias("value")).write.text(path)


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, label, member): tab-separated lines of an id, a label and members."""
    c = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("c"))
    return c.select(F.get("c", F.lit(0)).alias("set_id"), F.get("c", F.lit(1)).alias("label"), F.explode(F.slice("c", 3, 1 << 30)).alias("member")).where("member <> ''")


def read_pairs(spark: SparkSession, path: str, left: str = "element", right: str = "attribute") -> DataFrame:
    """Two-column tables without a header, such as edges or element-attribute lists; # begins a comment."""
    c = spark.read.text(path).where("value not like '#%' and value like '%\t%'").select(F.split("value", "\t").alias("c"))
    return c.select(F.trim(F.get("c", F.lit(0))).alias(left), F.trim(F.get("c", F.lit(1))).alias(right))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, db, xref): three-column id mapping rows."""
    c = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("c")).where("size(c) >= 3")
    return c.select(*[F.get("c", F.lit(i)).alias(x) for i, x in enumerate(("id", "db", "xref"))])
