"""Annotation files end to end: version headers, repairs, annotations for the rules, the checks of a file's columns.

A file says its version in a comment line: annotation files of version 2.0 or
later have 17 columns, others 15; association files have 12, entity files from
version 1.2 on begin with the database, which older ones give in a namespace line.
A folder may hold files of several versions: each line is read by its own file's.
Writers give each part its header, so every part is a whole file.

Lines with missing last columns (15 or 16 of 17) are repaired, shorter ones are
listed as `short` and give no annotation, longer ones keep their first columns.
Blank lines and comments give nothing; a file without a version line is of the
oldest version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import parsing as P
from ontoloom.operators import annotations as A
from ontoloom.plans.session import settle, ship_package
from ontoloom.sources.annotations import GAF, GPAD, GPI

#: How many values a column may have, at least and at most (3 stands for any number), by place from 0.
CARDINALITY = {0: (1, 1), 1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 1), 5: (1, 3), 6: (1, 3), 7: (0, 3), 9: (0, 1), 10: (0, 3), 11: (1, 1), 12: (1, 2), 13: (1, 1), 14: (1, 1), 15: (0, 3), 16: (0, 3)}
#: Columns whose values may hold blanks.
FREE_TEXT = ("symbol", "name", "synonym")


def _lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, line, version, namespace) of the lines that aren't blank or comments."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("_t"), F.col("value").alias("line"))
    number = lambda tag: F.regexp_extract("_t", rf"^!{tag}:\s*([0-9]+(?:\.[0-9]+)?)", 1)
    space = F.regexp_extract("_t", r"^!namespace:\s*(\S+)", 1)
    said = text.where(F.col("_t").startswith("!")).groupBy("file").agg(F.max(F.when(number(kind) != "", number(kind).cast("double"))).alias("version"), F.max(F.nullif(space, F.lit(""))).alias("namespace"))
    said = settle(said, "headers")  # a row a file: known to be small before lines are joined with it, so these needn't be moved
    rows = text.where((F.col("_t") != "") & ~F.col("_t").startswith("!")).drop("_t")
    return rows.join(said, "file", "left")


def _cut(lines: DataFrame, names: tuple[str, ...], wanted: Column, least: Column) -> DataFrame:
    cells = F.split("line", "\t", -1)
    rows = lines.select("file", "line", "version", "namespace", cells.alias("_c"), F.size(cells).alias("n_columns"), wanted.alias("_n"), least.alias("_least"))
    status = F.when(F.col("n_columns") < F.col("_least"), "short").when(F.col("n_columns") < F.col("_n"), "repaired").when(F.col("n_columns") > F.col("_n"), "long").otherwise("ok")
    held = [F.when(F.lit(i) < F.col("_n"), F.coalesce(F.get("_c", F.lit(i)), F.lit(""))).alias(x) for i, x in enumerate(names)]
    return rows.select(*held, status.alias("status"), "n_columns", "version", "namespace", "file", "line")


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """The 15 or 17 columns of annotation files as text, with status, n_columns, version, file and line."""
    new = F.coalesce(F.col("version") >= 2, F.lit(False))
    return _cut(_lines(spark, path, "gaf-version"), GAF, F.when(new, 17).otherwise(15), F.lit(15))


def read_gpad(spark: SparkSession, path: str) -> DataFrame:
    return _cut(_lines(spark, path, "gpa-version"), GPAD, F.lit(12), F.lit(10))


def read_gpi(spark: SparkSession, path: str) -> DataFrame:
    """Entities; the database of older files is their namespace."""
    lines = _lines(spark, path, "gpi-version")
    old = F.coalesce(F.col("version") < 1.2, F.lit(True))
    lines = lines.withColumn("line", F.when(old, F.concat_ws("\t", F.coalesce("namespace", F.lit("")), "line")).otherwise(F.col("line")))
    return _cut(lines, GPI, F.lit(10), F.lit(7))


def annotations(rows: DataFrame, line_id: str | Column = "line") -> DataFrame:
    """What the rules of `ontoloom.operators.annotations` take, of read_gaf() rows; annotation_id is line_id."""
    c = F.col
    pair = P.taxon_pair(c("taxon"))
    return rows.where("status <> 'short'").select(
        (c(line_id) if isinstance(line_id, str) else line_id).alias("annotation_id"), F.concat_ws(":", "db", "object_id").alias("bioentity"), "symbol", "qualifier", P.qualifier_flags(c("qualifier")).alias("flags"),
        P.relation(c("aspect"), c("qualifier")).alias("relation"), "cls", P.parts(c("reference")).alias("refs"), "evidence", P.parts(c("with_from"), "[|,]").alias("with_from"), "aspect", "name", P.parts(c("synonym")).alias("synonyms"),
        "type", pair["taxon"].alias("taxon"), pair["interacting"].alias("interacting_taxon"), F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date").alias("date"), "assigned_by", P.extensions(c("extension")).alias("ext"), "isoform",
    )


def _next(text: Column, what: str, after: Column) -> Column:
    """Where `what` stands in the text after a place; 0 if nowhere."""
    return F.call_function("locate", F.lit(what), text, after + 1)


def column_checks(rows: DataFrame, today: str, databases: DataFrame | None = None, electronic: tuple[str, ...] = ("IEA",), line_id: str | Column = "line") -> DataFrame:
    """(annotation_id, rule): what is wrong with the columns of read_gaf() rows, one row a fault.

    Missing and repeated values, blanks inside later values, dates, electronic
    evidence older than a year, taxa that aren't taxon:number, databases that
    aren't among `databases` (node), extension ids without an id space.
    """
    c = F.col
    rules: dict[str, Column] = {}
    for i, (least, most) in CARDINALITY.items():
        name, v = GAF[i], F.coalesce(F.col(GAF[i]), F.lit(""))
        if least:
            rules[f"{name}_missing"] = v == ""
        if most == 1:
            rules[f"{name}_repeated"] = v.contains("|")
        if most == 2:
            rules[f"{name}_over_two"] = _next(v, "|", _next(v, "|", F.lit(0))) > 0
        if name not in FREE_TEXT:
            rules[f"{name}_blank_inside"] = v.contains("|") & (_next(v, " ", _next(v, "|", F.lit(0))) > 0)
    day = F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date")
    rules["date_format"] = day.isNull()
    rules["electronic_older_than_a_year"] = c("evidence").isin(*electronic) & (day < F.add_months(F.lit(today).cast("date"), -12))
    rules["taxon_format"] = ~F.coalesce("taxon", F.lit("")).rlike(r"(?s)^taxon:-?[0-9]{1,9}(?:\|taxon:-?[0-9]{1,9}(?:\|.*)?)?$")
    spaces = F.flatten(P.extensions(c("extension")))
    rules["extension_without_id_space"] = F.when(F.coalesce("extension", F.lit("")) != "", F.exists(spaces, lambda x: F.instr(x["cls"], ":") <= 1))
    key = (F.col(line_id) if isinstance(line_id, str) else line_id).alias("annotation_id")
    few = rows.where("status <> 'short'").select(key, *GAF)
    found = A.row_rules(few, rules)
    if databases is not None:
        known = databases.select(F.col("node").alias("db")).distinct()
        found = found.union(few.join(known, "db", "left_anti").select("annotation_id", F.lit("unknown_database")))
    return found


def violations(found: list[DataFrame], severities: dict[str, str], default: str = "error") -> DataFrame:
    """(annotation_id, rule, severity), one row a violation of any of the checks."""
    every = found[0]
    for more in found[1:]:
        every = every.union(more.select("annotation_id", "rule"))
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in severities.items() for x in kv]), F.col("rule")), F.lit(default)) if severities else F.lit(default)
    return every.select("annotation_id", "rule", level.alias("severity"))


# Writers.


def _framed(head: str):
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head.split("\n"))], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    return framed


def _write(rows: DataFrame, names: tuple[str, ...], path: str, head: str, compression: str = "none") -> None:
    """Tab-separated lines; tabs and line ends inside a value become blanks."""
    ship_package(rows.sparkSession)
    cell = lambda x: F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    rows.select(F.concat_ws("\t", *[cell(x) for x in names]).alias("value")).mapInArrow(_framed(head), "value string").write.text(path, compression=compression)


def write_gaf(rows: DataFrame, path: str, comments: tuple[str, ...] = (), compression: str = "none") -> None:
    _write(rows, GAF, path, "\n".join(["!gaf-version: 2.0", *[f"!{c}" for c in comments]]), compression)


def write_gpad(rows: DataFrame, path: str, compression: str = "none") -> None:
    _write(rows, GPAD, path, "!gpa-version: 1.1", compression)


def write_gpi(rows: DataFrame, path: str, namespace: str | None = None, compression: str = "none") -> None:
    """Entities of all databases, or with namespace the older form for the entities of one."""
    if namespace is None:
        _write(rows, GPI, path, "!gpi-version: 1.2", compression)
    else:
        _write(rows.where(F.col("db") == namespace), GPI[1:], path, f"!gpi-version: 1.1\n!namespace: {namespace}", compression)


def to_associations(rows: DataFrame, eco: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Associations and entities of read_gaf() rows; eco is (evidence, eco), evidence without one keeps its code."""
    ok = rows.where("status <> 'short'")
    other = F.coalesce(P.taxon_pair(F.col("taxon"))["interacting"], F.lit(""))
    told = F.concat_ws("|", F.when(P.qualifier_flags(F.col("qualifier")).bitwiseAND(1) > 0, "NOT"), P.relation(F.col("aspect"), F.col("qualifier")))
    gpad = ok.join(eco.select("evidence", "eco").dropDuplicates(["evidence"]), "evidence", "left").select("db", "object_id", told.alias("qualifier"), "cls", "reference", F.coalesce("eco", "evidence").alias("eco"), "with_from", other.alias("interacting_taxon"), "date", "assigned_by", F.coalesce("extension", F.lit("")).alias("extension"), F.lit("").alias("properties"))
    own = F.coalesce(P.taxon_pair(F.col("taxon"))["taxon"], F.lit(""))
    cells = F.struct("symbol", "name", "synonym", "type", own.alias("taxon"))
    gpi = ok.groupBy("db", "object_id").agg(F.min(cells).alias("e")).select("db", "object_id", "e.*", *[F.lit("").alias(c) for c in ("parent_id", "xref", "properties")])
    return gpad, gpi
