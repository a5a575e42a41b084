"""Stanza ontologies and taxonomy dumps as tables.

Files are split into stanzas by Spark's line separator option, so a large file
is read in parallel and no window over its lines is needed.  Stanzas without an
id are left out.  A repeated single-valued tag keeps its smallest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags with one value.
SINGLE = ("name", "namespace", "def", "comment", "is_obsolete", "replaced_by")


def _clean(value: Column) -> Column:
    """Without a trailing ! comment or {modifiers}, which stand outside quotes."""
    bare = F.when(F.instr(value, '"') > 0, value).otherwise(F.regexp_replace(value, r"(^|\s+)!.*$", ""))
    return F.trim(F.regexp_replace(bare, r"\s*\{[^{}\"]*\}\s*$", ""))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, tag, value): one row a tag line of a stanza; kind is Term, Typedef or Instance."""
    raw = spark.read.option("lineSep", "\n[").text(path).where(r"value rlike '^\\[?[A-Za-z]+\\]'")
    kind = F.regexp_extract("value", r"^\[?([A-Za-z]+)\]", 1)
    id_ = F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1)
    lines = raw.select(kind.alias("kind"), id_.alias("id"), F.explode(F.split("value", r"\r?\n")).alias("line")).where("id <> ''")
    pair = lines.where(r"line rlike '^[A-Za-z_-]+:'")
    return pair.select("id", "kind", F.substring_index("line", ":", 1).alias("tag"), _clean(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def entities(tags: DataFrame) -> DataFrame:
    """id, kind, label, namespace, definition, comment, is_obsolete, replaced_by, and arrays alt_ids, subsets, xrefs."""
    one = [F.min(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in SINGLE]
    many = [F.array_sort(F.collect_set(F.when(F.col("tag") == t, F.element_at(F.split("value", r"\s+"), 1)))).alias(n) for t, n in (("alt_id", "alt_ids"), ("subset", "subsets"), ("xref", "xrefs"))]
    out = tags.groupBy("id", "kind").agg(*one, *many)
    return out.select("id", "kind", F.col("name").alias("label"), "namespace", F.regexp_extract("def", r'^"((?:[^"\\]|\\.)*)"', 1).alias("definition"), "comment", (F.coalesce("is_obsolete", F.lit("false")) == "true").alias("is_obsolete"), "replaced_by", "alt_ids", "subsets", "xrefs")


def synonyms(tags: DataFrame) -> DataFrame:
    """id, label, scope, category, xrefs of synonym: "text" SCOPE CATEGORY [xrefs]; the scope is RELATED where none is given."""
    s = tags.where("tag = 'synonym'")
    head = r'^"((?:[^"\\]|\\.)*)"\s*(EXACT|BROAD|NARROW|RELATED)?\s*([^\s\[\]]*)\s*(?:\[(.*)\])?'
    get = lambda i: F.regexp_extract("value", head, i)
    return s.select("id", get(1).alias("label"), F.when(get(2) == "", "RELATED").otherwise(get(2)).alias("scope"), F.nullif(get(3), F.lit("")).alias("category"), F.filter(F.split(get(4), r",\s*"), lambda x: x != "").alias("xrefs"))


def edges(tags: DataFrame) -> DataFrame:
    """source, target, property: is_a, relationship and the parts of intersection_of; a genus counts as is_a."""
    w = F.split("value", r"\s+")
    is_a = tags.where("tag = 'is_a'").select(F.col("id").alias("source"), w[0].alias("target"), F.lit("is_a").alias("property"))
    rel = tags.where("tag = 'relationship'").select(F.col("id").alias("source"), F.get(w, F.lit(1)).alias("target"), w[0].alias("property"))
    part = tags.where("tag = 'intersection_of'").select(F.col("id").alias("source"), F.coalesce(F.get(w, F.lit(1)), w[0]).alias("target"), F.when(F.size(w) > 1, w[0]).otherwise("is_a").alias("property"))
    return is_a.union(rel).union(part).where("target is not null").distinct()


def definitions(tags: DataFrame) -> DataFrame:
    """cls, property (null for the genus), filler: the parts of intersection definitions."""
    w = F.split("value", r"\s+")
    return tags.where("tag = 'intersection_of'").select(F.col("id").alias("cls"), F.when(F.size(w) > 1, w[0]).alias("property"), F.coalesce(F.get(w, F.lit(1)), w[0]).alias("filler")).distinct()


def properties(tags: DataFrame) -> DataFrame:
    """property, transitive, symmetric, sup (array), inverse of Typedef stanzas."""
    t = tags.where("kind = 'Typedef'")
    flag = lambda x: F.max((F.col("tag") == x) & (F.col("value") == "true"))
    return t.groupBy(F.col("id").alias("property")).agg(flag("is_transitive").alias("transitive"), flag("is_symmetric").alias("symmetric"), F.array_sort(F.collect_set(F.when(F.col("tag") == "is_a", F.col("value")))).alias("sup"), F.min(F.when(F.col("tag") == "inverse_of", F.col("value"))).alias("inverse"))


def chains(tags: DataFrame) -> DataFrame:
    """p, q, result: transitive_over p and holds_over_chain p q of a property."""
    over = tags.where("tag = 'transitive_over'").select(F.col("id").alias("p"), F.col("value").alias("q"), F.col("id").alias("result"))
    w = F.split("value", r"\s+")
    return over.union(tags.where("tag = 'holds_over_chain'").select(w[0], F.get(w, F.lit(1)), F.col("id"))).distinct()


def write(entity: DataFrame, edge: DataFrame, path: str) -> None:
    """Stanza text, one record a class, its edges in order of property and target."""
    rel = edge.select(F.col("source").alias("id"), F.when(F.col("property") == "is_a", F.concat(F.lit("is_a: "), "target")).otherwise(F.concat_ws(" ", F.lit("relationship:"), "property", "target")).alias("line"))
    rel = rel.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("lines"))
    out = entity.join(rel, "id", "left")
    name = F.when(F.col("label").isNotNull(), F.concat(F.lit("name: "), "label"))
    gone = F.when(F.col("is_obsolete"), "is_obsolete: true")
    out.select(F.concat(F.concat_ws("\n", F.concat(F.lit("["), "kind", F.lit("]")), F.concat(F.lit("id: "), "id"), name, "lines", gone), F.lit("\n")).alias("value")).write.text(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy dump: id, parent, rank (null for "no rank"), label, common_name, synonyms.

    Records end with //.  A label that several taxa share gets its id appended.
    """
    raw = spark.read.option("lineSep", "\n//").text(path)
    lines = raw.select(F.regexp_extract("value", r"(?m)^ID\s*:\s*(\S+)", 1).alias("id"), F.explode(F.split("value", r"\r?\n")).alias("l")).where("id <> '' and l like '%:%'")
    kv = lines.select("id", F.trim(F.substring_index("l", ":", 1)).alias("k"), F.trim(F.expr("substring(l, instr(l, ':') + 1)")).alias("v"))
    one = lambda k: F.min(F.when(F.col("k") == k, F.col("v")))
    out = kv.groupBy("id").agg(one("PARENT ID").alias("parent"), F.nullif(one("RANK"), F.lit("no rank")).alias("rank"), one("SCIENTIFIC NAME").alias("label"), one("GENBANK COMMON NAME").alias("common_name"), F.array_sort(F.collect_set(F.when(F.col("k") == "SYNONYM", F.col("v")))).alias("synonyms"))
    shared = out.groupBy("label").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    out = out.join(shared, "label", "left")
    return out.select("id", "parent", "rank", F.when(F.col("_shared"), F.concat("label", F.lit(" ["), "id", F.lit("]"))).otherwise(F.col("label")).alias("label"), "common_name", "synonyms")
