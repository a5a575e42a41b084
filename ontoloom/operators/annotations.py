"""Checks, predictions and comparisons over annotation tables.

Annotations have annotation_id, bioentity, cls, evidence, with_from (array),
refs (array), flags, date, assigned_by, taxon as far as a check needs them.
Class and evidence families are parameters: sets of ids, given as tables where
they may grow.  Every check returns (annotation_id, rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.plans.session import settle

NOT, CONTRIBUTES, COLOCALIZES = 1, 2, 4


def _as(rows: DataFrame, rule: str) -> DataFrame:
    return rows.select("annotation_id", F.lit(rule).alias("rule"))


def row_rules(ann: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a broken rule; rules are conditions on one annotation, tested in one pass.  A null condition is no violation."""
    broken = F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda x: x.isNotNull())
    return ann.select("annotation_id", F.explode(broken).alias("rule"))


def standard_rules(today: str, binding: str | None = None, protein_binding: str | None = None, roots: tuple[str, ...] = ()) -> dict[str, Column]:
    """Rules on one row: evidence against the with column, no-data annotations, dates, white space, required columns."""
    e, n = F.col("evidence"), F.size(F.coalesce("with_from", F.array().cast("array<string>")))
    out = {
        "ic_needs_with": (e == "IC") & (n == 0),
        "ida_forbids_with": (e == "IDA") & (n > 0),
        "ipi_needs_with": (e == "IPI") & (n == 0),
        "iea_older_than_a_year": (e == "IEA") & (F.col("date") < F.add_months(F.lit(today).cast("date"), -12)),
        "missing_date": F.col("date").isNull(),
        "missing_assigned_by": F.coalesce(F.trim("assigned_by"), F.lit("")) == "",
        "outer_white_space": F.col("bioentity") != F.trim("bioentity"),
    }
    if binding:
        out["binding_needs_with"] = F.col("cls").isin(binding, protein_binding) & (~e.isin("IPI", "IEA") | (n == 0))
    if protein_binding:
        out["no_iss_to_protein_binding"] = (F.col("cls") == protein_binding) & e.isin("ISS", "ISO", "ISA", "ISM")
    if roots:
        out["nd_to_roots_only"] = (e == "ND") != F.col("cls").isin(*roots)
    return out


def pattern_rules(lines: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Rules given as regular expressions over a row's text."""
    return row_rules(lines, {name: F.col(text).rlike(p) for name, p in patterns.items()})


def evidence_only_under(ann: DataFrame, closed: DataFrame, evidence: str, top: str, rule: str) -> DataFrame:
    """Annotations with the evidence whose class is no strict descendant of top."""
    below = closed.where((F.col("target") == top) & (F.col("source") != top)).select(F.col("source").alias("cls"))
    return _as(ann.where(F.col("evidence") == evidence).join(below, "cls", "left_anti"), rule)


def evidence_never_under(ann: DataFrame, closed: DataFrame, evidence: str, top: str, rule: str) -> DataFrame:
    below = closed.where((F.col("target") == top) & (F.col("source") != top)).select(F.col("source").alias("cls"))
    return _as(ann.where(F.col("evidence") == evidence).join(below, "cls", "left_semi"), rule)


def in_subset(ann: DataFrame, subset: DataFrame, rule: str) -> DataFrame:
    """Annotations to classes of a subset (node) that isn't for annotation."""
    return _as(ann.join(subset.select(F.col("node").alias("cls")).distinct(), "cls", "left_semi"), rule)


def reciprocal(ann: DataFrame, cls: str, rule: str = "not_reciprocal") -> DataFrame:
    """Annotations of bioentity to cls with a partner in with_from, where the partner lacks the same annotation the other way."""
    own = ann.where(F.col("cls") == cls).select("annotation_id", "bioentity", F.explode("with_from").alias("partner"))
    back = own.select(F.col("partner").alias("bioentity"), F.col("bioentity").alias("partner")).distinct()
    return _as(own.join(back, ["bioentity", "partner"], "left_anti").select("annotation_id").distinct(), rule)


def class_references(ann: DataFrame, known: DataFrame) -> DataFrame:
    """unknown_class, obsolete_class and alternative_id against known (id, is_obsolete) with alternative ids in alt_ids."""
    alt = known.select(F.explode("alt_ids").alias("cls")).distinct().withColumn("_alt", F.lit(True))
    joined = ann.join(known.select(F.col("id").alias("cls"), "is_obsolete").dropDuplicates(["cls"]), "cls", "left").join(alt, "cls", "left")
    rule = F.when(F.col("is_obsolete"), "obsolete_class").when(F.col("is_obsolete").isNull() & F.col("_alt"), "alternative_id").when(F.col("is_obsolete").isNull(), "unknown_class")
    return joined.select("annotation_id", rule.alias("rule")).where("rule is not null")


def applicable(classes: DataFrame, up: DataFrame, only_in: DataFrame, never_in: DataFrame, taxa: DataFrame) -> DataFrame:
    """(cls, taxon, applicable) for pairs classes (cls, taxon).

    A class inherits only_in (cls, taxon) and never_in (cls, taxon) from all its
    ancestors in up; taxa is the reflexive taxon closure.  It applies if every
    only_in taxon and no never_in taxon stands above the taxon or is it.
    """
    pairs = classes.select("cls", "taxon").distinct()
    lifted = pairs.join(up.select(F.col("source").alias("cls"), F.col("target").alias("_c")), "cls")
    above = taxa.select(F.col("source").alias("taxon"), F.col("target").alias("_t")).distinct()
    rules = only_in.select(F.col("cls").alias("_c"), F.col("taxon").alias("_t"), F.lit(True).alias("_only")).union(never_in.select("cls", "taxon", F.lit(False))).distinct()
    checked = lifted.join(rules, "_c").join(above.withColumn("_is", F.lit(True)), ["taxon", "_t"], "left")
    bad = checked.where(F.col("_only") != F.coalesce("_is", F.lit(False))).select("cls", "taxon").distinct().withColumn("_bad", F.lit(True))
    return pairs.join(bad, ["cls", "taxon"], "left").select("cls", "taxon", F.col("_bad").isNull().alias("applicable"))


def taxon_violations(ann: DataFrame, verdicts: DataFrame, rule: str = "taxon") -> DataFrame:
    return _as(ann.join(verdicts.where("not applicable"), ["cls", "taxon"], "left_semi"), rule)


def propagate(ann: DataFrame, links: DataFrame, up: DataFrame) -> DataFrame:
    """(bioentity, cls, evidence): predictions over links (source, target) from one aspect to another.

    Annotations that are negated, qualified or without data predict nothing.
    Predictions that an annotation or a more specific prediction of the same
    evidence implies are dropped.
    """
    usable = ann.where((F.coalesce("flags", F.lit(0)) == 0) & (F.col("evidence") != "ND")).select("bioentity", F.col("cls").alias("source"), "evidence")
    new = usable.join(links.select("source", "target"), "source").select("bioentity", F.col("target").alias("cls"), "evidence").distinct()
    # Only what a link ends in can be predicted, so only such classes are looked for above.
    ends = settle(links.select(F.col("target").alias("_up")).distinct(), "ends")
    lift = settle(up.select(F.col("source").alias("cls"), F.col("target").alias("_up")).join(ends, "_up", "left_semi").select("cls", "_up"), "lift")
    have = ann.select("bioentity", "cls").distinct().join(lift, "cls").select("bioentity", F.col("_up").alias("cls")).distinct()
    new = new.join(have, ["bioentity", "cls"], "left_anti")
    above = new.join(lift.where("cls <> _up"), "cls").select("bioentity", F.col("_up").alias("cls"), "evidence").distinct()
    return new.join(above, ["bioentity", "cls", "evidence"], "left_anti")


def compare(left: DataFrame, right: DataFrame, closed: DataFrame) -> DataFrame:
    """bioentity, cls, outcome of left's annotations against right's: exact, more_specific, less_specific or not_found (the first that holds)."""
    left, right = left.select("bioentity", "cls").distinct(), right.select("bioentity", F.col("cls").alias("other")).distinct()
    strict = closed.where("source <> target")
    down = strict.select(F.col("source").alias("cls"), F.col("target").alias("other"), F.lit(2).alias("_p"))
    over = strict.select(F.col("target").alias("cls"), F.col("source").alias("other"), F.lit(3).alias("_p"))
    near = down.union(over).groupBy("cls", "other").agg(F.min("_p").alias("_p"))
    exact = left.join(right.withColumnRenamed("other", "cls"), ["bioentity", "cls"], "left_semi").withColumn("_p", F.lit(1))
    other = left.join(near, "cls").join(right, ["bioentity", "other"], "left_semi").select("bioentity", "cls", "_p")
    best = exact.union(other).groupBy("bioentity", "cls").agg(F.min("_p").alias("_p"))
    names = F.when(F.col("_p") == 1, "exact").when(F.col("_p") == 2, "more_specific").when(F.col("_p") == 3, "less_specific").otherwise("not_found")
    return left.join(best, ["bioentity", "cls"], "left").select("bioentity", "cls", names.alias("outcome"))


def to_slim(ann: DataFrame, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations with cls replaced by its most specific slim classes, and those without one; slim is a subset map (term, slim)."""
    mapped = ann.join(slim.withColumnRenamed("term", "cls"), "cls")
    return mapped.drop("cls").withColumnRenamed("slim", "cls"), ann.join(slim.select(F.col("term").alias("cls")).distinct(), "cls", "left_anti")


def fold_extensions(ann: DataFrame) -> DataFrame:
    """annotation_id and folded_id: a class and its extension become one class, keyed by a hash of the sorted expression."""
    text = F.array_join(F.array_sort(F.transform(F.flatten("ext"), lambda s: F.concat_ws(" ", s["relation"], s["cls"]))), " and ")
    return ann.where("size(ext) > 0").select("annotation_id", F.concat(F.lit("X:"), F.substring(F.sha2(F.concat_ws(" and ", "cls", text), 256), 1, 16)).alias("folded_id"))


def redundancy(ann: DataFrame, closed: DataFrame) -> DataFrame:
    """(bioentity, cls) without classes above another class of the bioentity."""
    return C.non_redundant(ann, closed, "bioentity", "cls")


def documents(nodes: DataFrame, up: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, closure_ids, closure_labels: a node with its reflexive closure as sorted, comma-joined lists."""
    named = labels.select("node", "label").dropDuplicates(["node"])
    lifted = up.join(named.select(F.col("node").alias("target"), F.col("label").alias("_l")), "target", "left")
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    closed = lifted.groupBy(F.col("source").alias("node")).agg(text("target").alias("closure_ids"), text("_l").alias("closure_labels"))
    return nodes.select("node").distinct().join(named, "node", "left").join(closed, "node", "left").select(F.col("node").alias("id"), "label", "closure_ids", "closure_labels")


def name_checks(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, problem): missing_label, duplicate_label, duplicate_synonym, label_is_synonym; names (id, label), synonyms (id, label, scope)."""
    missing = names.where("label is null or trim(label) = ''").select("id", F.lit("missing_label").alias("problem"))
    again = names.join(names.groupBy("label").count().where("count > 1"), "label", "left_semi").select("id", F.lit("duplicate_label"))
    exact = synonyms.where("scope = 'EXACT'").select("id", "label").distinct()
    twice = synonyms.groupBy("id", "label").count().where("count > 1").select("id", F.lit("duplicate_synonym")).distinct()
    other = exact.select(F.col("id").alias("_o"), "label").join(names, "label").where("_o <> id").select("id", F.lit("label_is_synonym")).distinct()
    return missing.union(again).union(twice).union(other)


def report(found: list[DataFrame], severities: dict[str, str], default: str = "error") -> DataFrame:
    """rule, severity, n: all checks' violations (annotation_id, rule) counted together."""
    rows = found[0].select("rule")
    for more in found[1:]:
        rows = rows.union(more.select("rule"))
    severity = F.lit(default)
    for rule, word in severities.items():
        severity = F.when(F.col("rule") == rule, word).otherwise(severity)
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select("rule", severity.alias("severity"), "n")


def without_known(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Violations without those that accepted (annotation_id, rule) lets stand."""
    return found.join(accepted.select("annotation_id", "rule").distinct(), ["annotation_id", "rule"], "left_anti")


def two_taxa(ann: DataFrame, up: DataFrame, top: str, rule: str = "two_taxa") -> DataFrame:
    """Annotations with an interacting taxon whose class isn't top (such as multi-organism process) or under it."""
    below = up.where(F.col("target") == top).select(F.col("source").alias("cls")).distinct()
    return _as(ann.where("interacting_taxon is not null").join(below, "cls", "left_anti"), rule)


def taxon_matrix(classes: DataFrame, taxa: DataFrame, up: DataFrame, only_in: DataFrame, never_in: DataFrame, closed: DataFrame) -> DataFrame:
    """cls, taxa: for each class (cls) the taxa (taxon) in which it applies, sorted and joined by commas.

    A class that no constraint reaches applies in every taxon and needs no test
    of its pairs; the others are tested.
    """
    wanted = classes.select("cls").distinct()
    held = up.join(only_in.select(F.col("cls").alias("target")).union(never_in.select("cls")).distinct(), "target", "left_semi").select(F.col("source").alias("cls")).distinct()
    everywhere = taxa.select("taxon").distinct().agg(F.array_sort(F.collect_set("taxon")).alias("_all"))  # one row
    free = wanted.join(held, "cls", "left_anti").join(F.broadcast(everywhere)).select("cls", F.col("_all").alias("taxa"))
    pairs = wanted.join(held, "cls", "left_semi").join(F.broadcast(everywhere)).select("cls", F.explode("_all").alias("taxon"))
    tested = applicable(pairs, up, only_in, never_in, closed).where("applicable").groupBy("cls").agg(F.array_sort(F.collect_set("taxon")).alias("taxa"))
    return free.union(tested).select("cls", F.array_join("taxa", ",").alias("taxa"))


def flagged(predicted: DataFrame, ann: DataFrame, up: DataFrame) -> DataFrame:
    """bioentity, cls, by_annotation, by_prediction: whether an annotation, or another, more specific prediction, implies the predicted class."""
    lift = up.select(F.col("source").alias("cls"), F.col("target").alias("_up"))
    over = lambda df, strict: df.select("bioentity", "cls").distinct().join(lift.where("cls <> _up") if strict else lift, "cls").select("bioentity", F.col("_up").alias("cls")).distinct()
    out = predicted.select("bioentity", "cls").distinct()
    for name, rows in (("by_annotation", over(ann, False)), ("by_prediction", over(predicted, True))):
        out = out.join(rows.withColumn(name, F.lit(True)), ["bioentity", "cls"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def unfold(ann: DataFrame, definitions: DataFrame) -> DataFrame:
    """ann with a defined cls replaced by its genus, and extension: its other parts as relation(class), sorted and joined by commas; definitions is (cls, property, filler)."""
    genus = definitions.where("property is null").groupBy("cls").agg(F.min("filler").alias("_genus"))
    rest = definitions.where("property is not null").groupBy("cls").agg(F.array_join(F.array_sort(F.collect_set(F.concat("property", F.lit("("), "filler", F.lit(")")))), ",").alias("extension"))
    out = ann.join(genus, "cls", "left").join(rest, "cls", "left")
    return out.select(*[F.coalesce("_genus", "cls").alias("cls") if c == "cls" else F.col(c) for c in ann.columns], F.when(F.col("_genus").isNotNull(), F.col("extension")).alias("extension"))


def folded(ann: DataFrame, definitions: DataFrame, first: Column | None = None) -> DataFrame:
    """(annotation_id, cls): known classes whose definition is exactly an annotation's class with one group of its extension.

    With first, an expression of cls, one class stands for all with the same
    definition: the one whose value is smallest.
    """
    part = lambda p, f: F.concat_ws("|", p, f)
    key = definitions.groupBy("cls").agg(F.array_join(F.array_sort(F.collect_set(part(F.coalesce("property", F.lit("")), F.col("filler")))), ";").alias("_key"))
    if first is not None:
        key = key.groupBy("_key").agg(F.min_by("cls", F.struct(first, "cls")).alias("cls"))
    groups = ann.where("size(ext) > 0").select("annotation_id", "cls", F.explode("ext").alias("_g"))
    own = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array(F.concat(F.lit("|"), "cls")), F.transform("_g", lambda s: part(s["relation"], s["cls"]))))), ";")
    return groups.select("annotation_id", own.alias("_key")).join(key, "_key").select("annotation_id", "cls").distinct()


def to_eco(ann: DataFrame, table: DataFrame) -> DataFrame:
    """ann with eco: the class of its evidence code and one of its refs in table (evidence, ref, eco), or of the code alone (ref null)."""
    plain = table.where("ref is null").groupBy("evidence").agg(F.min("eco").alias("_plain"))
    special = table.where("ref is not null").groupBy("evidence").agg(F.map_from_entries(F.collect_list(F.struct("ref", "eco"))).alias("_by_ref"))
    out = ann.join(F.broadcast(plain), "evidence", "left").join(F.broadcast(special), "evidence", "left")  # a row an evidence code
    by_ref = F.array_min(F.transform("refs", lambda r: F.try_element_at("_by_ref", r)))
    return out.withColumn("eco", F.coalesce(F.when(F.col("_by_ref").isNotNull(), by_ref), F.col("_plain"))).drop("_plain", "_by_ref")


def database_tables(ann: DataFrame) -> dict[str, DataFrame]:
    """term, gene_product, evidence and association tables with surrogate ids, which are hashes of the names, so that tables can be made apart."""
    key = lambda c: F.xxhash64(c)
    named = lambda c: ann.select(F.col(c).alias("acc")).where("acc is not null").distinct().select(key("acc").alias("id"), "acc")
    link = ann.select(F.col("annotation_id").alias("id"), key("cls").alias("term_id"), key("bioentity").alias("gene_product_id"), key("evidence").alias("evidence_id"), "date", "assigned_by")
    return {"term": named("cls"), "gene_product": named("bioentity"), "evidence": named("evidence"), "association": link}
