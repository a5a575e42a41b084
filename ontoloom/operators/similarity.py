"""Information content, semantic similarity, enrichment and co-annotation.

`marks` is (element, attribute): direct annotations; `up` a reflexive closure
(source, target).  An element has every ancestor of its attributes.  Counts are
of distinct elements; an attribute that no element has is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.session import settle


def _lifted(marks: DataFrame, over: DataFrame) -> DataFrame:
    """(element, _all): for each element the values of over (source, ...) of its attributes, one struct an attribute; dealt by element, so that grouping by it moves nothing again."""
    direct = marks.select("element", F.col("attribute").alias("source")).where("element is not null and source is not null")
    return direct.join(over, "source").repartition("element").groupBy("element").agg(F.collect_list(F.struct("source", *[c for c in over.columns if c != "source"])).alias("_all"))


def inferred(marks: DataFrame, up: DataFrame) -> DataFrame:
    """(element, attribute) with all ancestors, each once."""
    over = up.groupBy("source").agg(F.collect_set("target").alias("_over"))
    return _lifted(marks, over).select("element", F.explode(F.array_distinct(F.flatten("_all._over"))).alias("attribute"))


def _ics(names, all_names, all_ics) -> Column:
    return F.transform(names, lambda x: F.element_at(all_ics, F.array_position(all_names, x).cast("int")))


def weighed_sets(marks: DataFrame, up: DataFrame, ic: DataFrame) -> DataFrame:
    """(element, names, ics, direct): each element's attributes with all ancestors, their content, and for each direct attribute the places (from 1) of its ancestors among the names."""
    over = up.select("source", F.col("target").alias("attribute")).distinct().join(ic.select("attribute", "ic"), "attribute")
    over = over.groupBy("source").agg(F.collect_list("attribute").alias("_n"), F.collect_list("ic").alias("_ic"))
    rows = _lifted(marks, over).select("element", "_all", F.flatten("_all._n").alias("_an"), F.flatten("_all._ic").alias("_aic")).withColumn("names", F.array_distinct("_an"))
    own = F.transform(F.array_distinct("_all"), lambda x: F.transform(x["_n"], lambda y: F.array_position("names", y).cast("int")))
    return rows.select("element", "names", _ics("names", F.col("_an"), F.col("_aic")).alias("ics"), own.alias("direct"))


def weighed(full: DataFrame, ic: DataFrame) -> DataFrame:
    """(element, names, ics) of sets that are given as rows."""
    return full.join(ic.select("attribute", "ic"), "attribute").groupBy("element").agg(F.collect_list("attribute").alias("names"), F.collect_list("ic").alias("ics"))


def total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def side_by_side(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) whose elements both have a set, with its columns as <column>_a and <column>_b; one row a pair all the way."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("element").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs


def common_ics() -> Column:
    """The content of the common attributes of a row of side_by_side()."""
    return _ics(F.array_intersect("names_a", "names_b"), F.col("names_a"), F.col("ics_a"))


def frequencies(full: DataFrame) -> DataFrame:
    return full.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_elements"))


def information_content(full: DataFrame) -> DataFrame:
    """attribute, n_elements, ic = -log2(n_elements / corpus size)."""
    size = full.agg(F.count_distinct("element").alias("corpus"))  # one row
    return frequencies(full).join(F.broadcast(size)).select("attribute", "n_elements", (-F.log2(F.col("n_elements") / F.col("corpus"))).alias("ic"))


def entropy(full: DataFrame) -> DataFrame:
    ic = information_content(full)
    return ic.agg(F.sum(F.pow(F.lit(2.0), -F.col("ic")) * F.col("ic")).alias("entropy"))


def pair_scores(pairs: DataFrame, full: DataFrame, ic: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Per pair (a, b) of elements: n_common, n_a, n_b, simj, asym, simgic, max_ic.

    Sums over the union are those of both sides less those of the intersection.
    sets: weighed_sets() of the same, where marks are at hand; so elsewhere.
    """
    return _scored(side_by_side(pairs, weighed(full, ic) if sets is None else sets, "names", "ics"))


def _scored(both: DataFrame, *more: str) -> DataFrame:
    rows = both.select("a", "b", *more, common_ics().alias("_c"), F.size("names_a").cast("long").alias("n_a"), F.size("names_b").cast("long").alias("n_b"), total("ics_a").alias("_a"), total("ics_b").alias("_b"))
    rows = rows.select("*", F.size("_c").cast("long").alias("n_common"), total("_c").alias("_w"))
    n, w = F.col("n_common"), F.col("_w")
    union = F.col("_a") + F.col("_b") - w
    return rows.select(
        "a", "b", *more, "n_common", "n_a", "n_b",
        (n / (F.col("n_a") + F.col("n_b") - n)).alias("simj"),
        (n / F.col("n_b")).alias("asym"),
        F.when(union > 0, w / union).otherwise(0.0).alias("simgic"),
        F.coalesce(F.array_max("_c"), F.lit(0.0)).alias("max_ic"),
    )


def _best(x: str, y: str) -> Column:
    """The best content of a common subsumer for each direct attribute of x; 0 where there is none.

    What is held is bound by a lambda, so that it is made once a row, not once a place.
    """
    held = F.transform(F.arrays_zip(f"names_{x}", f"ics_{x}"), lambda z: F.when(F.array_contains(F.col(f"names_{y}"), z[f"names_{x}"]), z[f"ics_{x}"]).otherwise(0.0))
    return F.transform(F.array(held), lambda h: F.transform(f"direct_{x}", lambda d: F.array_max(F.transform(d, lambda i: F.element_at(h, i)))))[0]


def _matched(both: DataFrame, *more: str) -> DataFrame:
    n = [F.size(f"direct_{x}") for x in "ab"]
    rows = both.where(F.arrays_overlap("names_a", "names_b")).select("a", "b", *more, total(_best("a", "b")).alias("_a"), total(_best("b", "a")).alias("_b"), n[0].alias("_na"), n[1].alias("_nb"))
    return rows.select("a", "b", *more, (F.col("_a") / F.col("_na")).alias("bma_a"), (F.col("_b") / F.col("_nb")).alias("bma_b"), ((F.col("_a") + F.col("_b")) / (F.col("_na") + F.col("_nb"))).alias("bma"))


def best_match_average(pairs: DataFrame, marks: DataFrame, up: DataFrame, ic: DataFrame) -> DataFrame:
    """Per pair (a, b): mean of each direct attribute's best common-subsumer IC, both ways and symmetric."""
    return _matched(side_by_side(pairs, weighed_sets(marks, up, ic), "names", "ics", "direct"))


def co_annotation(full: DataFrame, within: DataFrame) -> DataFrame:
    """(a, b, n_both) for attributes a < b of `within` (attribute): elements that have both; p_b_given_a."""
    few = full.join(within, "attribute", "left_semi")
    n = frequencies(few)
    both = few.withColumnRenamed("attribute", "a").join(few.withColumnRenamed("attribute", "b"), "element").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    return both.join(n.select(F.col("attribute").alias("a"), F.col("n_elements").alias("n_a")), "a").select("a", "b", "n_both", (F.col("n_both") / F.col("n_a")).alias("p_b_given_a"))


def enrichment(full: DataFrame, sample: DataFrame) -> DataFrame:
    """Hypergeometric P(X >= k) of each attribute in the sample (element), Bonferroni-corrected over the attributes tested."""
    from ontoloom.operators.comparisons import hypergeometric_tail

    size = full.agg(F.count_distinct("element").alias("m"))
    drawn = full.join(sample.distinct(), "element", "left_semi")
    n_drawn = drawn.agg(F.count_distinct("element").alias("n"))
    k = frequencies(drawn).withColumnRenamed("n_elements", "k")
    rows = settle(frequencies(full).withColumnRenamed("n_elements", "c").where("c > 1").join(k, "attribute").join(F.broadcast(size)).join(F.broadcast(n_drawn)), "tested")
    found = rows.withColumn("p", hypergeometric_tail(full.sparkSession)("k", "c", "n", "m"))
    return found.select("attribute", "k", "c", "p", F.least(F.col("p") * F.lit(rows.count()), F.lit(1.0)).alias("p_corrected"))


def element_statistics(full: DataFrame, ic: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Per element: n, mean, min, max and sum of its attributes' IC."""
    x = (weighed(full, ic) if sets is None else sets).select("element", F.size("ics").cast("long").alias("n"), F.array_min("ics").alias("min_ic"), F.array_max("ics").alias("max_ic"), total("ics").alias("sum_ic"))
    return x.select("element", "n", (F.col("sum_ic") / F.col("n")).alias("mean_ic"), "min_ic", "max_ic", "sum_ic")


def sufficiency(statistics: DataFrame) -> DataFrame:
    """Per element the mean of its IC figures against the corpus averages and maximum, each at most 1."""
    over = statistics.agg(F.avg("mean_ic").alias("_mean"), F.max("max_ic").alias("_max"), F.avg("sum_ic").alias("_sum"))
    part = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(0.0)
    return statistics.join(F.broadcast(over)).select("element", ((part("mean_ic", "_mean") + part("max_ic", "_max") + part("sum_ic", "_sum")) / 3).alias("sufficiency"))


def search(query: DataFrame, targets: DataFrame, marks: DataFrame, up: DataFrame, min_simj_percent: int = 0, min_max_ic: float = 0.0) -> DataFrame:
    """Ranked matches of each element of query among targets (both: element): a, b, simj, max_ic, bma, combined, rank (from 0).

    Cut-offs: Jaccard in whole per cent, at least; best common IC, above.
    combined is the mean, in whole numbers, of max_ic and bma as whole per cent
    of the query's best value, its match with itself included.  Ties go by id.
    """
    from pyspark.sql import Window

    ic = settle(information_content(inferred(marks, up)), "content")
    sets = settle(weighed_sets(marks, up, ic), "sets")
    queries = query.select("element").distinct()
    asked = sets.join(queries, "element", "left_semi")
    of = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns]).withColumnRenamed(f"element_{x}", x)
    wanted = sets.join(targets.select("element").distinct().withColumn("_target", F.lit(True)), "element", "left")
    both = of(wanted, "b").crossJoin(F.broadcast(of(asked, "a"))).where(F.col("_target_b") | (F.col("a") == F.col("b")))
    cells = ["names_a", "names_b", "ics_a", "ics_b", "direct_a", "direct_b"]
    scored = _scored(both, *cells).where((F.floor(100 * F.col("simj") + 1e-9) >= min_simj_percent) & (F.col("max_ic") > min_max_ic))
    out = settle(_matched(scored, "simj", "max_ic").drop("bma_a", "bma_b"), "matches")
    tops = out.groupBy("a").agg(F.max("max_ic").alias("_ic"), F.max("bma").alias("_bma"))
    percent = lambda x, y: F.when(F.col(y) > 0, F.floor(100 * F.col(x) / F.col(y) + 1e-9)).otherwise(0)
    out = out.join(tops, "a").withColumn("combined", F.floor((percent("max_ic", "_ic") + percent("bma", "_bma")) / 2).cast("long"))
    rank = (F.row_number().over(Window.partitionBy("a").orderBy(F.desc("combined"), "b")) - 1).cast("long")
    return out.where("a <> b").withColumn("rank", rank).select("a", "b", "simj", "max_ic", "bma", "combined", "rank")


def lin(pairs: DataFrame, up: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, lcs, lcs_ic, lin) for pairs of classes: the common subsumer of highest IC (ties: smallest id) and 2 IC(lcs) / (IC(a) + IC(b))."""
    from ontoloom.operators.closure import common_subsumers

    own = ic.select("attribute", "ic")
    common = common_subsumers(pairs, up).join(own.withColumnRenamed("attribute", "subsumer"), "subsumer")
    best = common.groupBy("a", "b").agg(F.min(F.struct((-F.col("ic")).alias("m"), "subsumer")).alias("x")).select("a", "b", F.col("x.subsumer").alias("lcs"), (-F.col("x.m")).alias("lcs_ic"))
    for x in "ab":
        best = best.join(own.toDF(x, f"ic_{x}"), x)
    total = F.col("ic_a") + F.col("ic_b")
    return best.select("a", "b", "lcs", "lcs_ic", F.when(total > 0, 2 * F.col("lcs_ic") / total).otherwise(0.0).alias("lin"))


def conditional_probability(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, n_both, p) for pairs of classes: elements of both, and their share of b's elements."""
    side = lambda x: full.withColumnRenamed("attribute", x).join(pairs.select(x).distinct(), x, "left_semi")
    both = side("a").join(side("b"), "element").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    out = pairs.join(frequencies(full).withColumnRenamed("attribute", "b"), "b").join(both, ["a", "b"], "left")
    n = F.coalesce("n_both", F.lit(0))
    return out.select("a", "b", n.alias("n_both"), (n / F.col("n_elements")).alias("p"))


def co_annotation_weights(full: DataFrame, within: DataFrame) -> DataFrame:
    """(a, b, n_both, weight): ln(n_both) * ln(N + n_b), N elements in all.

    The sum N + n_b, not N / (1 + n_b), gives the established results.
    """
    few = full.join(within, "attribute", "left_semi")
    size = few.agg(F.count_distinct("element").alias("_n"))
    both = few.withColumnRenamed("attribute", "a").join(few.withColumnRenamed("attribute", "b"), "element").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    n = frequencies(few).select(F.col("attribute").alias("b"), "n_elements")
    return both.join(n, "b").join(F.broadcast(size)).select("a", "b", "n_both", (F.log("n_both") * F.log(F.col("_n") + F.col("n_elements"))).alias("weight"))


def enrichment_filtered(results: DataFrame, closed: DataFrame) -> DataFrame:
    """Enrichment rows without those whose class stands above a class with a smaller p."""
    over = closed.where("source <> target").select(F.col("source").alias("_better"), F.col("target").alias("attribute"))
    better = results.select(F.col("attribute").alias("_better"), F.col("p").alias("_p"))
    worse = results.join(over, "attribute").join(better, "_better").where("_p < p").select("attribute").distinct()
    return results.join(worse, "attribute", "left_anti")


def metric_statistics(scores: DataFrame, *metrics: str) -> DataFrame:
    """metric, n, mean, low, high of score columns over all pairs."""
    long = scores.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
