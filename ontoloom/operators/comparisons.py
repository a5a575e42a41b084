"""Set scores of classes, elements and profiles, exact similarity joins, statistics of information content, property views.

sets is (element, attribute): an element's or class's whole set (its ancestors
included), one row each; ic is (attribute, ic).  Pairs are (a, b).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.operators.similarity import common_ics, frequencies, side_by_side, total, weighed
from ontoloom.plans.session import settle, ship_package


def ancestors_as_sets(up: DataFrame) -> DataFrame:
    return up.select(F.col("source").alias("element"), F.col("target").alias("attribute")).distinct()


def set_scores(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, overlap, n_union, jaccard, of_a, of_b (shares of a's and b's set), of_both (of the sum), dice, of_smaller."""
    size = sets.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    shared = pairs.join(sets.withColumnRenamed("element", "a"), "a").join(sets.withColumnRenamed("element", "b"), ["b", "attribute"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_o"))
    out = pairs.join(shared, ["a", "b"], "left")
    for x in "ab":
        out = out.join(size.select(F.col("element").alias(x), F.col("n").alias(f"n_{x}")), x)
    o, a, b = F.coalesce("_o", F.lit(0)), F.col("n_a"), F.col("n_b")
    return out.select(
        "a", "b", "n_a", "n_b", o.alias("overlap"), (a + b - o).alias("n_union"), (o / (a + b - o)).alias("jaccard"), (o / a).alias("of_a"), (o / b).alias("of_b"),
        (o / (a + b)).alias("of_both"), (2 * o / (a + b)).alias("dice"), (o / F.least(a, b)).alias("of_smaller"),
    )


def alike(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(element, cls) and (cls, n, shared, n_members): elements whose sets differ only in attributes that no other element has are one class, named by its smallest element.

    n is the size of each member's set, shared its attributes that others have too, from rare to frequent.
    Elements that share nothing are left out.
    """
    sets = sets.select("element", "attribute").distinct()
    ranked = sets.join(frequencies(sets), "attribute").groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("n_elements") > 1, F.struct("n_elements", "attribute")))).alias("_k"))
    ranked = settle(ranked.where("size(_k) > 0").select("element", "n", F.col("_k.attribute").alias("shared")), "ranked")
    classes = settle(ranked.groupBy("shared", "n").agg(F.min("element").alias("cls"), F.count(F.lit(1)).alias("n_members")), "classes")
    members = settle(ranked.join(classes, ["shared", "n"]).select("element", "cls"), "members")
    return members, classes


#: Parts into which the classes of an attribute are dealt.
DEALT = 16
#: About so many members of a class stand in one row when pairs of classes go to their members.
BLOCK = 4096


def similar_pairs(sets: DataFrame, percent: int, digits: int | None = None) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs whose Jaccard similarity in per cent is at least percent; exact, without comparing all pairs.

    Elements that are alike are compared once, as a class; pairs of classes are
    dealt out to their members at the end, which stand in rows of many, so that
    what is moved for them is far less than the pairs.  Scores are rounded to
    digits, if given, once a pair of classes.  Attributes are ordered from rare to
    frequent, those of one element first.  Two sets as alike as that share one of
    the first n - ceil(share * n) + 1 attributes of each, so only those are
    joined; a pair is taken where the first attribute that it shares is met.
    """
    members, classes = alike(sets)
    prefix = classes.select("cls", "n", "shared", F.posexplode("shared").alias("_i", "attribute")).where(F.col("_i") <= F.size("shared") - F.ceil(F.col("n") * percent / 100))
    prefix = settle(prefix.drop("_i"), "prefix")
    # Classes of one attribute are dealt out, as some attributes have very many.
    left = prefix.toDF("_a", "n_a", "_sa", "attribute").withColumn("_p", F.pmod(F.xxhash64("_a"), F.lit(DEALT)).cast("int")).repartition(4 * DEALT, "attribute", "_p")
    right = prefix.toDF("_b", "n_b", "_sb", "attribute").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    sized = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    both = F.array_intersect("_sa", "_sb")
    score = lambda o, n: (o / (n - o) if digits is None else F.round(o / (n - o), digits) + 0.0).alias("jaccard")
    enough = lambda o, n: 100 * o >= percent * (n - o)
    o, n = F.size(both), F.col("n_a") + F.col("n_b")
    linked = left.join(right, ["attribute", "_p"]).where((F.col("_a") < F.col("_b")) & sized & (F.get(both, F.lit(0)) == F.col("attribute")) & enough(o, n))
    linked = settle(linked.select("_a", "_b", score(o, n)), "linked")
    own, twice = F.size("shared"), 2 * F.col("n")
    inside = classes.where((F.col("n_members") > 1) & enough(own, twice)).select(F.col("cls").alias("_a"), F.col("cls").alias("_b"), score(own, twice))
    held = members.join(classes.select("cls", F.ceil(F.col("n_members") / BLOCK).alias("_k")), "cls")
    blocks = settle(held.groupBy("cls", F.pmod(F.xxhash64("element"), "_k").alias("_k")).agg(F.collect_list("element").alias("_m")), "blocks")
    of = lambda c, m: blocks.select(F.col("cls").alias(c), F.col("_m").alias(m))

    def dealt(pairs: DataFrame) -> DataFrame:
        rows = pairs.repartition(4 * DEALT, "_a", "_b").join(of("_a", "_x"), "_a").join(of("_b", "_y"), "_b")
        return rows.select("jaccard", "_y", F.explode("_x").alias("x")).select("jaccard", "x", F.explode("_y").alias("y"))

    other = dealt(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    same = dealt(inside).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard")
    return other.union(same)


def profile_marks(profiles: DataFrame, up: DataFrame) -> DataFrame:
    """(element, attribute) of ad-hoc profiles (profile, attribute), with all ancestors."""
    direct = profiles.select(F.col("profile").alias("element"), F.col("attribute").alias("source")).distinct()
    return direct.join(up.select("source", F.col("target").alias("attribute")), "source").select("element", "attribute").distinct()


def asymmetric_content(pairs: DataFrame, sets: DataFrame, ic: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(a, b, score): content of the common attributes over that of b's; 0 where b has none.

    held: the sets as weighed_sets() gives them, where marks are at hand; so below.
    """
    held = weighed(sets, ic) if held is None else held
    rows = pairs.join(held.select(F.col("element").alias("b"), F.col("names").alias("names_b"), total("ics").alias("_t")), "b")
    rows = rows.join(held.select(F.col("element").alias("a"), F.col("names").alias("names_a"), F.col("ics").alias("ics_a")), "a", "left")
    return rows.select("a", "b", F.when(F.col("_t") > 0, F.coalesce(total(common_ics()), F.lit(0.0)) / F.col("_t")).otherwise(0.0).alias("score"))


def best_subsumers(pairs: DataFrame, sets: DataFrame, ic: DataFrame, least: float | None = None, tie: float = 1e-6, held: DataFrame | None = None) -> DataFrame:
    """(a, b, ic, subsumers): the largest content of a common attribute and all attributes that reach it within tie, sorted and joined by commas.

    With least, pairs below it go.
    """
    both = side_by_side(pairs, weighed(sets, ic) if held is None else held, "names", "ics")
    rows = both.select("a", "b", F.array_intersect("names_a", "names_b").alias("_n"), common_ics().alias("_c")).select("*", F.array_max("_c").alias("ic")).where("ic is not null")
    if least is not None:
        rows = rows.where(F.col("ic") >= least)
    near = F.filter(F.arrays_zip("_n", "_c"), lambda z: z["_c"] >= F.col("ic") - tie)
    return rows.select("a", "b", "ic", F.array_join(F.array_sort(F.transform(near, lambda z: z["_n"].cast("string"))), ",").alias("subsumers"))


def full_content(full: DataFrame, up: DataFrame, edges: DataFrame, tie_break: bool = False) -> DataFrame:
    """(attribute, ic) of every class of the ontology: -log2 of its share of the elements; a class without elements gets the largest value of its parents that have one.

    With tie_break, a thousandth of the number of ancestors (itself included) is added.
    """
    size = full.agg(F.count_distinct("element").alias("_size"))
    used = frequencies(full).join(F.broadcast(size)).select("attribute", (-F.log2(F.col("n_elements") / F.col("_size"))).alias("ic"))
    known = settle(used, "content")
    todo = settle(C.nodes(edges).withColumnRenamed("node", "attribute").join(known, "attribute", "left_anti"), "unused")
    parent = C.clean(edges).toDF("attribute", "_p")
    while not todo.isEmpty():
        near = todo.join(parent, "attribute").join(known.toDF("_p", "_ic"), "_p", "left").join(todo.withColumnRenamed("attribute", "_p").withColumn("_open", F.lit(1)), "_p", "left")
        ready = near.groupBy("attribute").agg(F.max("_ic").alias("ic"), F.max("_open").alias("_open")).where("_open is null and ic is not null").select("attribute", "ic")
        ready = settle(ready, "content")
        if ready.isEmpty():
            break  # no parent has content
        known, todo = known.union(ready), settle(todo.join(ready, "attribute", "left_anti"), "unused")
    if not tie_break:
        return known
    n = up.groupBy(F.col("source").alias("attribute")).agg(F.count_distinct("target").alias("_n"))
    return known.join(n, "attribute").select("attribute", (F.col("ic") + F.col("_n") / 1000).alias("ic"))


#: Up to so many different sets are looked for in every element at once, with their table broadcast.
BROADCAST_SETS = 50_000


def set_frequency(sets: DataFrame, full: DataFrame) -> DataFrame:
    """(set_id, n): elements that have every attribute of the set (set_id, attribute); 0 where none has.

    Equal sets are counted once.  An element is tested for a set only if it has
    the set's rarest attribute and at least as many attributes as the set; sets
    of one attribute are as frequent as that.
    """
    ranked = sets.select("set_id", "attribute").distinct().join(frequencies(full), "attribute", "left").groupBy("set_id")
    ranked = settle(ranked.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n_elements", F.lit(0).cast("long")).alias("n"), F.col("attribute").alias("a")))).alias("_k")), "ranked")
    small = (F.size("_k") == 1) | (F.col("_k")[0]["n"] == 0)
    several = settle(ranked.where(~small).select("_k").distinct().select("_k", F.col("_k.a").alias("_need"), F.col("_k")[0]["a"].alias("attribute")), "several")
    held = full.groupBy("element").agg(F.collect_set("attribute").alias("_have"))
    fits = (F.size("_have") >= F.size("_need")) & (F.size(F.array_except("_need", "_have")) == 0)
    if several.count() <= BROADCAST_SETS:
        met = held.select("_have", F.explode("_have").alias("attribute")).join(F.broadcast(several), "attribute").where(fits)
    else:
        sized = full.join(full.groupBy("element").agg(F.count(F.lit(1)).alias("_n")), "element")
        asked = sized.join(several, "attribute").where(F.col("_n") >= F.size("_need")).select("element", "_k", "_need")
        met = asked.join(held, "element").where(fits)
    n = met.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(n, "_k", "left").select("set_id", F.when(small, F.col("_k")[0]["n"]).otherwise(F.coalesce("_n", F.lit(0))).alias("n"))


def subsumer_scores(pairs: DataFrame, up: DataFrame, full: DataFrame, ic: DataFrame) -> DataFrame:
    """Scores of class pairs over their lowest common subsumers: n_lcs, sum_ic, mean_ic, conjunction (content of the elements that have them all), ratio (conjunction over the smaller content of a and b)."""
    lowest = settle(C.lowest_common_subsumers(pairs, up), "lowest")
    weighed = lowest.join(ic.select(F.col("attribute").alias("subsumer"), "ic"), "subsumer")
    sums = weighed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_lcs"), F.sum("ic").alias("sum_ic"), F.avg("ic").alias("mean_ic"))
    n = set_frequency(lowest.select(F.struct("a", "b").alias("set_id"), F.col("subsumer").alias("attribute")), full).select("set_id.*", "n")
    size = full.agg(F.count_distinct("element").alias("_size"))
    out = sums.join(n, ["a", "b"]).join(F.broadcast(size)).withColumn("conjunction", F.when(F.col("n") > 0, -F.log2(F.col("n") / F.col("_size"))))
    for x in "ab":
        out = out.join(ic.select(F.col("attribute").alias(x), F.col("ic").alias(f"_{x}")), x)
    low = F.least("_a", "_b")
    return out.select("a", "b", "n_lcs", "sum_ic", "mean_ic", "conjunction", F.when(low > 0, F.col("conjunction") / low).alias("ratio"))


def best_match(pairs: DataFrame, marks: DataFrame, scores: DataFrame) -> DataFrame:
    """(a, b, forward, backward, average): mean best score of a's direct attributes among b's, and the other way, over any class score (x, y, score), both ways given."""
    direct = marks.select("element", "attribute").distinct()
    side = lambda c, x: direct.select(F.col("element").alias(c), F.col("attribute").alias(x))
    cells = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").join(scores, ["x", "y"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    one = lambda by, name: cells.groupBy("a", "b", by).agg(F.max("score").alias("m")).groupBy("a", "b").agg(F.avg("m").alias(name))
    return one("x", "forward").join(one("y", "backward"), ["a", "b"]).select("a", "b", "forward", "backward", ((F.col("forward") + F.col("backward")) / 2).alias("average"))


def hypergeometric_tail(spark):
    """Column function (k, c, n, m) -> P(X >= k): k of n drawn among m have a property that c have.

    Terms are summed from k away from the mean, where they fall quickly, until
    they don't count; below the mean the other side is summed.
    """
    ship_package(spark)

    def tail(k: pd.Series, c: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([one_tail(int(a), int(b), int(x), int(y)) for a, b, x, y in zip(k, c, n, m, strict=True)], dtype="float64")

    return F.pandas_udf(tail, "double")


def _log_choose(n: int, r: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)


def one_tail(k: int, c: int, n: int, m: int) -> float:
    low, high = max(0, n + c - m), min(c, n)
    if k <= low:
        return 1.0
    if k > high:
        return 0.0
    up = k > n * c / m
    x = k if up else k - 1
    term = math.exp(_log_choose(c, x) + _log_choose(m - c, n - x) - _log_choose(m, n))
    total = 0.0
    while low <= x <= high and term > total * 1e-17:
        total += term
        if up:
            term *= (c - x) * (n - x) / ((x + 1) * (m - c - n + x + 1))
            x += 1
        else:
            term *= x * (m - c - n + x) / ((c - x + 1) * (n - x + 1))
            x -= 1
    return min(1.0, total) if up else max(0.0, 1.0 - total)


def overlap_enrichment(left: DataFrame, right: DataFrame, population: int) -> DataFrame:
    """(a, b, n_a, n_b, n_both, p) of class pairs that share elements: sets (cls, element) on both sides, among population elements."""
    # Elements with the same classes are counted once, with their number.
    held = lambda df, x: df.where("element is not null and cls is not null").groupBy("element").agg(F.array_sort(F.collect_set("cls")).alias(x))
    sets = held(left, "_a").withColumn("_b", F.col("_a")) if left is right else held(left, "_a").join(held(right, "_b"), "element", "full")
    sets = settle(sets.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")), "sets")
    sizes = lambda x: sets.select(F.explode(f"_{x}").alias(x), "_n").groupBy(x).agg(F.sum("_n").alias(f"n_{x}"))
    both = sets.select(F.explode("_a").alias("a"), "_b", "_n").select("a", F.explode("_b").alias("b"), "_n").groupBy("a", "b").agg(F.sum("_n").alias("n_both"))
    out = both.join(sizes("a"), "a").join(sizes("b"), "b")
    p = hypergeometric_tail(left.sparkSession)("n_both", "n_b", "n_a", F.lit(population))
    return out.select("a", "b", "n_a", "n_b", "n_both", p.alias("p"))


def differentia(full: DataFrame, classes: DataFrame, up: DataFrame) -> DataFrame:
    """(cls, other, n_both, p): for each of classes (attribute) the other one, neither above nor below it, that shares its elements least by chance (ties: smaller id)."""
    few = full.join(classes.select("attribute").distinct(), "attribute", "left_semi").select(F.col("attribute").alias("cls"), "element")
    population = full.agg(F.count_distinct("element")).first()[0]
    found = overlap_enrichment(few, few, population).where("a <> b")
    kin = up.select(F.col("source").alias("a"), F.col("target").alias("b"))
    found = found.join(kin.union(kin.select("b", "a")).distinct(), ["a", "b"], "left_anti")
    best = found.groupBy("a").agg(F.min(F.struct(F.round("p", 12).alias("r"), "b", "n_both", "p")).alias("x"))
    return best.select(F.col("a").alias("cls"), F.col("x.b").alias("other"), F.col("x.n_both").alias("n_both"), F.col("x.p").alias("p"))


def homologous_classes(left: DataFrame, right: DataFrame, orthologs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, n_both, p): classes of two species by the ortholog pairs (left_gene, right_gene) that they share.

    left and right are (cls, element).  Only genes with an ortholog count; the population is the pairs.
    """
    pairs = settle(orthologs.select("left_gene", "right_gene").distinct().withColumn("pair", F.xxhash64("left_gene", "right_gene")), "orthologs")
    one = left.join(pairs.select(F.col("left_gene").alias("element"), "pair"), "element").select("cls", F.col("pair").alias("element"))
    two = right.join(pairs.select(F.col("right_gene").alias("element"), "pair"), "element").select("cls", F.col("pair").alias("element"))
    return overlap_enrichment(one, two, pairs.count())


def content_tests(pairs: DataFrame, sets: DataFrame, ic: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Of the content values of a's and b's attributes: t (equal variances), f (one-way analysis of variance), ks (largest distance of the distributions), df."""
    both = side_by_side(pairs, weighed(sets, ic) if held is None else held, "ics")
    out = both.select("a", "b", *[f(x) for x in "ab" for f in (
        lambda x: F.size(f"ics_{x}").cast("long").alias(f"n_{x}"), lambda x: (total(f"ics_{x}") / F.size(f"ics_{x}")).alias(f"mean_{x}"), lambda x: F.aggregate(f"ics_{x}", F.lit(0.0), lambda s, v: s + v * v).alias(f"sq_{x}"),
        lambda x: F.transform(f"ics_{x}", lambda v: F.round(v, 9)).alias(f"_v{x}"))])
    inside = sum((F.col(f"sq_{x}") - F.col(f"n_{x}") * F.col(f"mean_{x}") ** 2 for x in "ab"), F.lit(0.0))
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = F.when((df > 0) & (inside > 1e-12), inside / df)
    gap = F.col("mean_a") - F.col("mean_b")
    t = gap / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    upto = lambda x, v: F.size(F.filter(f"_v{x}", lambda y: y <= v)) / F.col(f"n_{x}")
    ks = F.array_max(F.transform(F.array_union("_va", "_vb"), lambda v: F.abs(upto("a", v) - upto("b", v))))
    return out.select("a", "b", t.alias("t"), (t * t).alias("f"), ks.alias("ks"), df.alias("df"))


def student_p(spark):
    """Column function (t, df) -> two-sided p of Student's distribution."""
    ship_package(spark)

    def both(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if x != x or n <= 0 else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t.astype(float), df, strict=True)], dtype="float64")

    return F.pandas_udf(both, "double")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for i in range(1, 500):
        for top in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value / a


def nearest_in_variance(sets: DataFrame, ic: DataFrame, reference, top: int, held: DataFrame | None = None) -> DataFrame:
    """(element, variance, rank): the top elements whose content values vary least around the reference element's mean (sum of squares over n - 1); rank from 1, ties by id."""
    held = weighed(sets, ic) if held is None else held
    mean = held.where(F.col("element") == reference).select((total("ics") / F.size("ics")).alias("_m"))  # one row
    around = held.where((F.col("element") != reference) & (F.size("ics") > 1)).join(F.broadcast(mean))
    spread = F.aggregate("ics", F.lit(0.0), lambda s, v: s + (v - F.col("_m")) * (v - F.col("_m")))
    first = around.select("element", F.round(spread / (F.size("ics") - 1), 9).alias("variance")).orderBy("variance", "element").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("variance", "element")).cast("long"))  # top rows


def bit_sets(sets: DataFrame, words: int = 16, hashes: int = 4) -> DataFrame:
    """(element, bits): a Bloom filter of 64 * words bits for each set."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64("attribute", F.lit(i)), F.lit(64 * words)) for i in range(hashes)]))
    bits = sets.select("element", at.alias("p")).select("element", F.floor(F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m"))
    each = bits.groupBy("element", "w").agg(F.expr("bit_or(m)").alias("m"))
    of = each.groupBy("element").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("_m"))
    return of.select("element", F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("bits"))


def approximate_overlap(pairs: DataFrame, filters: DataFrame, words: int = 16, hashes: int = 4) -> DataFrame:
    """(a, b, overlap): the size of the common set, estimated from how full both filters and their union are."""
    out = pairs
    for x in "ab":
        out = out.join(filters.select(F.col("element").alias(x), F.col("bits").alias(f"_{x}")), x)
    ones = lambda c: F.aggregate(c, F.lit(0), lambda n, w: n + F.bit_count(w))
    size = lambda c: -F.lit(64.0 * words / hashes) * F.log(1 - F.least(ones(c), F.lit(64 * words - 1)) / F.lit(64.0 * words))
    union = F.zip_with("_a", "_b", lambda p, q: p.bitwiseOR(q))
    return out.select("a", "b", F.greatest(F.lit(0.0), size(F.col("_a")) + size(F.col("_b")) - size(union)).alias("overlap"))


def property_view(edges: DataFrame, closed: DataFrame, prop: str, prefix: str) -> DataFrame:
    """(source, target): the view over a property: class prefix + c stands for "prop some c".

    Views are ordered as their classes are (edges are is_a); whatever has an edge
    over the property in closed (source, target, property) stands under the view.
    """
    view = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    under = closed.where(F.col("property") == prop).select(F.col("source").cast("string").alias("source"), view("target").alias("target"))
    return C.clean(edges).select(view("source").alias("source"), view("target").alias("target")).union(under).distinct()


def subsumer_classes(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """(a, b, cls): a named class for each pair's lowest common subsumers; several together get a name from all their ids."""
    lowest = C.lowest_common_subsumers(pairs, up).groupBy("a", "b").agg(F.array_sort(F.collect_set(F.col("subsumer").cast("string"))).alias("s"))
    return lowest.select("a", "b", F.when(F.size("s") == 1, F.col("s")[0]).otherwise(F.concat(F.lit("and("), F.array_join("s", ","), F.lit(")"))).alias("cls"))


def shuffled_marks(marks: DataFrame, seed: int, rows_a_part: int = 100_000) -> DataFrame:
    """marks with attributes dealt anew among the rows: each element keeps its number of rows, each attribute its own, by a hash of the seed."""
    direct = settle(marks.select("element", "attribute").distinct(), "marks")
    parts = max(1, -(-direct.count() // rows_a_part))
    at = F.pmod(F.xxhash64("element", "attribute", F.lit(seed)), F.lit(parts)).alias("_p")
    dealt = lambda c, s: direct.select(c, at, F.xxhash64("element", "attribute", F.lit(seed + s)).alias("_h"), "element", "attribute").select("_p", c, F.row_number().over(Window.partitionBy("_p").orderBy("_h", "element", "attribute")).alias("_i"))
    return dealt("element", 1).join(dealt("attribute", 2), ["_p", "_i"]).select("element", "attribute")


def co_annotated(weights: DataFrame, attributes: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b, n_both, weight, rank): for each of attributes (attribute) its co-annotated classes of at least that weight, the first most by weight (ties: id); rank from 1."""
    few = weights.join(attributes.select(F.col("attribute").alias("a")).distinct(), "a", "left_semi").where(F.col("weight") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("weight", 9)), "b")).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= most)


def as_json(rows: DataFrame, key: str, name: str = "json") -> DataFrame:
    """(key, json): the other columns of each row as one document."""
    return rows.select(F.col(key), F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != key])).alias(name))
