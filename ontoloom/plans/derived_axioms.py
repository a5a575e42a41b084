"""Class axioms derived from the driver tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.derived import _read

#: (id, kind, property, filler, n) of expressions.
EXPRESSION = "id string, kind string, property string, filler string, n int"


def _key(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def axioms(spark, d) -> DataFrame:
    """customer is a nation, is part of a region; a supplier is a company and a member of its nation; a part is made in a nation; some customers trade in one region only."""
    c, n, r, s, p = (_read(spark, d, t) for t in ("customer", "nation", "region", "supplier", "part"))
    pair = lambda df, a, b: df.select(a.alias("sub"), b.alias("sup"))
    nation = _key("N:", F.col("n_nationkey"))
    out = pair(c, _key("C:", F.col("c_custkey")), _key("N:", F.col("c_nationkey")))
    out = out.union(pair(n, nation, _key("X:part_of:R:", F.col("n_regionkey"))))
    out = out.union(pair(s, _key("U:", F.col("s_suppkey")), _key("A:", F.col("s_nationkey"))))
    out = out.union(pair(r, _key("R:", F.col("r_regionkey")), F.lit("ROOT")))
    out = out.union(pair(p, _key("P:", F.col("p_partkey")), _key("X:made_in:N:", F.col("p_partkey") % 25)))
    return out.union(pair(c.where("c_custkey % 7 = 0"), _key("C:", F.col("c_custkey")), _key("O:trades_in:R:", F.col("c_custkey") % 5)))


AXIOMS = "SELECT 'C:' || c_custkey AS sub, 'N:' || c_nationkey AS sup FROM customer UNION ALL SELECT 'N:' || n_nationkey, 'X:part_of:R:' || n_regionkey FROM nation UNION ALL SELECT 'U:' || s_suppkey, 'A:' || s_nationkey FROM supplier UNION ALL SELECT 'R:' || r_regionkey, 'ROOT' FROM region UNION ALL SELECT 'P:' || p_partkey, 'X:made_in:N:' || (p_partkey % 25) FROM part UNION ALL SELECT 'C:' || c_custkey, 'O:trades_in:R:' || (c_custkey % 5) FROM customer WHERE c_custkey % 7 = 0"


def expressions(spark, d) -> DataFrame:
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    none = F.lit(None).cast("int")
    one = lambda df, id_, kind, prop, filler: df.select(id_.alias("id"), F.lit(kind).alias("kind"), F.lit(prop).cast("string").alias("property"), filler.alias("filler"), none.alias("n"))
    region, nation = F.col("r_regionkey"), F.col("n_nationkey")
    out = one(r, _key("X:part_of:R:", region), "some", "part_of", _key("R:", region))
    out = out.union(one(r, _key("O:trades_in:R:", region), "only", "trades_in", _key("R:", region)))
    for prop in ("member_of", "made_in"):
        out = out.union(one(n, _key(f"X:{prop}:N:", nation), "some", prop, _key("N:", nation)))
    return out.union(one(n, _key("A:", nation), "and", None, F.lit("COMPANY"))).union(one(n, _key("A:", nation), "and", None, _key("X:member_of:N:", nation)))


EXPRESSIONS = "SELECT 'X:part_of:R:' || r_regionkey AS id, 'some' AS kind, 'part_of' AS property, 'R:' || r_regionkey AS filler FROM region UNION ALL SELECT 'O:trades_in:R:' || r_regionkey, 'only', 'trades_in', 'R:' || r_regionkey FROM region UNION ALL SELECT 'X:member_of:N:' || n_nationkey, 'some', 'member_of', 'N:' || n_nationkey FROM nation UNION ALL SELECT 'X:made_in:N:' || n_nationkey, 'some', 'made_in', 'N:' || n_nationkey FROM nation UNION ALL SELECT 'A:' || n_nationkey, 'and', NULL, 'COMPANY' FROM nation UNION ALL SELECT 'A:' || n_nationkey, 'and', NULL, 'X:member_of:N:' || n_nationkey FROM nation"

#: The edges between named classes that these axioms make.
NAMED = "SELECT 'C:' || c_custkey AS source, 'N:' || c_nationkey AS target, 'SUBCLASS_OF' AS label FROM customer UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'SOME part_of' FROM nation UNION SELECT 'U:' || s_suppkey, 'COMPANY', 'SUBCLASS_OF' FROM supplier UNION SELECT 'U:' || s_suppkey, 'N:' || s_nationkey, 'SOME member_of' FROM supplier UNION SELECT 'R:' || r_regionkey, 'ROOT', 'SUBCLASS_OF' FROM region UNION SELECT 'P:' || p_partkey, 'N:' || (p_partkey % 25), 'SOME made_in' FROM part UNION SELECT 'C:' || c_custkey, 'R:' || (c_custkey % 5), 'ONLY trades_in' FROM customer WHERE c_custkey % 7 = 0"


def conditional(spark, d) -> tuple[DataFrame, DataFrame]:
    """Axioms (sub, sup) and expressions of: a nation of number n that trades with region n mod 5, n divisible by 5, is in market n mod 3."""
    n = _read(spark, d, "nation").where("n_nationkey % 5 = 0")
    key = F.col("n_nationkey")
    ax = n.select(_key("G:", key).alias("sub"), _key("M:", key % 3).alias("sup"))
    none = F.lit(None).cast("int")
    ex = n.select(_key("G:", key).alias("id"), F.lit("and").alias("kind"), F.lit(None).cast("string").alias("property"), _key("N:", key).alias("filler"), none.alias("n"))
    ex = ex.union(n.select(_key("G:", key), F.lit("and"), F.lit(None).cast("string"), _key("X:trades_with:R:", key % 5), none))
    return ax, ex.union(n.select(_key("X:trades_with:R:", key % 5), F.lit("some"), F.lit("trades_with"), _key("R:", key % 5), none)).distinct()


CONDITIONAL = "SELECT 'N:' || n_nationkey AS source, 'M:' || (n_nationkey % 3) AS target, 'SUBCLASS_OF' AS label, 'trades_with' AS gci_relation, 'R:' || (n_nationkey % 5) AS gci_filler FROM nation WHERE n_nationkey % 5 = 0"


def profile(spark, d) -> dict[str, DataFrame]:
    """Normalised axioms: nations part of regions (part_of is located_in), customers of nations and segments.

    What is part of region 1 is AM, AM with segment BUILDING is AB; located in
    region 3 is LOC3; part of region 2 with segment AUTOMOBILE is nothing;
    region 4 is the same as RR:4; customers with keys divisible by 10 are said to
    be AM where they are.
    """
    c, n = _read(spark, d, "customer"), _read(spark, d, "nation")
    customer, nation = _key("C:", F.col("c_custkey")), _key("N:", F.col("c_nationkey"))
    segment = F.concat(F.lit("SEG:"), "c_mktsegment")
    few = spark.createDataFrame([("R:4", "RR:4"), ("RR:4", "R:4")], "a string, b string")
    said = c.join(n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").where("c_custkey % 10 = 0")
    sub = c.select(customer.alias("a"), nation.alias("b")).union(c.select(customer, segment)).union(few).union(said.select(customer, F.lit("AM")))
    right = n.select(_key("N:", F.col("n_nationkey")).alias("a"), F.lit("part_of").alias("property"), _key("R:", F.col("n_regionkey")).alias("b"))
    both = spark.createDataFrame([("AM", "SEG:BUILDING", "AB"), ("_IN2", "SEG:AUTOMOBILE", "Nothing")], "a1 string, a2 string, b string")
    left = spark.createDataFrame([("part_of", "R:1", "AM"), ("located_in", "R:3", "LOC3"), ("part_of", "R:2", "_IN2")], "property string, a string, b string")
    return {"sub": sub, "both": both, "right": right, "left": left, "sub_property": spark.createDataFrame([("part_of", "located_in")], "p string, q string")}


PROFILE = "SELECT 'C:' || c_custkey AS c, 'N:' || c_nationkey AS n, c_custkey, c_mktsegment AS seg, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey"


def definitions(spark, d) -> DataFrame:
    """(cls, property, filler): a part is a branded thing of a size; a branded thing is an item made by its brand."""
    p = _read(spark, d, "part")
    part, brand = _key("DP:", F.col("p_partkey")), F.concat(F.lit("DB:"), "p_brand")
    none = F.lit(None).cast("string")
    out = p.select(part.alias("cls"), none.alias("property"), brand.alias("filler")).union(p.select(part, F.lit("has_size"), _key("S:", F.col("p_size"))))
    return out.union(p.select(brand, none, F.lit("ITEM"))).union(p.select(brand, F.lit("made_by"), F.col("p_brand"))).distinct()


DEFINITIONS = "SELECT 'DP:' || p_partkey AS cls, NULL AS property, 'DB:' || p_brand AS filler FROM part UNION SELECT 'DP:' || p_partkey, 'has_size', 'S:' || p_size FROM part UNION SELECT 'DB:' || p_brand, NULL, 'ITEM' FROM part UNION SELECT 'DB:' || p_brand, 'made_by', p_brand FROM part"
