"""Ontologies and annotations derived from the driver tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_edges(spark, sf_dir) -> DataFrame:
    """customer -> nation -> region -> ROOT"""
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"))
    return edge(c, "C:", "c_custkey", "N:", "c_nationkey").union(edge(n, "N:", "n_nationkey", "R:", "n_regionkey")).union(r.select(F.concat(F.lit("R:"), "r_regionkey").alias("source"), F.lit("ROOT").alias("target")))


GEO = "SELECT 'C:' || c_custkey AS source, 'N:' || c_nationkey AS target FROM customer UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION SELECT 'R:' || r_regionkey, 'ROOT' FROM region"


def part_edges(spark, sf_dir) -> DataFrame:
    """part -> brand, type, size class; each of these -> ROOT"""
    p = _read(spark, sf_dir, "part")
    classes = F.array(F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("T:"), "p_type"), F.concat(F.lit("S:"), F.floor(F.col("p_size") / 10).cast("int")))
    low = p.select(F.concat(F.lit("P:"), "p_partkey").alias("source"), F.explode(classes).alias("target"))
    return low.union(low.select(F.col("target").alias("source"), F.lit("ROOT").alias("target")).distinct())


PART = "SELECT 'P:' || p_partkey AS source, unnest(['B:' || p_brand, 'T:' || p_type, 'S:' || CAST(floor(p_size / 10) AS INT)]) AS target FROM part"
PART = f"SELECT source, target FROM ({PART}) UNION SELECT DISTINCT target, 'ROOT' FROM ({PART})"


def half_edges(spark, sf_dir) -> DataFrame:
    """part key k -> k div 2, a deep tree"""
    return _read(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).cast("long").alias("target"))


HALF = "SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey > 1"


def cycle_edges(spark, sf_dir) -> DataFrame:
    """size s -> (3 s + 1) mod 40 and s -> s div 2: a graph with cycles"""
    s = _read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("s")).distinct()
    return s.select(F.col("s").alias("source"), ((F.col("s") * 3 + 1) % 40).alias("target")).union(s.where("s > 40").select("s", F.floor(F.col("s") / 2).cast("long")))


CYCLE = "SELECT DISTINCT CAST(p_size AS BIGINT) AS source, CAST((p_size * 3 + 1) % 40 AS BIGINT) AS target FROM part UNION SELECT DISTINCT CAST(p_size AS BIGINT), CAST(p_size // 2 AS BIGINT) FROM part WHERE p_size > 40"


def marks(spark, sf_dir) -> DataFrame:
    """element = order, attribute = part"""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element"), F.concat(F.lit("P:"), "l_partkey").alias("attribute"))


MARKS = "SELECT DISTINCT l_orderkey AS element, 'P:' || l_partkey AS attribute FROM lineitem"


def pairs(spark, sf_dir) -> DataFrame:
    """Orders of a customer and their next order."""
    from pyspark.sql import Window

    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("a"), after.alias("b")).where("b is not null")


PAIRS = "SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) WHERE b IS NOT NULL"


def labelled_edges(spark, sf_dir) -> DataFrame:
    """customer is_a nation part_of region is_a ROOT; supplier member_of nation"""
    c, s, n, r = (_read(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    edge = lambda df, a, x, b, y, p: df.select(F.concat(F.lit(a), F.col(x)).alias("source"), (F.concat(F.lit(b), F.col(y)) if y else F.lit(b)).alias("target"), F.lit(p).alias("property"))
    low = edge(c, "C:", "c_custkey", "N:", "c_nationkey", "is_a").union(edge(s, "U:", "s_suppkey", "N:", "s_nationkey", "member_of"))
    return low.union(edge(n, "N:", "n_nationkey", "R:", "n_regionkey", "part_of")).union(edge(r, "R:", "r_regionkey", "ROOT", None, "is_a"))


LABELLED = "SELECT 'C:' || c_custkey AS source, 'N:' || c_nationkey AS target, 'is_a' AS property FROM customer UNION SELECT 'U:' || s_suppkey, 'N:' || s_nationkey, 'member_of' FROM supplier UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'part_of' FROM nation UNION SELECT 'R:' || r_regionkey, 'ROOT', 'is_a' FROM region"


def annotations(spark, sf_dir) -> DataFrame:
    """One annotation a line item: order -> part, evidence from the return flag, a partner order, qualifiers from the line number."""
    l, c = _read(spark, sf_dir, "lineitem"), F.col  # noqa: E741
    evidence = F.when(c("l_returnflag") == "A", "IPI").when(c("l_returnflag") == "N", "IEA").otherwise("IDA")
    partner = F.when(c("l_linestatus") == "F", F.array(F.concat(F.lit("O:"), c("l_orderkey") + 1))).otherwise(F.array().cast("array<string>"))
    qualifier = F.element_at(F.array(*map(F.lit, ("", "NOT", "NOT|contributes to", "Colocalizes_With,odd"))), (c("l_linenumber") % 4 + 1).cast("int"))
    return l.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("annotation_id"), F.concat(F.lit("O:"), "l_orderkey").alias("bioentity"), F.concat(F.lit("P:"), "l_partkey").alias("cls"),
        evidence.alias("evidence"), partner.alias("with_from"), qualifier.alias("qualifier"), c("l_shipdate").cast("date").alias("date"), F.concat(F.lit("U:"), "l_suppkey").alias("taxon"), F.col("l_linestatus").alias("assigned_by"),
    )


ANNOTATIONS = "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS annotation_id, 'O:' || l_orderkey AS bioentity, 'P:' || l_partkey AS cls, CASE l_returnflag WHEN 'A' THEN 'IPI' WHEN 'N' THEN 'IEA' ELSE 'IDA' END AS evidence, CASE WHEN l_linestatus = 'F' THEN 'O:' || (l_orderkey + 1) END AS partner, ['', 'NOT', 'NOT|contributes to', 'Colocalizes_With,odd'][l_linenumber % 4 + 1] AS qualifier, CAST(l_shipdate AS DATE) AS date, 'U:' || l_suppkey AS taxon, l_linestatus AS assigned_by FROM lineitem"
