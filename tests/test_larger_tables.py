"""Work that grew faster than the tables: lines moved for their header, classes met by common parts, tasks that grow with inputs."""

from pyspark.sql import functions as F

from ontoloom.functions import parsing as P
from ontoloom.operators import class_queries as Q
from ontoloom.operators import comparisons as K
from ontoloom.operators import rewrite as R
from ontoloom.operators import saturation as S
from ontoloom.plans import catalog_compare as CC
from ontoloom.plans import session as O
from ontoloom.sources import annotation_files as AF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_moved_for_their_header(spark, tmp_path):
    row = "\t".join("DB id1 sym NOT|x GO:1 PMID:1|PM|ID IEA DB:2 F name syn gene taxon:1|taxon:2 20200101 me".split(" ") + ["", ""])
    AF.write_gaf(spark.createDataFrame([tuple(row.split("\t"))], ", ".join(f"{c} string" for c in AF.GAF)), f"{tmp_path}/gaf", compression="gzip")
    rows = AF.read_gaf(spark, f"{tmp_path}/gaf")
    assert "Exchange hashpartitioning" not in _plan(rows) and [r["line"] for r in rows.collect()] == [row]
    assert {r["rule"] for r in AF.column_checks(rows, "2020-06-01").collect()} == set()


def test_qualifiers_in_any_form(spark):
    texts = {None: 0, "": 0, " ": 0, "NOT": 1, "not , Contributes  to": 3, "contributes-to|CUT": 18, "-contributes_to": 0, "contributes__to": 0, "colocalizes - with": 4, "NOTED": 0, "integral_to x": 0, "a|integral_to": 8}
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    assert {r["q"]: r["f"] for r in df.select("q", P.qualifier_flags(df["q"]).alias("f")).collect()} == texts


def test_classes_are_looked_up_by_their_rarest_part(spark):
    definitions = spark.createDataFrame([(f"c{i}", p) for i in range(50) for p in ("common", f"p{i}")] + [("one", "common")], "cls string, part string")
    have = spark.createDataFrame([("k", "common"), ("k", "p7"), ("k", "p7"), ("k", "other"), ("l", "p7"), ("m", "common")], "key string, part string")
    found = R.class_cover(definitions, have)
    assert sorted(map(tuple, found.collect())) == [("k", "c7"), ("k", "one"), ("m", "one")]


def test_elements_with_the_same_classes_are_counted_once(spark):
    few = spark.createDataFrame([(c, e) for e in range(20) for c in ("A", "B")] + [("A", 20), ("C", 21), ("A", 0)], "cls string, element int")
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["n_both"]) for r in K.overlap_enrichment(few, few.select("*"), 22).collect()}
    assert got == {("A", "A"): (21, 21, 21), ("A", "B"): (21, 20, 20), ("B", "A"): (20, 21, 20), ("B", "B"): (20, 20, 20), ("C", "C"): (1, 1, 1)}
    assert {(r["a"], r["b"]): r["n_both"] for r in K.overlap_enrichment(few, few, 22).collect()} == {k: v[2] for k, v in got.items()}


def test_spread_tables_have_partitions_by_input(spark, monkeypatch):
    name, seen = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", []
    before = spark.conf.get(name, None)
    small = O.settle(spark.range(100), "small")
    monkeypatch.setattr(O, "SPREAD", 1)
    real = O._settings
    monkeypatch.setattr(O, "_settings", lambda s, wanted: seen.append(wanted) or real(s, wanted))
    assert O.settle(small.groupBy("id").count(), "spread", spread=True).count() == 100
    assert int(next(w[name] for w in seen if name in w)) > int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.conf.get(name, None) == before


def test_told_axioms_answer_without_rules(spark, monkeypatch):
    """Questions of classes that no rule ends in need no classification; other questions have the rules' answers."""
    frame = lambda names, *rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    sub = [("P:1", "P:0"), ("P:2", "P:1"), ("P:1", "P:2"), ("P:3", "P:2"), ("P:3", "P:0"), ("P:4", "P:0")]
    tables = {"sub": frame("a b", *sub), "right": frame("a property b", ("P:2", "of", "P:4"), ("P:4", "in", "R")), "left": frame("property a b", ("in", "R", "_I"))}
    some = [("strict", "?x", "P:0"), ("some", "?x", "of", "?y")]
    rows = lambda *q, **k: {tuple(r[c] for c in sorted(r.asDict())) for r in Q.ask(*q, **k).collect()}
    ruled = Q.told(tables, F.col("a") == "_I")
    assert isinstance(ruled, S.State) and {r["x"] for r in ruled.implied.where("a = '_I'").collect()} == {"_I", "P:4"}
    monkeypatch.setattr(S, "_rounds", None)
    held = Q.told(tables, F.col("a").like("P:%"))
    assert rows(some, held, wanted=["x"]) == {("P:1",), ("P:2",), ("P:3",)}
    assert rows([*some, ("strict", "?y", "P:0")], held) == {("P:1", "P:4"), ("P:2", "P:4"), ("P:3", "P:4")}
    direct = {("P:1", "P:0"), ("P:2", "P:0"), ("P:3", "P:1"), ("P:3", "P:2"), ("P:4", "P:0")}
    assert rows([("direct", "?x", "?y")], held) == direct


def test_set_frequencies_has_every_customer(spark):
    """sets of all customers with marked orders."""
    d = "/root/testdata/sf0.001"
    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    want = {r[0] for r in orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_custkey").distinct().collect()}
    got = [r["set_id"] for r in CC.set_frequencies(spark, d).select("set_id").collect()]
    assert any(k % 10 for k in want) and len(got) == len(want) and set(got) == want


def test_pairs_go_to_members_in_rows_of_many(spark):
    """F1: members aren't moved a row a member and class; scores are rounded once a pair of classes."""
    held = {f"e{i}": {f"e{i}", f"b{i % 2}", "root"} for i in range(9)}
    sets = spark.createDataFrame([(e, a) for e, s in held.items() for a in s], "element string, attribute string")
    want = {(a, b): round(len(held[a] & held[b]) / len(held[a] | held[b]), 3) for a in held for b in held if a < b}
    assert {(r["a"], r["b"]): r["jaccard"] for r in K.similar_pairs(sets, 10, digits=3).collect()} == want
