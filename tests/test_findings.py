"""What a review of larger tables found: repeated rows, and work that grew faster than the tables."""

from collections import Counter

import duckdb
import pytest

from ontoloom.operators import saturation as S
from ontoloom.plans import catalog_structures as CS
from ontoloom.plans.register import SQL


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder of 500 parts, and the other tables at sf0.001."""
    d = tmp_path_factory.mktemp("parts")
    con = duckdb.connect()
    for t in ("region", "nation", "supplier"):
        con.execute(f"create table {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    con.execute("create table part as select range as p_partkey from range(500)")
    for t in ("region", "nation", "supplier", "part"):
        con.execute(f"copy {t} to '{d}/{t}.parquet' (format parquet)")
    return con, str(d)


def same_rows(df, con, name):
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cur.fetchall())


def test_direct_superclasses_once_for_each_class_said_to_be_in_a_region(spark, parts):
    con, d = parts
    same_rows(CS.class_query_direct(spark, d), con, "class_query_direct")


def test_classes_in_many_axioms_of_two(spark):
    """More axioms about one class than are followed one by one; new names that only say something of themselves."""
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    n = S.FAN + 8
    both = [("M", f"k{i}", "Nothing") for i in range(n)]
    sub = [("low", "k3"), ("low", "top"), ("other", "top"), ("N", "R")]
    state = S.classify({"sub": frame(sub, "a b"), "right": frame([("low", "in", "N"), ("has", "of", "low")], "a property b"), "left": frame([("in", "R", "M")], "property a b"), "both": frame(both, "a1 a2 b")})
    empty = lambda df: {r["x"] for r in df.collect()}
    assert empty(state.implied.where("a = 'Nothing' and x <> 'Nothing'")) == {"low", "has"}
    said = {"sub": frame([("@1", "k5"), ("@2", "other"), ("@3", "has")], "a b"), "right": frame([("@1", "in", "N"), ("@2", "in", "N"), ("@3", "in", "R")], "a property b")}
    assert empty(S.emptied(state, said)) == {"@1", "@3"}


def test_settings_come_back(spark):
    """Files count for more while a table is settled, and for what the session says after it."""
    from ontoloom.plans.session import _ROOM, roomy

    before = {k: spark.conf.get(k, None) for k in _ROOM}
    with roomy(spark):
        assert {k: spark.conf.get(k) for k in _ROOM} == _ROOM
    assert {k: spark.conf.get(k, None) for k in _ROOM} == before


def frame(spark, names, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def test_told_superclasses_need_no_rules(spark, monkeypatch):
    """rules are followed only where one can end in a class that is asked for."""
    from pyspark.sql import functions as F

    sub = frame(spark, "a b", ("x", "y"), ("y", "z"), ("z", "y"))
    tables = {"sub": sub, "both": frame(spark, "a1 a2 b", ("y", "z", "m"))}
    found = lambda c: {tuple(r) for r in S.superclasses(tables, c).where("x = 'x'").collect()}
    assert found(F.col("a") == "m") == {("x", "m")}
    monkeypatch.setattr(S, "_rounds", None)
    assert found(F.col("a").isin("x", "y", "z")) == {("x", "x"), ("x", "y"), ("x", "z")}


def test_alike_elements_are_compared_once(spark):
    """pairs of classes are dealt out to members; all pairs as by brute force."""
    from ontoloom.operators import comparisons as P

    held = {f"e{i}": {f"e{i}", f"b{i % 3}", f"t{i % 4}", "root"} | ({"odd"} if i % 5 == 0 else set()) for i in range(60)} | {"alone": {"only"}}
    sets = frame(spark, "element attribute", *[(e, a) for e, s in held.items() for a in s])
    members, classes = P.alike(sets)
    assert members.count() == 60 and classes.count() == 24
    for percent in (30, 60, 90):
        want = {(a, b) for a in held for b in held if a < b and 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b])}
        got = P.similar_pairs(sets, percent).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("most", [50_000, 0])
def test_equal_sets_are_counted_once(spark, monkeypatch, most):
    """sets by their rarest attribute, with a table of few or of many sets."""
    from ontoloom.operators import comparisons as P

    monkeypatch.setattr(P, "BROADCAST_SETS", most)
    full = frame(spark, "element attribute", *[(f"e{i}", a) for i in range(12) for a in ("root", f"b{i % 2}", f"t{i % 3}")])
    sets = frame(spark, "set_id attribute", ("s1", "b0"), ("s1", "t0"), ("s2", "t0"), ("s2", "b0"), ("s3", "root"), ("s4", "b0"), ("s4", "b1"), ("s5", "b0"), ("s5", "none"))
    assert {tuple(r) for r in P.set_frequency(sets, full).collect()} == {("s1", 2), ("s2", 2), ("s3", 12), ("s4", 0), ("s5", 0)}


def test_one_class_for_each_definition(spark):
    """an annotation meets one of the classes that are defined alike, or all."""
    from pyspark.sql import functions as F

    from ontoloom.operators import annotations as A

    definitions = spark.createDataFrame([(c, p, f) for c in ("D:10", "D:9") for p, f in ((None, "G"), ("size", "S:1"))], "cls string, property string, filler string")
    ann = spark.createDataFrame([(1, "G", [[("size", "S:1")]])], "annotation_id long, cls string, ext array<array<struct<relation:string,cls:string>>>")
    number = F.substring("cls", 3, 9).cast("long")
    assert [tuple(r) for r in A.folded(ann, definitions, first=number).collect()] == [(1, "D:9")]
    assert A.folded(ann, definitions).count() == 2


def test_sets_with_content_are_one_row_each(spark):
    """F15, F16, F18 to F25, F28: scores from one row an element, repeated marks counted once."""
    from ontoloom.operators import similarity as M

    marks = frame(spark, "element attribute", ("e", "p"), ("e", "p"), ("e", "q"), ("f", "q"))
    up = frame(spark, "source target", ("p", "p"), ("p", "r"), ("q", "q"), ("q", "r"), ("r", "r"))
    ic = spark.createDataFrame([("p", 1.0), ("q", 0.5), ("r", 0.0)], "attribute string, ic double")
    sets = {r["element"]: r for r in M.weighed_sets(marks, up, ic).collect()}
    assert {k: dict(zip(r["names"], r["ics"])) for k, r in sets.items()} == {"e": {"p": 1.0, "q": 0.5, "r": 0.0}, "f": {"q": 0.5, "r": 0.0}}
    assert sorted(sorted(sets["e"]["names"][i - 1] for i in d) for d in sets["e"]["direct"]) == [["p", "r"], ["q", "r"]]
    pairs = frame(spark, "a b", ("e", "f"))
    row = M.pair_scores(pairs, None, ic, M.weighed_sets(marks, up, ic)).first()
    assert (row["n_common"], row["n_a"], row["n_b"], row["max_ic"], round(row["simgic"], 6)) == (2, 3, 2, 0.5, 0.333333)
    assert M.pair_scores(pairs, M.inferred(marks, up), ic).first() == row
