"""Macros in Manchester syntax."""

import pytest

from ontoloom.operators import macros as M


def test_parsed():
    root, rows = M.parsed("a and (not b or p some (q only ?Y)) and r min 2 c")
    only = "ObjectAllValuesFrom(q ?Y)"
    some = f"ObjectSomeValuesFrom(p {only})"
    either, least = f"ObjectUnionOf(ObjectComplementOf(b) {some})", "ObjectMinCardinality(2 r c)"
    assert root == f"ObjectIntersectionOf(a {either} {least})"
    assert set(rows) == {(only, "only", "q", "?Y", None), (some, "some", "p", only, None), ("ObjectComplementOf(b)", "not", None, "b", None), (either, "or", None, "ObjectComplementOf(b)", None), (either, "or", None, some, None), (least, "min", "r", "c", 2), *((root, "and", None, x, None) for x in ("a", either, least))}
    for bad in ("a and", "(a", "a b", "p some", ""):
        with pytest.raises(ValueError):
            M.parsed(bad)


def _texts(spark, *rows):
    return spark.createDataFrame(list(rows), "property string, text string")


def test_expressions_until_none_is_left(spark):
    ax = spark.createDataFrame([("A", "e1"), ("e2", "B"), (None, "e1")], "sub string, sup string")
    rows = [("e1", "some", "lacks", "Tail", None), ("e2", "and", None, "A", None), ("e2", "and", None, "e3", None), ("e3", "some", "near", "e1", None), ("e4", "some", "kept", "X", None)]
    ex = spark.createDataFrame(rows, "id string, kind string, property string, filler string, n int")
    got_ax, got_ex = M.expand_expressions(ax, ex, _texts(spark, ("lacks", "has_part exactly 0 ?Y"), ("near", "within some ?Y"), ("within", "in some (?Y or Box)"), ("none", None)))
    none = "ObjectExactCardinality(0 has_part Tail)"
    union = f"ObjectUnionOf({none} Box)"
    inside = f"ObjectSomeValuesFrom(in {union})"
    assert {tuple(r) for r in got_ax.collect()} == {("A", none), ("e2", "B")}
    # e3's template holds e1, which is expanded at the same time; the name inside follows.
    parts = {tuple(r) for r in got_ex.collect()}
    assert ("e2", "and", None, "A", None) in parts and (none, "exact", "has_part", "Tail", 0) in parts and ("e4", "some", "kept", "X", None) in parts
    end = next(f for i, _, _, f, _ in parts if i == "e2" and f != "A")
    top = next(r for r in parts if r[0] == end)
    assert top[1:3] == ("some", "in") and {r[3] for r in parts if r[0] == top[3]} == {none, "Box"}
    assert not any(p in ("lacks", "near", "within") for _, _, p, _, _ in parts) and inside


def test_cycles_are_errors(spark):
    ax = spark.createDataFrame([("A", "e1")], "sub string, sup string")
    ex = spark.createDataFrame([("e1", "some", "p", "B", None)], "id string, kind string, property string, filler string, n int")
    with pytest.raises(ValueError, match="back to itself"):
        M.expand_expressions(ax, ex, _texts(spark, ("p", "q some ?Y"), ("q", "p some ?Y")))


def test_assertions(spark):
    said = spark.createDataFrame([("wing", "never_in", "fish"), ("fin", "other", "bird"), (None, "never_in", "x")], "x string, property string, y string")
    axioms, ex = M.expand_assertions(said, _texts(spark, ("never_in", "Class: ?X DisjointWith: in_taxon some ?Y"), ("other", "in some ?Y")))
    assert [tuple(r) for r in axioms.collect()] == [("wing", "DisjointWith", "ObjectSomeValuesFrom(in_taxon fish)")]
    assert [tuple(r) for r in ex.collect()] == [("ObjectSomeValuesFrom(in_taxon fish)", "some", "in_taxon", "fish", None)]
