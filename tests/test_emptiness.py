"""Emptiness by marks against a plain saturation in Python."""

import random

import pytest
from test_saturation import frames, plain, random_tables

from ontoloom.operators import annotation_reasoning as AR
from ontoloom.operators import emptiness as E
from ontoloom.operators.reasoning import NOTHING


def tables_of(seed):
    tables = random_tables(random.Random(seed), size=6)
    del tables["chains"]
    tables["both"] += [("A", "B", NOTHING), ("C", "D", "E")]
    return tables


def empty(tables, kind=None, *axioms):
    return {x for x, p, y in plain(tables | ({kind: tables[kind] + list(axioms)} if kind else {})) if (p, y) == ("", NOTHING)} - {NOTHING}


@pytest.mark.parametrize("seed", [1])
def test_contexts_and_annotations(spark, seed):
    tables = tables_of(seed)
    known, always = E.marked(frames(spark, tables)), empty(tables)
    assert {r["x"] for r in known.empty.collect()} - {NOTHING} == always
    names = "ABCDEFGHI"
    contexts = spark.createDataFrame([(c,) for c in [*names, None]], "node string")
    pairs = lambda df: sorted(map(tuple, df.select("ctx", "node").collect()))
    assert pairs(E.outside(known, contexts, "p", "B")) == sorted((c, x) for c in names for x in empty(tables, "right", ("B", "p", c)) - always)
    assert pairs(E.outside(known, contexts, "q", "B", only=False)) == sorted((c, x) for c in names for x in empty(tables, "left", ("q", c, NOTHING)) - always)
    rows = [(f"{a}{b}", a, b) for a in names for b in names] + [("again", "A", "B"), ("null", None, "B")]
    found = AR.contradictions(spark.createDataFrame(rows, "id string, cls string, taxon string"), known, property_="p")
    want = {(a, b) for a in names for b in names if "@" in empty(tables | {"sub": tables["sub"] + [("@", a)]}, "right", ("@", "p", b))}
    assert sorted(r["id"] for r in found.collect()) == sorted(i for i, a, b in rows if (a, b) in want)


def test_walks_of_many_rounds(spark):
    """A chain longer than the steps of a walk, closed to a cycle, with an end that is empty through a link."""
    n = 3 * E.ROUNDS
    sub = [(f"c{i}", f"c{i + 1}") for i in range(n)] + [(f"c{n}", "c0"), ("none", NOTHING)]
    known = E.marked(frames(spark, {"sub": sub, "right": [(f"c{n}", "p", "none")]}))
    assert {r["x"] for r in known.empty.collect()} == {NOTHING, "none", *[f"c{i}" for i in range(n + 1)]}


def test_contexts_that_say_the_same_are_followed_once(spark):
    """Many taxa of one group cost no rows of their own."""
    tables = {"sub": [(f"t{i}", "T") for i in range(50)] + [("low", "root")], "left": [("in", "T", "_t")], "both": [("_t", "low", NOTHING)]}
    known = E.marked(frames(spark, tables))
    names, facts = E._alike(E._said_by(known, "in", known.held.where("x like 't%'"), known.empty.where("x like 't%'")))
    assert (names.count(), [tuple(r) for r in facts.collect()]) == (50, [("t0", "_t")])
    contexts = spark.createDataFrame([(f"t{i}",) for i in range(50)], "node string")
    assert {tuple(r) for r in E.outside(known, contexts, "in", "root").collect()} == {(f"t{i}", "low") for i in range(50)}
