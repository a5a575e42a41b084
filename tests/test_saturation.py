"""Stored classification, contexts, explanations and predictions against a plain saturation in Python."""

import itertools
import random

import pytest

from ontoloom.operators import annotation_reasoning as AR
from ontoloom.operators import saturation as S
from ontoloom.operators.reasoning import NOTHING

SCHEMAS = {k: ", ".join(f"{c} string" for c in v.split()) for k, v in S.COLUMNS.items()}


def frames(spark, tables, ctx=False):
    return {k: spark.createDataFrame(v, ("ctx string, " if ctx else "") + SCHEMAS[k]) for k, v in tables.items()}


def plain(tables):
    """Facts (x, p, y) of axioms."""
    by = {k: tables.get(k, []) for k in S.COLUMNS}
    names = {c for k in ("sub", "both") for r in by[k] for c in r} | {c for a, _, b in by["right"] for c in (a, b)} | {c for _, a, b in by["left"] for c in (a, b)}
    facts = {(x, "", x) for x in names}
    while True:
        new = {(x, "", b) for x, p, a in facts if not p for c, b in by["sub"] if a == c}
        new |= {(x, "", b) for x, p, a in facts if not p for a1, a2, b in by["both"] if a == a1 and (x, "", a2) in facts}
        new |= {(x, q, b) for x, p, a in facts if not p for c, q, b in by["right"] if a == c}
        new |= {(x, "", b) for x, p, y in facts if p for q, a, b in by["left"] if p == q and (y, "", a) in facts}
        new |= {(x, "", NOTHING) for x, p, y in facts if p and (y, "", NOTHING) in facts}
        new |= {(x, q, y) for x, p, y in facts if p for r, q in by["sub_property"] if r == p}
        new |= {(x, r, z) for x, p, y in facts if p for y2, q, z in facts if q and y == y2 for p2, q2, r in by["chains"] if (p, q) == (p2, q2)}
        if new <= facts:
            return facts
        facts |= new


def facts_of(state):
    return {(r["x"], "", r["a"]) for r in state.implied.collect()} | {(r["x"], r["property"], r["y"]) for r in state.links.collect()}


def random_tables(rng, n=9, size=5, names="ABCDEFGHI"):
    pick = lambda: rng.choice(names[:n])
    prop = lambda: rng.choice("pqr")
    return {
        "sub": [(pick(), pick()) for _ in range(size)],
        "both": [(pick(), pick(), rng.choice([pick(), NOTHING])) for _ in range(3)],
        "right": [(pick(), prop(), pick()) for _ in range(4)],
        "left": [(prop(), pick(), pick()) for _ in range(3)],
        "sub_property": [("p", "q"), ("q", "r")] if rng.random() < 0.5 else [("p", "r")],
        "chains": [("p", "q", "r")],
    }


@pytest.mark.parametrize("seed", [2])
def test_classify_and_extend(spark, seed):
    rng = random.Random(seed)
    old, new = random_tables(rng), {k: v for k, v in random_tables(rng, size=2, names="ABCDEFXYZ").items() if k not in ("chains", "sub_property")}
    state = S.classify(frames(spark, old))
    assert facts_of(state) == plain(old)
    together = {k: old[k] + new.get(k, []) for k in old}
    assert facts_of(S.extend(state, frames(spark, new))) == plain(together)


def test_deep_chain_and_cycle(spark):
    sub = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("c40", "c38"), (None, "c1"), ("c1", None)]
    state = S.classify(frames(spark, {"sub": sub}))
    assert {(x, a) for x, _, a in facts_of(state)} == {(f"c{i}", f"c{j}") for i in range(41) for j in range(41) if j >= i or j >= 38 and i >= 38}


def test_contexts_are_separate(spark):
    """Organs, their parts and three taxa: what is empty where, both ways."""
    tables = {
        "sub": [("wing", "organ"), ("fin", "organ"), ("feather", "organ"), ("leg", "organ"), ("bird", "animal"), ("fish", "animal"), ("gull", "bird")],
        "right": [("wing", "in_taxon", "bird"), ("feather", "part_of", "wing"), ("fin", "in_taxon", "fish")],
        "left": [("in_taxon", "bird", "_b"), ("in_taxon", "fish", "_f")],
        "both": [("_b", "_f", NOTHING), ("leg", "_f", NOTHING)],
        "chains": [("part_of", "in_taxon", "in_taxon")],
    }
    state = S.classify(frames(spark, tables))
    taxa = spark.createDataFrame([("bird",), ("fish",), ("gull",), (None,)], "node string")
    got = {tuple(r) for r in S.outside(state, taxa, "in_taxon", "organ").collect()}
    assert got == {("bird", "fin"), ("gull", "fin"), ("fish", "wing"), ("fish", "feather"), ("fish", "leg")}
    got = {tuple(r) for r in S.outside(state, taxa, "in_taxon", "organ", only=False).collect()}
    assert got == {("bird", "wing"), ("bird", "feather"), ("fish", "fin")}


def minimal_sets(tables, goal):
    """All minimal sets of axioms that make goal empty."""
    axioms = [(k, *r) for k, v in tables.items() for r in set(v)]
    found = []
    for size in range(1, len(axioms) + 1):
        for some in itertools.combinations(axioms, size):
            if any(f <= set(some) for f in found):
                continue
            chosen = {k: [a[1:] for a in some if a[0] == k] for k in S.COLUMNS}
            chosen["sub"] = chosen["sub"] + [(goal, goal)]
            if (goal, "", NOTHING) in plain(chosen):
                found.append(set(some))
    return found


def test_explanations_are_minimal(spark):
    tables = {
        "sub": [("A", "B"), ("B", "C"), ("A", "C"), ("D", "E"), ("X", "A")],
        "right": [("C", "p", "D"), ("A", "q", "E")],
        "left": [("r", "E", "F")],
        "both": [("F", "C", NOTHING)],
        "sub_property": [("p", "r")],
    }
    state = S.classify(frames(spark, tables))
    goals = spark.createDataFrame([("A",), ("X",), ("B",), ("D",)], "node string")
    got = {r["node"]: {tuple(a.split("\t")) for a in r["axioms"]} for r in S.justified(state, goals).collect()}
    assert set(got) == {"A", "B", "X"}
    for node, axioms in got.items():
        assert axioms in minimal_sets(tables, node), (node, axioms)


def _zoo(spark):
    return S.classify(frames(spark, {
        "sub": [("wing", "organ"), ("fin", "organ"), ("flight", "movement"), ("gull", "bird"), ("bird flight", "flight"), ("sea flight", "bird flight"), ("sea", "place")],
        "right": [("wing", "in_taxon", "bird"), ("bird flight", "occurs_in", "wing"), ("sea flight", "occurs_in", "sea")],
        "left": [("in_taxon", "bird", "_b"), ("in_taxon", "fish", "_f"), ("occurs_in", "wing", "_w")],
        "both": [("_b", "_f", NOTHING), ("_w", "flight", "bird flight")],
    }))


def test_contradicting_annotations(spark):
    rows = [(1, "wing", "gull"), (2, "wing", "fish"), (3, "wing", "fish"), (4, "organ", "fish"), (5, None, "fish"), (6, "wing", None), (7, "unknown", "fish")]
    ann = spark.createDataFrame(rows, "annotation_id int, cls string, taxon string")
    state = _zoo(spark)
    assert {r["annotation_id"] for r in AR.contradictions(ann, state).collect()} == {2, 3}
    explained = AR.contradictions(ann, state, explain=True)
    want = {"left\tin_taxon\tbird\t_b", "left\tin_taxon\tfish\t_f", "both\t_b\t_f\tNothing", "right\twing\tin_taxon\tbird", "sub\t@4:wing|fish\twing", "right\t@4:wing|fish\tin_taxon\tfish"}
    assert {r["annotation_id"]: set(r["axioms"]) for r in explained.collect()} == {2: want, 3: want}
    assert {r["axiom"] for r in AR.empty_module(explained).collect()} == want


def test_fold_predictions(spark):
    rows = [("g1", "flight", "occurs_in", "wing"), ("g2", "flight", "occurs_in", "sea"), ("g3", "flight", "occurs_in", "wing"), ("g3", "bird flight", None, None), ("g4", "bird flight", "occurs_in", "sea"), ("g5", "movement", "occurs_in", "wing")]
    ann = spark.createDataFrame(rows, "bioentity string, cls string, property string, filler string")
    state = _zoo(spark)
    relevant = spark.createDataFrame([(c,) for c in ("flight", "bird flight", "sea flight", "movement", "place", "sea")], "node string")
    got = {tuple(r)[0:1] + tuple(r)[4:] for r in AR.fold_predictions(ann, state, relevant, ["occurs_in"]).collect()}
    # g1 says bird flight; g2 has only flight above, which it says already, and the sea as its place;
    # g3 has bird flight already; g4's content lies under bird flight; g5 says no class.
    assert got == {("g1", "bird flight", "equivalent"), ("g2", "sea", "occurs_in"), ("g4", "sea", "occurs_in")}


def test_empty_tables(spark):
    state = S.classify(frames(spark, {"sub": [], "right": []}))
    assert facts_of(state) == set()
    none = spark.createDataFrame([], "annotation_id int, cls string, taxon string")
    assert AR.contradictions(none, state, explain=True).collect() == []
