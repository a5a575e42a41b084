"""Queries with variables, modules and trees against plain versions."""

import itertools
import random

import pytest

from ontoloom.operators import class_queries as Q
from ontoloom.operators import saturation as S
from ontoloom.operators import trees as T


@pytest.fixture(scope="module")
def zoo(spark):
    sub = [("gull", "bird"), ("hen", "bird"), ("bird", "animal"), ("fish", "animal"), ("Vogel", "bird"), ("bird", "Vogel")]
    right = [("bird", "has", "wing"), ("wing", "has", "feather"), ("hen", "lays", "egg")]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    return S.classify({"sub": frame(sub, "a b"), "right": frame(right, "a property b"), "both": frame([("bird", "fish", "Nothing")], "a1 a2 b"), "chains": frame([("has", "has", "has")], "p q result")})


def test_ask(spark, zoo):
    rows = lambda *atoms, **more: {tuple(r) for r in Q.ask(list(atoms), zoo, **more).collect()}
    assert rows(("subclass", "?x", "animal"), ("some", "?x", "lays", "?y")) == {("hen", "egg")}
    got = Q.ask([("direct", "?x", "?y"), ("some", "?x", "has", "feather")], zoo)
    assert {(r["x"], r["y"]) for r in got.collect()} == {("gull", "bird"), ("gull", "Vogel"), ("hen", "bird"), ("hen", "Vogel"), ("bird", "animal"), ("Vogel", "animal")}
    assert {r["x"] for r in Q.ask([("direct_some", "?x", "has", "feather")], zoo).collect()} == {"bird", "Vogel", "wing"}
    assert rows(("equivalent", "?x", "?x2"), ("strict", "hen", "?x")) == {("bird", "Vogel"), ("Vogel", "bird")}
    assert rows(("strict", "?x", "?x")) == set() and rows(("subclass", "?x", "?x"), ("subclass", "fish", "bird")) == set()
    assert rows(("disjoint", "?x", "fish"), ("direct", "?x", "bird")) == {("gull",), ("hen",)}
    types = spark.createDataFrame([("tom", "gull"), ("ann", "hen")], "individual string, cls string")
    facts = spark.createDataFrame([("tom", "likes", "ann"), ("ann", "likes", "ann")], "a string, property string, b string")
    assert rows(("type", "?i", "bird"), ("value", "?i", "likes", "?j"), ("type", "?j", "hen"), types=types, facts=facts) == {("tom", "ann"), ("ann", "ann")}
    with pytest.raises(ValueError, match="share no variable"):
        Q.ask([("strict", "?x", "bird"), ("strict", "?y", "bird")], zoo)
    with pytest.raises(ValueError, match="takes 3 names"):
        Q.ask([("some", "?x", "bird")], zoo)


def plain_module(axioms, expressions, names):
    by = {}
    for i, kind, prop, filler, n in expressions:
        by.setdefault(i, []).append((kind, prop, filler, n))

    def can(x, sig):
        if x not in by:
            return x in sig
        kind = by[x][0][0]
        each = [can(f, sig) for _, _, f, _ in by[x]]
        if kind in ("some", "and", "value", "min"):
            return all(each) and all(p is None or p in sig for _, p, _, _ in by[x])
        return any(each) if kind == "or" else True

    def inside(x):
        return {x} | {y for _, p, f, _ in by.get(x, []) for y in [*inside(f), *([p] if p else [])]}

    sig, out = set(names), set()
    while True:
        more = {a for a in axioms if can(a[0], sig)} - out
        if not more:
            return out
        out |= more
        sig |= {y for a in more for e in a for y in inside(e)}


def test_module(spark):
    expressions = [("e1", "some", "p", "B", None), ("e2", "and", None, "A", None), ("e2", "and", None, "e1", None), ("e3", "or", None, "X", None), ("e3", "or", None, "C", None), ("e4", "only", "q", "Y", None), ("e5", "min", "p", "e3", 2)]
    axioms = [("A", "D"), ("D", "e1"), ("e2", "E"), ("E", "F"), ("e3", "G"), ("e4", "H"), ("X", "Z"), ("e5", "K"), ("K", "L"), ("B", "C"), ("U", "V")]
    ax = spark.createDataFrame([*axioms, (None, "A"), ("A", "D")], "sub string, sup string")
    ex = spark.createDataFrame(expressions, "id string, kind string, property string, filler string, n int")
    for names in (["A"], ["U"], ["E"], ["X", "p"]):
        sig = spark.createDataFrame([(n,) for n in names], "node string")
        assert {tuple(r) for r in Q.local_module(ax, ex, sig).collect()} == plain_module(axioms, expressions, names), names


def random_tree(rng, depth=0):
    """(text, nested) of a tree; every node has a name, a length and a mark of duplication or not."""
    name, length, dup = f"n{rng.randint(0, 10**6)}", rng.randint(0, 8) / 4, rng.random() < 0.4
    below = [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 3))] if depth < 4 and rng.random() < (1 if depth == 0 else 0.6) else []
    text = ("(" + ",".join(t for t, _ in below) + ")" if below else "") + f"{name}:{length}" + ("[&&NHX:D=Y]" if dup else "")
    return text, (name, length, dup, [n for _, n in below])


def test_trees(spark):
    rng = random.Random(9)
    made = {i: random_tree(rng) for i in range(5)}
    nodes = T.parse(spark.createDataFrame([*((i, t + ";") for i, (t, _) in made.items()), (7, None), (8, "")], "tree_id int, text string")).cache()
    facts, ways = {}, {}

    def go(i, node, up, depth):
        name, length, dup, below = node
        facts[i, name] = (len(up), length, dup, depth + length, not below)
        ways[i, name] = [*up, name]
        for b in below:
            go(i, b, [*up, name], depth + length)

    for i, (_, node) in made.items():
        go(i, node, [], 0.0)
    rows = T.depths(nodes).collect()
    assert {(r["tree_id"], r["name"]): (r["level"], r["length"], r["duplication"], r["depth"], r["begin"] == r["node"]) for r in rows} == facts
    name = {(r["tree_id"], r["node"]): r["name"] for r in rows}
    at = {(t, n): k for (t, k), n in name.items()}
    got = {(r["tree_id"], name[r["tree_id"], r["node"]], name[r["tree_id"], r["ancestor"]]) for r in T.ancestors(nodes).collect()}
    assert got == {(i, n, a) for (i, n), way in ways.items() for a in way[:-1]}
    pairs = [(i, at[i, a], at[i, b]) for i in made for a, b in itertools.product([n for t, n in ways if t == i], repeat=2)]
    found = T.distances(spark.createDataFrame(pairs, "tree_id int, a int, b int"), nodes).collect()
    assert len(found) == len(pairs)
    for r in found:
        i, a, b = r["tree_id"], name[r["tree_id"], r["a"]], name[r["tree_id"], r["b"]]
        meet = [x for x, y in zip(ways[i, a], ways[i, b], strict=False) if x == y][-1]
        assert name[i, r["meet"]] == meet and abs(r["distance"] - (facts[i, a][3] + facts[i, b][3] - 2 * facts[i, meet][3])) < 1e-9
    leaf = next(n for (i, n), f in facts.items() if i == 0 and f[4])
    kin = {(r["relative"], r["how"]) for r in T.relatives(spark.createDataFrame([(leaf,)], "name string"), nodes).collect()}
    want = set()
    for (i, n), f in facts.items():
        if i == 0 and f[4] and n != leaf:
            meet = [x for x, y in zip(ways[0, leaf], ways[0, n], strict=False) if x == y][-1]
            want.add((n, "paralogue" if facts[0, meet][2] else "orthologue"))
    assert kin == want
