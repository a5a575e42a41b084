"""Walks over short, long and cyclic graphs against a plain search."""

import random
from collections import deque

import pytest

from ontoloom.operators import closure as C


def search(edges, seed):
    out, queue = {}, deque([(seed, 0)])
    while queue:
        node, n = queue.popleft()
        for a, b in edges:
            if a == node and b not in out:
                out[b] = n + 1
                queue.append((b, n + 1))
    return out


@pytest.fixture(params=[(8, 3), (1, 1), (2, 0)], ids=["plain", "jumps", "jumps at once"])
def paces(request, monkeypatch):
    monkeypatch.setattr(C, "HOPS", request.param[0])
    monkeypatch.setattr(C, "SHORT", request.param[1])


def test_walk(spark, paces):
    rng = random.Random(4)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("c30", "c25"), ("c9", "c9"), (None, "c1"), ("c1", None)]
    edges += [(f"c{rng.randint(0, 30)}", f"d{rng.randint(0, 5)}") for _ in range(12)] + [("d1", "c4"), ("x", "y")]
    df = spark.createDataFrame(edges * 2, "source string, target string")
    clean = [e for e in set(edges) if None not in e]
    seeds = ["c0", "d1", "y", "nowhere"]
    frame = spark.createDataFrame([(s,) for s in [*seeds, None, "c0"]], "node string")
    got = {(r["seed"], r["node"], r["distance"]) for r in C.walk(df, frame).collect()}
    assert got == {(s, n, k) for s in seeds for n, k in search(clean, s).items()}
    down = {(r["seed"], r["node"], r["distance"]) for r in C.walk(df, frame, down=True).collect()}
    assert down == {(s, n, k) for s in seeds for n, k in search([(b, a) for a, b in clean], s).items()}
    assert {r["node"] for r in C.reached(df, frame).collect()} == {n for s in seeds for n in [s, *search(clean, s)]}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "settle", lambda df, label, settle=C.settle: rounds.append(label) or settle(df, label))
    assert C.ancestors(spark.range(1000).selectExpr("id as source", "id + 1 as target"), 0).count() == 1000
    assert rounds.count("walk") <= 12  # the first is the start


def test_empty(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert C.ancestors(none, "a").collect() == [] and C.reached(none, none.selectExpr("source as node")).collect() == []
