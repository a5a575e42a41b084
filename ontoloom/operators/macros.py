"""Macros: properties whose annotations say what restrictions and assertions with them stand for.

A template is a line of Manchester syntax over class names, some, only, value, min,
max, exactly, and, or, not and brackets, with ?Y for the filler of a restriction
(?X and ?Y for the ends of an assertion).  Templates are parsed once each, to rows of
expressions whose ids are their functional-style texts with the variables in
them; expanding is a join that puts names in.  Templates that use other macros are
expanded until none is left; templates that lead back to themselves are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.operators import closure as C
from ontoloom.plans.session import settle, ship_package
from ontoloom.sources.owl_xml import FUNCTIONAL

ROWS = "root string, rows array<struct<id:string,kind:string,property:string,filler:string,n:int>>"
_WORDS = {"some": "some", "only": "only", "value": "value", "min": "min", "max": "max", "exactly": "exact"}
_FRAME = re.compile(r"^\s*Class:\s*(\S+)\s+(SubClassOf|EquivalentTo|DisjointWith):\s*(.+)$", re.S)


def parsed(text: str) -> tuple[str, list[tuple]]:
    """The id of a class expression in Manchester syntax, and its rows (id, kind, property, filler, n)."""
    tokens, rows, at = re.findall(r"[()]|[^\s()]+", text), [], 0

    def take(*wanted: str) -> str | None:
        nonlocal at
        if at < len(tokens) and (not wanted or tokens[at] in wanted):
            at += 1
            return tokens[at - 1]
        if not wanted:
            raise ValueError(f"{text!r} ends too early")
        return None

    def kept(kind: str, prop: str | None, operands: list[str], n: int | None = None) -> str:
        name = f"{FUNCTIONAL[kind]}({' '.join([*([str(n)] if n is not None else []), *([prop] if prop else []), *operands])})"
        rows.extend((name, kind, prop, f, n) for f in operands)
        return name

    def unit() -> str:
        if take("("):
            inside = union()
            if not take(")"):
                raise ValueError(f"{text!r} lacks a bracket")
            return inside
        if take("not"):
            return kept("not", None, [unit()])
        name = take()
        word = take(*_WORDS)
        if not word:
            return name
        n = int(take()) if word in ("min", "max", "exactly") else None
        return kept(_WORDS[word], name, [unit()], n)

    def joined(word: str, kind: str, below) -> str:
        parts = [below()]
        while take(word):
            parts.append(below())
        return parts[0] if len(parts) == 1 else kept(kind, None, parts)

    def union() -> str:
        return joined("or", "or", lambda: joined("and", "and", unit))

    root = union()
    if at < len(tokens):
        raise ValueError(f"{text!r} goes on after its end")
    return root, rows


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for prop, text in zip(batch["property"], batch["text"], strict=True):
            frame = _FRAME.match(text)
            root, rows = parsed(frame[3] if frame else text)
            out.append((prop, frame[1] if frame else None, frame[2] if frame else None, root, [dict(zip(("id", "kind", "property", "filler", "n"), r, strict=True)) for r in rows]))
        yield pd.DataFrame(out, columns=["property", "subject", "axiom", "root", "rows"])


def templates(texts: DataFrame) -> DataFrame:
    """(property, subject, axiom, root, rows) of texts (property, text); subject and axiom are null unless a text begins with Class:."""
    ship_package(texts.sparkSession)
    rows = texts.select("property", "text").na.drop().distinct()
    return settle(rows.mapInPandas(_read, f"property string, subject string, axiom string, {ROWS}"), "templates")


def _put(c: Column, names: dict[str, Column]) -> Column:
    for variable, name in names.items():
        c = F.replace(c, F.lit(variable), name)
    return c


def _instances(uses: DataFrame, names: dict[str, Column]) -> DataFrame:
    """Expression rows of uses (with rows and columns for names)."""
    x = F.col("_r")
    each = uses.withColumn("_r", F.explode("rows"))
    return each.select(*[(_put(x[c], names) if c in ("id", "filler") else x[c]).alias(c) for c in ("id", "kind", "property", "filler", "n")]).distinct()


def expand_expressions(axioms: DataFrame, expressions: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """axioms (sub, sup) and expressions with each `property some filler` of a macro property (texts: property, text) replaced by its template."""
    known = templates(texts)
    nested = known.select("property", F.explode("rows").alias("r")).where("r.kind = 'some'").select(F.col("property").alias("source"), F.col("r.property").alias("target"))
    inner = nested.join(known.select(F.col("property").alias("target")), "target", "left_semi")
    if not C.on_cycles(inner).isEmpty():
        raise ValueError("a template leads back to itself")
    ex = expressions.select("id", "kind", "property", "filler", "n").distinct()
    ax = axioms.select("sub", "sup").na.drop().distinct()
    while True:
        ex = settle(ex, "expressions")
        uses = settle(ex.where("kind = 'some'").select("id", "property", "filler").join(known.select("property", "root", "rows"), "property"), "uses")
        if uses.isEmpty():
            return ax, ex
        new = _instances(uses, {"?Y": F.col("filler")})
        other = settle(uses.select("id", _put(F.col("root"), {"?Y": F.col("filler")}).alias("_to")), "renamed")

        def renamed(df: DataFrame, column: str, other=other) -> DataFrame:
            to = other.select(F.col("id").alias(column), "_to")
            return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        every = ex.join(other, "id", "left_anti").unionByName(new).distinct()
        ex = renamed(every, "filler").select("id", "kind", "property", "filler", "n")
        ax = settle(renamed(renamed(ax, "sub"), "sup").select("sub", "sup").distinct(), "axioms")


def expand_assertions(assertions: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject, axiom, object) and their expressions, of assertions (x, property, y) whose property has a template of the form `Class: ?X SubClassOf: ...`."""
    known = templates(texts).where("axiom is not null")
    uses = settle(assertions.select("x", "property", "y").na.drop().distinct().join(known, "property"), "uses")
    names = {"?X": F.col("x"), "?Y": F.col("y")}
    out = uses.select(_put(F.col("subject"), names).alias("subject"), "axiom", _put(F.col("root"), names).alias("object")).distinct()
    return out, _instances(uses, names)
