"""Column functions for the nested string columns of annotation files; null and empty strings give empty arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Qualifiers in bit order 1, 2, 4, 8, 16.
QUALIFIERS = ("NOT", "contributes_to", "colocalizes_with", "integral_to", "CUT")
#: Aspect letter to relation.
RELATIONS = {"F": "enables", "P": "involved_in", "C": "part_of"}


def parts(c: Column, separators: str = r"[|]") -> Column:
    """Non-empty trimmed pieces."""
    pieces = F.filter(F.transform(F.split(c, separators), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) != "", pieces).otherwise(F.array().cast("array<string>"))


def qualifier_flags(c: Column) -> Column:
    """Bit mask of the known qualifiers, whatever their case; separators are | and , and an underscore may be a blank or a hyphen."""
    text = F.lower(c)
    # One search of the whole text a qualifier: a row has no pieces of its own.
    said = lambda q: text.rlike(r"(?:^|[|,]) *" + q.lower().replace("_", "(?:_|[ -]+)") + r" *(?:\z|[|,])")
    flags = sum((F.when(said(q), 1 << i).otherwise(0) for i, q in enumerate(QUALIFIERS[1:], 1)), F.when(said(QUALIFIERS[0]), 1).otherwise(0))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(flags).cast("int")


def unknown_qualifiers(c: Column) -> Column:
    known = [q.lower() for q in QUALIFIERS]
    return F.filter(parts(c, r"[|,]"), lambda x: ~F.regexp_replace(F.lower(x), r"[ -]+", "_").isin(known))


def relation(aspect: Column, qualifier: Column) -> Column:
    """The relation of an annotation: by aspect, unless a qualifier says contributes_to or colocalizes_with."""
    flags = qualifier_flags(qualifier)
    by_aspect = F.when(aspect == "F", RELATIONS["F"]).when(aspect == "P", RELATIONS["P"]).when(aspect == "C", RELATIONS["C"])
    return F.when(flags.bitwiseAND(2) > 0, "contributes_to").when(flags.bitwiseAND(4) > 0, "colocalizes_with").otherwise(by_aspect)


def extensions(c: Column) -> Column:
    """array<array<struct<relation,cls>>>: | parts alternatives, a comma joint conditions, each rel(cls); others are dropped."""
    one = lambda x: F.struct(F.regexp_extract(x, r"^([^()]+)\((.*)\)$", 1).alias("relation"), F.regexp_extract(x, r"^([^()]+)\((.*)\)$", 2).alias("cls"))
    group = lambda g: F.filter(F.transform(parts(g, ","), one), lambda s: s["relation"] != "")
    groups = F.filter(F.transform(parts(c), group), lambda g: F.size(g) > 0)
    return F.when(F.coalesce(c, F.lit("")) != "", groups).otherwise(F.array().cast("array<array<struct<relation:string,cls:string>>>"))


def extension_text(c: Column) -> Column:
    """The inverse of extensions()."""
    return F.array_join(F.transform(c, lambda g: F.array_join(F.transform(g, lambda s: F.concat(s["relation"], F.lit("("), s["cls"], F.lit(")"))), ",")), "|")


def taxon_pair(c: Column) -> Column:
    """struct<taxon,interacting> of taxon:1|taxon:2."""
    ids = parts(c)
    return F.struct(F.get(ids, F.lit(0)).alias("taxon"), F.get(ids, F.lit(1)).alias("interacting"))


def id_space(c: Column) -> Column:
    """The prefix before the first colon; null without one."""
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1))
