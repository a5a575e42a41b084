r"""Cross-site boilerplate lines, by distinct-site spread.

A line is keyed by two 64-bit hashes of its text without white space (blank, \t \v \f
\r) at its ends.  HyperLogLog sketches
of the sites that show a line merge by aggregation; lines whose estimate is
near the threshold get an exact distinct count, so the estimate's error decides
nothing.  A line on at least `min_sites` sites is boilerplate: its first
occurrence (smallest doc_id, then position) stays, every other one goes.

DataFrame functions only.  Null texts stay null with no lines; blank lines are
never removed; rows without site count for no site; rows without doc_id keep
their lines.  A row is known by its doc_id and text: repeated rows are one
occurrence, rows that share a doc_id alone are cut each by its own lines.  Extra
columns stay as they are, whatever their names, but n_lines and n_removed are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import BROADCAST_IDS, let, materialise, own_columns, table, unused

MIN_SITES = 10
#: Sketches of 2 ** LG_K registers err by about 1.04 / sqrt(2 ** LG_K) (7 %); BAND is over four times that.
LG_K, BAND = 8, 0.3
#: What a line's ends lose before it is compared.
_WHITE = " \t\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """One row a line with a word: doc_id, t (the text's hash), site, pos, h1, h2."""
    lines = docs.select("doc_id", F.xxhash64(text).alias("t"), F.col(site).alias("site"), F.posexplode(_lines(F.col(text))).alias("pos", "_line"))
    lines = lines.select("doc_id", "t", "site", "pos", F.btrim("_line", F.lit(_WHITE)).alias("_line")).where("_line != ''")
    return lines.select("doc_id", "t", "site", "pos", F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit("second"), "_line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines on at least min_sites sites, with their first occurrence (doc_id, pos, t)."""
    keys = line_keys(docs)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos", "t"))).alias("first")
    sketched = keys.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("_sites"), F.count(F.lit(1)).alias("n"), first)
    # A line can't be on more sites than it has occurrences.
    near = F.hll_sketch_estimate("_sites")
    lines = materialise(sketched.where((F.col("n") >= min_sites) & (near >= min_sites * (1 - BAND))).select("h1", "h2", near.alias("estimate"), "first"), "lines")
    sure = lines.where(F.col("estimate") > min_sites * (1 + BAND))
    unsure = lines.where(F.col("estimate") <= min_sites * (1 + BAND))
    n_unsure = unsure.count()
    seen = keys.join(F.broadcast(unsure.select("h1", "h2")) if n_unsure <= BROADCAST_IDS else unsure.select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = seen.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return materialise(sure.select("h1", "h2", "first").union(unsure.join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "boilerplate")


def removed_positions(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, t and the positions of the row's lines that go, in order."""
    lines = boilerplate(docs, min_sites)
    small = lines.count() <= BROADCAST_IDS
    hit = line_keys(docs).where("doc_id is not null").join(F.broadcast(lines) if small else lines, ["h1", "h2"])
    hit = hit.where(~(F.struct("doc_id", "pos", "t") == F.col("first")))
    return hit.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def _cut(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions gone (ascending): the runs of lines between them."""

    def runs(x: Column) -> Column:
        lines, at = x["lines"], x["at"]
        begin = lambda j: F.when(j == 0, 0).otherwise(F.get(at, j - 1) + 1)
        end = lambda j: F.coalesce(F.get(at, j), F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j)))), "\n")

    return let(F.struct(_lines(text).alias("lines"), gone.alias("at")), runs)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines cut out of text, plus n_lines and n_removed."""
    gone = removed_positions(own_columns(docs, "doc_id", "text", "source"), min_sites)
    d, t, at = (unused(docs, x) for x in ("_d", "_t", "_gone"))
    gone = gone.select(F.col("doc_id").alias(d), F.col("t").alias(t), F.col("gone").alias(at))
    out = docs.join(gone, (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col(at)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    names = [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*names, n_lines.alias("n_lines"), F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long").alias("n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs, same columns, without boilerplate lines; documents that lose every word go, n_chars is counted anew."""
    names = {c: f"c{i}" if c not in ("doc_id", "text", "source") else c for i, c in enumerate(docs.columns)}  # no name of docs is replaced
    cut = dedup_lines(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), min_sites)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        n = names["n_chars"]
        cut = cut.withColumn(n, F.when(F.col("n_removed") == 0, F.col(n)).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(n).alias(c) for c, n in names.items()])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP3_SQL = f"""
WITH split AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, source, i - 1 AS pos, parts[i] AS raw, trim(parts[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)
), wide AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, (w.line IS NOT NULL AND (l.doc_id, l.pos) <> w.first) AS gone
  FROM lines l LEFT JOIN wide w ON l.line = w.line
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY doc_id
"""
