"""How the sources of a language differ in their words: sorted runs, document frequencies, divergences.

Each task counts the terms of its documents by (lang, source) and hands on rows
(lang, term, source, document, df, n), where document is the first of those that
the row counts: a term's rows grow with tasks, not with documents.  Rows are
dealt by (lang, term) and sorted by (lang, term, source, document); one scan over
the sorted rows adds up the runs and gives the document frequency and count of
each term in each source.  A second scan over the runs of kept terms gives
partial sums for pairs of sources, a third plain pass the leading terms.

The sum for two sources runs over all kept terms.  Most terms are missing from
one of them or both, so with o the value where both lack a term it is written as
V o + (terms of a: f(a, none of b) - o) + (terms of b: likewise) + (terms of both: the rest).
The second and third part need only how often each probability occurs in a
source, the last only terms that both have.

Probabilities are whole billionths and all arithmetic is exact (decimals of 38
digits where counts are multiplied).  Null text, lang and source are ''.  Repeated
rows count each, also those that share a doc_id.  An empty table gives no rows;
extra columns are left out.  A language without kept terms gives pairs of value 0.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.common import materialise, own_columns, ship_package, table

LEAST_DOCS = 10
TOP = 10
#: Groups (lang, source) up to this many rows are broadcast (about 10 MB); more are shuffled.
BROADCAST_GROUPS = 100_000
#: Terms that a task holds before it hands them on, pairs of sources that a scan makes at a time, rows and bytes of an Arrow batch.
HELD_TERMS = 200_000
HELD_PAIRS = 1_000_000
BATCH_ROWS = 10_000
BATCH_BYTES = 1 << 20
#: Letters stay, A-Z in lower case, all bytes of other characters stay, the rest parts terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
RUNS = "lang string, term string, source string, document long, df long, n long"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, document, text) -> RUNS of the task's documents."""
    df: dict[tuple, Counter] = {}
    n: dict[tuple, Counter] = {}
    first: dict[tuple, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for key, counts in n.items():
            for i in range(0, len(counts), 20_000):
                terms = list(counts)[i : i + 20_000]
                k = len(terms)
                columns = [pa.array([key[0]] * k), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([key[1]] * k)]
                numbers = [np.full(k, first[key], np.int64), np.fromiter(map(df[key].__getitem__, terms), np.int64, k), np.fromiter(map(counts.__getitem__, terms), np.int64, k)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, numbers)], names=["lang", "term", "source", "document", "df", "n"])
        df.clear(), n.clear(), first.clear()

    for batch in batches:
        for lang, source, document, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "document", "text")), strict=True):
            key = (lang, source)
            if key not in n:
                df[key], n[key], first[key] = Counter(), Counter(), document
            words = terms_of(text)
            n[key].update(words)
            df[key].update(set(words))
        if sum(map(len, n.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def _changes(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """Places where a row differs from the one before it, 0 among them."""
    differs = np.zeros(len(batch), bool)
    differs[:1] = True
    for name in names:
        column = batch.column(name)
        differs[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the runs of sorted RUNS; a run that a batch ends in waits for the next batch."""
    names = ["lang", "term", "source", "df", "n"]
    held = None
    for batch in filter(len, batches):
        batch = batch.select(names)
        batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
        at = _changes(batch, "lang", "term", "source")
        sums = [np.add.reduceat(batch.column(c).to_numpy(), at) for c in ("df", "n")]
        keys = [batch.column(c).take(pa.array(at)) for c in names[:3]]
        made = pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums)], names=names)
        held = made.slice(len(made) - 1)
        if len(made) > 1:
            yield made.slice(0, len(made) - 1)
    if held is not None:
        yield held


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, term, g, p, p0) -> (a, b, value): for groups g that share terms, the sums that their shared terms add."""
    held = None

    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(batch):
            return
        at = _changes(batch, "lang", "term")
        ends = np.repeat(np.append(at[1:], len(batch)), np.diff(np.append(at, len(batch))))
        g, p, p0 = (batch.column(c).to_numpy() for c in ("g", "p", "p0"))
        later = ends - np.arange(len(batch)) - 1  # rows of the same term after a row
        done, total = 0, np.cumsum(later)
        while done < len(batch):
            base = total[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(total, base + HELD_PAIRS, side="right")))
            count = later[done:stop]
            left = np.repeat(np.arange(done, stop), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            done = stop
            if not len(left):
                continue
            x = values(p[left], p[right]) - values(p[left], p0[right]) - values(p0[left], p[right]) + values(p0[left], p0[right])
            known, code = np.unique(np.concatenate([g[left], g[right]]), return_inverse=True)
            a, b = np.minimum(code[: len(left)], code[len(left) :]), np.maximum(code[: len(left)], code[len(left) :])
            both, which = np.unique(a * len(known) + b, return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, which, x)
            yield pa.RecordBatch.from_arrays([pa.array(known[both // len(known)]), pa.array(known[both % len(known)]), pa.array(sums)], names=["a", "b", "value"])

    for batch in filter(len, batches):
        batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
        last = int(_changes(batch, "lang", "term")[-1])
        yield from pairs(batch.slice(0, last))
        held = batch.slice(last)  # one term's rows, at most one a source
    if held is not None:
        yield from pairs(held)


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept))."""
    wide = lambda c: c.cast("decimal(24,0)")
    return F.call_function("div", wide(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), F.nullif(wide(total) + wide(kept) * 2, F.lit(0).cast("decimal(24,0)"))) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_GROUPS else small


def term_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, df, n): in how many documents of a source a term stands, and how often."""
    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")), F.monotonically_increasing_id().alias("document"))
    dealt = rows.mapInArrow(_local, RUNS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return materialise(dealt.mapInArrow(_scanned, "lang string, term string, source string, df long, n long"), "term-runs")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` ranks a source's divergence from each other one of its language, `term` its most overused terms."""
    docs = own_columns(docs, "lang", "source", "text")
    spark = docs.sparkSession
    runs = term_runs(docs)
    mine = Window.partitionBy("lang", "term")
    kept = runs.withColumn("_df", F.sum("df").over(mine)).withColumn("n_lang", F.sum("n").over(mine)).where(F.col("_df") >= least)
    kept = materialise(kept.select("lang", "term", "source", "n", "n_lang"), "kept-terms")
    langs = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    known = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    known = known.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "v", "total_lang")))
    groups = materialise(known.select("*", _p(none, F.col("total"), F.col("v")).alias("p0"), F.monotonically_increasing_id().alias("g")), "groups")
    n_groups = groups.count()
    rows = kept.join(_sized(groups, n_groups), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "g", "p0", _p(F.col("n"), F.col("total"), F.col("v")).alias("p"), _p(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    rows = materialise(rows, "probabilities")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    shared = rows.select("lang", "term", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "g").mapInArrow(_paired, "a long, b long, value long")
    few = groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("p0_b"))
    alone = rows.groupBy("lang", F.col("g").alias("a"), "p0", "p").agg(F.count(F.lit(1)).alias("m")).join(_sized(few, n_groups), "lang").where("a <> b")
    alone = alone.groupBy("a", "b").agg(F.sum(F.col("m") * (_f(F.col("p"), F.col("p0_b")) - _f(F.col("p0"), F.col("p0_b")))).alias("value"))
    both_ways = lambda df: df.select("a", "b", "value").union(df.select("b", "a", "value"))
    added = both_ways(shared).union(both_ways(alone)).groupBy("a", "b").agg(F.sum("value").alias("_added"))
    left = groups.select("lang", "source", F.col("g").alias("a"), F.col("p0").alias("_p"), "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("p0").alias("_q"))
    base = F.coalesce(F.col("v") * _f(F.col("_p"), F.col("_q")), none)
    pair = left.join(_sized(right, n_groups), "lang").where("a <> b").join(added, ["a", "b"], "left").select("lang", "source", "item", (base + F.coalesce("_added", none)).alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(best))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part(pair, "pair").union(part(over, "term"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_DIV = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
_P = lambda n, total: f"1 + CAST(1000000000 AS HUGEINT) * ({n} + 2) // ({total} + 2 * v)"
OP11_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') AS words FROM documents),
w AS (SELECT lang, source, doc, unnest(words) AS term FROM d),
per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n_lang FROM per GROUP BY ALL HAVING sum(df) >= {LEAST_DOCS}),
size AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
grp AS (SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(s.total_lang, 0) AS total_lang, coalesce((SELECT sum(n) FROM per JOIN kept USING (lang, term) WHERE per.lang = g.lang AND per.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) AS g LEFT JOIN size AS s USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(per.n, 0) AS n, {_P("coalesce(per.n, 0)", "g.total")} AS p, {_P("k.n_lang", "g.total_lang")} AS q
  FROM grp AS g JOIN kept AS k USING (lang) LEFT JOIN per ON per.lang = g.lang AND per.source = g.source AND per.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_DIV("a.p", "b.p")}) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, {_DIV("p", "q")} AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
  UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
