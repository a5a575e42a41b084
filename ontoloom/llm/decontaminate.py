"""Benchmark decontamination by templates.

Numbers, units after a number, and names (capitalised words inside a sentence)
become typed placeholders, after white space is made one blank; the other words
are lower-cased.  Windows of tokens
(WINDOW of them, fewer for short items, see size_of) of the benchmark items are
hash-joined with those of the documents.  Matched windows count together if
their shifts (place in the document less place in the item) differ by at most
BAND, so that text may be put in, left out or resized between them.  A document
holds an item if they cover enough of its tokens (see needed: half, with a floor
for short items that one edited word can't break, and LONG at most), and the
slots of matched windows are consistent: equal item values answer equal document
values, and among names the other way round too (two numbers may become equal).
Equal values mean a copy, others a re-parameterised one.

Each window also counts by its plain lower-cased words, so that a verbatim copy
is found whatever its slots are; the template of a window with too few ordinary
words is no evidence.

DataFrame functions only.  Null and empty texts and items match nothing;
repeated rows count once; rows that share a doc_id (or null for one) or an
item_id are searched each by its own text.  Extra columns are left alone, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.llm.common import BROADCAST_IDS, let, materialise, own_columns, table, unused

WINDOW, SHARE = 5, 0.5
#: Windows that begin in so many tokens are made together, so a long text needs no array of all its windows.
BLOCK = 4096
#: White space other than the blank.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Items under SHORT tokens count only as a whole.
SHORT = 8
#: Covered tokens that suffice however long the item is; and the floor for short items.
LONG, FLOOR = 32, 12
#: Shifts up to this far apart are one place of an item.
BAND = 64
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"  # private-use characters, which texts lose first
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|miles?|met(?:er|re)s?|inch(?:es)?|feet|foot|yards?|litres?|liters?|ml|l|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|percent|degrees?|mph|kmh|kg|tons?"

def marked(text: Column) -> Column:
    """The text with a marker before each number, unit and name, its words parted by one space, punctuation dropped.

    The patterns look at the character ahead before those behind, which most places fail at once.
    """
    blank = NUMBER + UNIT + NAME + SPACES
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), blank, " " * len(blank)), "  +", " ")
    out = F.regexp_replace(out, r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)", NAME + "$1")
    out = F.regexp_replace(out, r"(?=\d)(?<![\p{L}\p{N}])(\d+(?:[.,:/]\d+)*)", NUMBER + "$1")
    out = F.regexp_replace(out, rf"({NUMBER}\d+(?:[.,:/]\d+)*) ?({UNITS})(?![\p{{L}}\p{{N}}])", "$1 " + UNIT + "$2")
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{UNIT}{NAME}.,:/]+|[.,:/]+(?!\d)|(?<!\d)[.,:/]+", " ")
    return F.lower(F.trim(out))


def template(marked_text: Column) -> Column:
    """Typed placeholders instead of the marked values."""
    return F.regexp_replace(marked_text, rf"([{NUMBER}{UNIT}{NAME}])[^ ]+", "$1")


def size_of(n: Column) -> Column:
    """Tokens in a window of an item of n tokens."""
    return F.when(n < SHORT, n).when(n < 11, 3).when(n < 13, 4).otherwise(WINDOW)


def needed(n: Column) -> Column:
    """Tokens of an item of n that must be covered; an edited word uncovers at most size_of(n)."""
    return F.when(n < SHORT, n).otherwise(F.least(F.lit(LONG), F.greatest(F.ceil(SHARE * n).cast("int"), F.least(n - size_of(n), F.lit(FLOOR)))))


def _hashes(words: Column) -> Column:
    return F.transform(F.split(words, " "), lambda t: F.xxhash64(t))


def hashed(text: Column) -> Column:
    """Struct of the hashes of the words (p) and of the template's tokens (t; empty if the text has no slot), which stand at the same places."""

    def of_marked(m: Column) -> Column:
        plain = F.translate(m, NUMBER + UNIT + NAME, "")
        return F.struct(_hashes(plain).alias("p"), F.when(F.length(plain) < F.length(m), _hashes(template(m))).otherwise(F.array().cast("array<bigint>")).alias("t"))

    return let(marked(text), of_marked)


def _blocks(pair: Column, longest: int) -> Column:
    """Array of (at, p, t): BLOCK tokens of a text from place at, and as many more as windows that begin in them reach over."""
    cut = lambda of, i: F.slice(of, i + 1, BLOCK + longest - 1)
    return let(pair, lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h["p"]) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.struct(i.alias("at"), cut(h["p"], i).alias("p"), cut(h["t"], i).alias("t"))))


def _windows(pair: Column, sizes: list[int]) -> Column:
    """Array of (pos, hash, values): each window of words that begins in the first BLOCK, and with the hashes of its words each one of the template that has a slot."""

    def of_size(h: Column, size: int) -> Column:
        p, t = h["p"], h["t"]
        n = F.size(p)
        last = F.least(n - size, F.lit(BLOCK - 1))
        none = F.array().cast("array<struct<pos:int,hash:bigint,values:array<bigint>>>")

        def window(of: Column, i: Column, values: Column) -> Column:
            return F.struct(i.alias("pos"), F.xxhash64(*[F.get(of, i + j) for j in range(size)]).alias("hash"), values.alias("values"))

        plain = F.transform(F.sequence(F.lit(0), last), lambda i: window(p, i, F.lit(None).cast("array<bigint>")))
        slots = F.filter(F.sequence(F.lit(0), F.least(n, last + size) - 1), lambda k: F.get(t, k) != F.get(p, k))
        starts = F.array_distinct(F.flatten(F.transform(slots, lambda k: F.sequence(F.greatest(k - (size - 1), F.lit(0)), F.least(k, last)))))
        typed = F.when(F.size(t) > 0, F.transform(starts, lambda i: window(t, i, F.slice(p, i + 1, size)))).otherwise(none)
        return F.when(n >= size, F.concat(plain, typed)).otherwise(none)

    return let(pair, lambda h: F.concat(*[of_size(h, size) for size in sizes]))


def _all_windows(texts: DataFrame, pair: Column, sizes: list[int], *keep: str) -> DataFrame:
    """keep, pos, hash, values: the windows of each row's text."""
    blocks = texts.select(*keep, F.inline(_blocks(pair, max(sizes))))
    found = blocks.select(*keep, "at", F.inline(_windows(F.struct("p", "t"), sizes)))
    return found.select(*keep, (F.col("at") + F.col("pos")).alias("pos"), "hash", "values")


def _consistent(slots: Column) -> Column:
    """Equal item values (x) answer equal document values (y), and among names the other way round too."""

    def repeats(side: str, of: Column) -> Column:
        return F.size(F.array_distinct(F.transform(of, lambda s: F.struct(s["kind"], s[side])))) < F.size(of)

    return ~repeats("x", slots) & ~repeats("y", F.filter(slots, lambda s: s["kind"] == NAME))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, reparameterised: one row a document and an item in it."""
    found = _found(own_columns(docs, "doc_id", "text"), own_columns(items, "item_id", "text"))
    found = found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.min("changed").alias("_c"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", (F.col("_c") == 1).alias("reparameterised"))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row (the text's hash), item_id, n_windows, n_matched, changed (0 or 1): the rows of docs that hold an item."""
    spark, id_types = docs.sparkSession, (docs.schema["doc_id"].dataType, items.schema["item_id"].dataType)
    items = items.distinct()
    tokens = F.split(marked(F.col("text")), " ")
    kinds = F.transform(tokens, lambda x: F.when(F.substring(x, 1, 1).isin(NUMBER, UNIT, NAME), F.substring(x, 1, 1)).otherwise(""))
    items = items.where(F.length(marked(F.col("text"))) > 0).select("item_id", F.monotonically_increasing_id().alias("item"), hashed(F.col("text")).alias("_h"), kinds.alias("kinds"))
    n = F.size("kinds")
    items = materialise(items.select("item_id", "item", "_h", F.col("_h.p").alias("words"), "kinds", size_of(n).alias("size"), needed(n).alias("need"), (n - size_of(n) + 1).alias("n_windows")), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # under 8 values
    wanted = None
    for size in sizes:
        own = _all_windows(items.where(F.col("size") == size), F.col("_h"), [size], "item", "size", "kinds")
        wanted = own if wanted is None else wanted.unionByName(own)
    if wanted is None:
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", id_types[0]), T.StructField("row", T.LongType()), T.StructField("item_id", id_types[1]), *(T.StructField(c, T.IntegerType()) for c in ("n_windows", "n_matched", "changed"))]))
    ordinary = F.size(F.filter(F.slice("kinds", F.col("pos") + 1, F.col("size")), lambda k: k == ""))
    enough = F.when(F.col("size") < WINDOW, ordinary >= F.least(F.col("size"), F.lit(4))).otherwise(2 * ordinary >= F.col("size"))
    wanted = wanted.where(F.col("values").isNull() | enough)
    wanted = materialise(wanted.select("item", F.col("pos").alias("q"), "size", "hash"), "windows")
    hint = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    hits = _all_windows(texts, hashed(F.col("text")), sizes, "doc_id", "row").join(hint(wanted), "hash")
    hits = hits.select("doc_id", "row", "item", (F.col("pos") - F.col("q")).alias("shift"), "q", "values").repartition("doc_id", "row", "item")
    # A window that stands many times in one document is one match of its alignment.
    typed = F.when(F.col("values").isNotNull(), F.struct("q", "values"))
    aligned = hits.groupBy("doc_id", "row", "item", "shift").agg(F.collect_set("q").alias("qs"), F.collect_set(typed).alias("ts"))
    few_tokens = items.agg(F.sum(F.size("kinds"))).first()[0] <= BROADCAST_IDS
    aligned = aligned.join(F.broadcast(items.drop("_h")) if few_tokens else items.drop("_h"), "item")
    # Aligned values of the slots of matched windows.
    lined = F.flatten(F.transform("ts", lambda w: F.transform(w["values"], lambda y, j: F.struct(F.get(F.col("kinds"), w["q"] + j).alias("kind"), F.get(F.col("words"), w["q"] + j).alias("x"), y.alias("y")))))
    slots = F.array_distinct(F.filter(lined, lambda s: s["kind"] != ""))
    aligned = aligned.select("doc_id", "row", "item", "item_id", "size", "need", "n_windows", "qs", "shift", slots.alias("slots")).where(_consistent(F.col("slots")))
    # Places: each shift alone, and overlapping bands of shifts, two of which hold it.
    band = F.floor(F.col("shift") / BAND).cast("long")
    places = F.array(*[F.struct(F.lit(kind).alias("kind"), at.alias("at")) for kind, at in (("shift", F.col("shift").cast("long")), ("band", band), ("band", band - 1))])
    placed = aligned.select("doc_id", "row", "item", "item_id", "size", "need", "n_windows", "qs", "slots", F.explode(places).alias("place"))
    merged = placed.groupBy("doc_id", "row", "item", "place").agg(*[F.first(c).alias(c) for c in ("item_id", "size", "need", "n_windows")], F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + F.col("size") - 1)))))
    found = merged.where((covered >= F.col("need")) & _consistent(F.col("slots")))
    changed = F.exists("slots", lambda s: s["x"] != s["y"])
    return found.groupBy("doc_id", "row", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max(F.size("qs")).alias("n_matched"), F.min(changed.cast("int")).alias("changed"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    d, t = unused(docs, "_d"), unused(docs, "_t")
    gone = _found(own_columns(docs, "doc_id", "text"), own_columns(items, "item_id", "text")).select(F.col("doc_id").alias(d), F.col("row").alias(t)).distinct()
    gone = materialise(gone, "leaks")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
