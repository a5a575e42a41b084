"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct word shingles.  Documents with equal sets
form a class (found by a 128-bit digest of the set); only the class's smallest
doc_id goes on.  Its minima fall into bands; representatives that share a band
are candidates.  Of each minimum BITS low bits are kept, packed as bit planes,
and a bit count over the XOR of two signatures estimates the similarity after
correcting for chance agreement.  Pairs whose estimate or sizes rule a link out
(the margin is over four standard deviations) are dropped; the others are
confirmed on the full sets.

Groups of near copies are never expanded into all pairs.  First every
representative is checked against the likeliest of its bands' hubs (the
smallest member and some drawn ones), which merges most of a group.  Then the
members of a band that are still in different groups are compared; large bands
are dealt into parts, so that their comparisons spread over tasks, and members of
one group are never compared.  A wider sketch rules out more pairs inside the
join, and of the others only those are confirmed whose groups no likelier pair
has joined yet.  Components join the confirmed links.

Null or empty texts have an empty set and are linked with nothing.  A text with
fewer words than a shingle has its whole sequence as the one shingle.  Rows
without doc_id take no part and are kept.  Repeated rows get one result each;
rows that share a doc_id are one node, linked by any of their texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import claim, materialise, own_columns, semi, small_batches
from ontoloom.llm.components import components, roots

ROWS, BANDS = 5, 36
LANES = ROWS * BANDS
BITS, LANES_IN_LONG = 4, 60
#: A link at 0.8 is missed by all bands with probability (1 - 0.8 ** 5) ** 36 = 6e-7.
MARGIN = 0.15
WORD_CACHE = 300_000
#: Besides a band's smallest member so many drawn ones serve as hubs (candidates grow with members times hubs); a representative is checked against its TRIES likeliest hubs.
HUBS, TRIES = 1, 3

#: Members of a band that one part holds, about; two parts are compared in about a second.
CELL = 1024
#: Rounds in which only each label's likeliest pair is confirmed.
EARLY_ROUNDS = 2
#: A wider sketch for representatives whose bands still join different groups.
WIDE, WIDE_BITS, WIDE_MARGIN = 2048, 2, 0.048

_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(0, 2**32, LANES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, LANES, dtype=np.uint64).astype(np.uint32)[:, None]
_WIDE_MUL = (_rng.integers(0, 2**32, WIDE, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_WIDE_ADD = _rng.integers(0, 2**32, WIDE, dtype=np.uint64).astype(np.uint32)[:, None]
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
FEATURES = "struct<n_shingles:long,set_key:binary,bands:array<long>,planes:array<long>>"


class _Hashes(dict):
    """64-bit hashes of words; cleared when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; bytes.split() parts at space and \\t \\n \\v \\f \\r, bytes.lower() changes A-Z alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    claim("minhash", _hashes.clear)
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(k, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= _P
        out ^= out >> np.uint64(29)
        out += h[i : n - k + 1 + i]
    out *= _Q
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(hashes: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    low = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    x = (hashes >> np.uint64(20)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[None, i : i + 2048] * mul + add).min(axis=1), out=low)
    return low


def packed(low: np.ndarray, bits: int, in_long: int) -> np.ndarray:
    """Planes: for each kept bit, the lanes' bits packed into longs."""
    kept = low >> np.uint32(4)  # the lowest bits of a product depend on few bits of its factor
    lane = np.uint64(1) << np.arange(in_long, dtype=np.uint64)
    planes = [(((kept >> np.uint32(b)) & np.uint32(1)).astype(np.uint64).reshape(-1, in_long) * lane).sum(axis=1) for b in range(bits)]
    return np.concatenate(planes).view(np.int64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits."""
    low = minima(hashes)
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _Q
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * _P
        key ^= key >> np.uint64(31)
    return key.view(np.int64), packed(low, BITS, LANES_IN_LONG)


def _features(k: int):
    def features(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = shingle_hashes(words_of(text), k)
            if not len(hashes):
                out.append((0, None, None, None))
                continue
            out.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), *signature(hashes)))
        return pd.DataFrame(out, columns=["n_shingles", "set_key", "bands", "planes"])

    return F.pandas_udf(features, FEATURES).asNondeterministic()


def _wide(k: int):
    def wide(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(minima(shingle_hashes(words_of(t), k), _WIDE_MUL, _WIDE_ADD), WIDE_BITS, 64) for t in texts])

    return F.pandas_udf(wide, "array<long>").asNondeterministic()


def _linked(k: int, percent: int):
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        last, mine, out = None, None, []
        for x, y in zip(a, b, strict=True):
            if x != last:
                last, mine = x, shingle_set(words_of(x), k)
            other = shingle_set(words_of(y), k)
            both = len(mine & other)
            out.append(bool(both) and 100 * both >= percent * (len(mine) + len(other) - both))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(linked, "boolean").asNondeterministic()


def estimate(a: str, b: str, lanes: int = LANES, bits: int = BITS, in_long: int = LANES_IN_LONG) -> Column:
    """Similarity from two planes columns, corrected for lanes that agree by chance."""
    per = lanes // in_long
    differ = None
    for i in range(per):
        word = None
        for bit in range(bits):
            x = F.col(a)[bit * per + i].bitwiseXOR(F.col(b)[bit * per + i])
            word = x if word is None else word.bitwiseOR(x)
        differ = F.bit_count(word) if differ is None else differ + F.bit_count(word)
    chance = 1 / 2**bits
    return ((1 - differ / lanes) - chance) / (1 - chance)


def _estimated(pairs: DataFrame, planes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that their sizes and signatures don't rule out, with est."""
    for x in "ab":
        pairs = pairs.join(planes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("planes").alias(f"p_{x}")), x)
    sized = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", estimate("p_a", "p_b").alias("est")).where(F.col("est") >= percent / 100 - MARGIN)


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; a repeated row's text is compared once."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = semi(docs, ids, "doc_id", ids.count()).groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(x), F.col("texts").alias(f"t_{x}")), x)
    pairs = pairs.withColumn("t_a", F.explode("t_a")).withColumn("t_b", F.explode("t_b"))
    return pairs.where(_linked(k, percent)("t_a", "t_b")).select("a", "b").distinct()


def _dealt(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparisons in labelled (bucket, rep, label): bucket, meet, within, rep_x and label_x for x in a, b.

    A band's members are dealt into parts of about CELL: a label with more
    members has parts of its own, the others share parts.  Two members of
    different labels meet in one (bucket, meet), or, where both come from one
    part (within), once each way.  Parts of one label never meet.
    """
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    unit = F.when(F.col("n") > CELL, F.col("label").cast("string")).otherwise("").alias("unit")
    units = sizes.groupBy("bucket", unit).agg(F.ceil(F.sum("n") / CELL).cast("int").alias("parts"))
    placed = labelled.join(sizes, ["bucket", "label"]).select("bucket", "rep", "label", unit).join(units, ["bucket", "unit"])
    placed = placed.select("bucket", "rep", "label", "unit", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
    x, y = (units.select("bucket", F.col("unit").alias(f"unit_{s}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{s}")) for s in "ab")
    meets = x.join(y, "bucket").where((F.col("unit_a") < F.col("unit_b")) | ((F.col("unit_a") == "") & (F.col("unit_b") == "") & (F.col("part_a") <= F.col("part_b"))))
    within = (F.col("unit_a") == F.col("unit_b")) & (F.col("part_a") == F.col("part_b"))
    meets = materialise(meets.select("*", within.alias("within"), F.xxhash64("unit_a", "part_a", "unit_b", "part_b").alias("meet")), "meets")
    side = lambda s: placed.join(meets.select("bucket", "meet", "within", F.col(f"unit_{s}").alias("unit"), F.col(f"part_{s}").alias("part")), ["bucket", "unit", "part"])
    a, b = (side(s).select("bucket", "meet", "within", F.col("rep").alias(f"rep_{s}"), F.col("label").alias(f"label_{s}")) for s in "ab")
    return a, b


def _meeting(labelled: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels (label_a, label_b) that share a band and that sizes and both sketches don't rule out, with est.

    Members of such bands get a wider sketch first.  All tests stand in the
    join's condition, so the join makes no row for a pair that they rule out,
    and one row for a pair that meets in several bands.
    """
    ids = materialise(labelled.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    wide = semi(docs, ids, "doc_id", ids.count()).select(F.col("doc_id").alias("rep"), _wide(k)("text").alias("wide")).distinct()
    sketched = materialise(reps.select("rep", "n_shingles", "planes", "bands").join(wide, "rep"), "sketches")
    left, right = _dealt(labelled)
    for x in "ab":
        payload = sketched.select(*[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n_shingles", "planes", "bands", "wide")])
        left, right = (left.join(payload, "rep_a"), right) if x == "a" else (left, right.join(payload, "rep_b"))
    right = right.drop("within").withColumnsRenamed({"bucket": "bucket_b", "meet": "meet_b"})
    sized = (100 * F.col("n_shingles_a") >= percent * F.col("n_shingles_b")) & (100 * F.col("n_shingles_b") >= percent * F.col("n_shingles_a"))
    wide_est = estimate("wide_a", "wide_b", WIDE, WIDE_BITS, 64)
    alike = (estimate("planes_a", "planes_b") >= percent / 100 - MARGIN) & (wide_est >= percent / 100 - WIDE_MARGIN)
    once = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("bucket")
    ways = ~F.col("within") | (F.col("rep_a") < F.col("rep_b"))
    met = left.join(right, (F.col("bucket") == F.col("bucket_b")) & (F.col("meet") == F.col("meet_b")) & ways & (F.col("label_a") != F.col("label_b")) & sized & alike & once)
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "label_a", "label_b", wide_est.alias("est"))


def _links(met: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (u, v) between labels, which join the labels that the confirmed pairs of met join.

    While there are many more pairs than labels and links are found, each label's
    likeliest pair is confirmed first (for EARLY_ROUNDS at most), and pairs whose
    labels that joins go; then all that are left are confirmed.
    """
    edges, last = None, False
    rest = materialise(met, "met")
    for early in range(EARLY_ROUNDS, -1, -1):
        best = F.max(F.struct("est", "a", "b")).alias("pair")
        sides = [rest.groupBy(F.col(f"label_{x}").alias("label")).agg(best) for x in "ab"]
        likeliest = materialise(sides[0].union(sides[1]).groupBy("label").agg(F.max("pair").alias("pair")), "likeliest")
        few = last or not early or rest.count() <= 4 * likeliest.count()
        tested = rest if few else likeliest.select("pair.a", "pair.b").distinct()
        good = _confirmed(tested.select("a", "b"), docs, k, percent)
        good = materialise(good.join(rest, ["a", "b"]).select(F.col("label_a").alias("u"), F.col("label_b").alias("v")).distinct(), "links")
        edges = good if edges is None else edges.union(good)
        if few:
            return edges
        rest = rest.join(tested, ["a", "b"], "left_anti")
        last = good.isEmpty()
        if not last:
            over = components(good)
            for x in "ab":
                rest = rest.join(over.select(F.col("node").alias(f"label_{x}"), "root"), f"label_{x}", "left").withColumn(f"label_{x}", F.coalesce("root", f"label_{x}")).drop("root")
            rest = rest.where("label_a <> label_b")
        rest = materialise(rest, "met")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept."""
    small_batches(docs.sparkSession)
    docs = own_columns(docs, "doc_id", "text")
    found = materialise(docs.select("doc_id", _features(shingle)("text").alias("f")).select("doc_id", "f.*"), "minhash")
    named = found.where("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "planes", "bands"), "doc_id").alias("f"))
    reps = materialise(reps.select("set_key", "rep", "f.*"), "representatives")
    classes = reps.select("set_key", "rep")
    planes = reps.select("rep", "n_shingles", "planes")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    drawn = [F.min_by("rep", F.xxhash64("rep", "bucket", F.lit(i))).alias(f"h{i}") for i in range(HUBS)]
    shared = members.groupBy("bucket").agg(F.min("rep").alias("_low"), F.max("rep").alias("_top"), *drawn).where("_low < _top")
    shared = shared.select("bucket", F.array_distinct(F.array("_low", *[f"h{i}" for i in range(HUBS)])).alias("hubs"))
    members = materialise(members.join(shared, "bucket"), "members")

    # Each representative against the likeliest hubs of its bands.
    first = members.select(F.explode("hubs").alias("a"), F.col("rep").alias("b")).where("a < b").distinct()
    first = _estimated(first, planes, percent).groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("est", "a")), asc=False), 1, TRIES).alias("best"))
    tree = _confirmed(materialise(first.select(F.explode("best.a").alias("a"), "b"), "first"), docs, shingle, percent)
    tree = roots(tree.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("parent")))

    # Then pairs between the groups that still meet in a band.
    labelled = members.select("bucket", "rep").join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("label"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h").select("bucket")
    labelled = materialise(labelled.join(mixed, "bucket", "left_semi"), "mixed")
    edges = _links(_meeting(labelled, reps, docs, shingle, percent), docs, shingle, percent)
    if not edges.isEmpty():
        over = components(edges)
        tree = tree.join(over.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root")).union(over.join(tree, "node", "left_anti").select("node", "root"))
    final = classes.join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("_component"))
    return (
        found.select("doc_id", "n_shingles", "set_key")
        .join(final, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates of a smaller doc_id."""
    gone = materialise(near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct(), "duplicates")
    return semi(docs, gone, "doc_id", gone.count(), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from ontoloom.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
