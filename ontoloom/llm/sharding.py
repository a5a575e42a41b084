"""Range partitioning by sampled splitters.

The order is by a hash of the text, then a hash of doc_id, so equal texts stand
together but a large group of them can be cut.  A sample drawn with probability
in proportion to size gives quantile boundaries of RANGES ranges (the sample's
size is fixed, so the driver's lists don't grow).  Ranges with over RANGE_ROWS
rows are subdivided: as keys are hashes, equal steps between a range's first and
last key divide it evenly, but for texts with over RANGE_ROWS copies in a step,
which are set apart and divided by equal steps of the hash of doc_id.  Sizes per subdivision are summed, running sums
over them give each one's place in the total order of bytes, and the running sum
within it places its rows: a row goes to the shard that holds the middle of its
bytes.  So shards differ by about one record in size, whatever the keys.

Texts are read once; what follows works on one narrow row a document.

Null texts have size 8 and one hash; rows without doc_id have one hash and are
told apart by their place in the input's partitions; empty tables give no rows;
repeated rows are placed each; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm.common import BROADCAST_IDS, materialise, own_columns, table

SHARDS = 24
#: Ranges that the sample bounds, sampled keys a range, and rows of a subdivision (about).
RANGES, SAMPLE, RANGE_ROWS = 192, 24, 250_000
OVERHEAD = 8


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the ordering key (k, d) of each row; texts go no further.

    Rows that share doc_id and text differ in d by their row number in the input.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("k"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id")).alias("d"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Quantiles of a size-weighted sample of about ranges * SAMPLE keys, drawn by a hash so that a recomputation draws the same ones."""
    chance = F.col("size") * F.lit(ranges * SAMPLE / max(total, 1))
    roll = F.pmod(F.xxhash64("d", "k", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keys = sorted((r["k"], r["d"]) for r in rows.where(roll < chance).select("k", "d").collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)} if len(keys) >= ranges else set(keys))


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds at or below the row's key: a search tree of comparisons."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        k, d = bounds[middle]
        at_least = (F.col("k") > k) | ((F.col("k") == k) & (F.col("d") >= d))
        return F.when(at_least, search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(bounds))


def subdivided(rows: DataFrame) -> DataFrame:
    """rows with range and sub, ascending in the order of (k, d); a (range, sub) holds about RANGE_ROWS rows."""
    span = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))  # at most RANGES rows
    steps = F.ceil(F.col("n") / RANGE_ROWS)
    over = (F.col("k").cast("double") - F.col("low")) / (F.col("high").cast("double") - F.col("low"))
    step = F.when((steps > 1) & (F.col("low") < F.col("high")), F.least(F.floor(over * steps), steps - 1)).otherwise(0).cast("int")
    cut = rows.join(F.broadcast(span), "range").select(*rows.columns, step.alias("step"))
    copies = cut.groupBy("range", "step", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANGE_ROWS)
    copies = materialise(copies.groupBy("range", "step").agg(F.collect_list(F.struct("k", "n")).alias("hot")), "copies")
    n = copies.count()
    if n:
        cut = cut.join(F.broadcast(copies) if n <= BROADCAST_IDS else copies, ["range", "step"], "left")
        mine = F.get(F.filter("hot", lambda x: x["k"] == F.col("k")), F.lit(0))
        past = F.coalesce(F.size(F.filter("hot", lambda x: x["k"] < F.col("k"))), F.lit(0))
        place = F.when(mine.isNotNull(), F.floor((F.col("d") / F.lit(2.0**64) + 0.5) * F.ceil(mine["n"] / RANGE_ROWS))).otherwise(0)
        between = F.when(F.col("hot").isNull(), 0).otherwise(2 * past + mine.isNotNull().cast("int"))
    else:
        between, place = F.lit(0), F.lit(0)
    sub = F.struct("step", between.cast("int").alias("between"), place.cast("int").alias("place"))
    return cut.select(*rows.columns, sub.alias("sub"))


def _before(order: list[str], value: str) -> Column:
    """Sum of value over the rows that stand before in the order; few rows, one a range, need no partitions."""
    return F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _starts(found: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., range, sub, start): per (by, range, sub) of found the sum of value before it, in order of range and sub.

    by is empty or names a column of few values.  Sums run within a range, then
    over the ranges (at most RANGES rows for each value of by).
    """
    ranges = found.groupBy(*by, "range").agg(F.sum(value).alias("_all"))
    if by:
        earlier = F.coalesce(F.sum("_all").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        earlier = _before(["range"], "_all")
    ranges = ranges.select(*by, "range", earlier.alias("_earlier"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "range").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("_inside", inside).join(ranges, [*by, "range"]).withColumn("start", F.col("_earlier") + F.col("_inside"))


def _joined(rows: DataFrame, few: DataFrame, on: list[str], n: int) -> DataFrame:
    return rows.join(F.broadcast(few) if n <= BROADCAST_IDS else few, on)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null)."""
    rows = materialise(keyed(own_columns(docs, "doc_id", "text")), "keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = subdivided(rows.withColumn("range", _range_of(splitters(rows, total, RANGES))))
    order = Window.partitionBy("range", "sub").orderBy("k", "d", "doc_id", "size", "text_crc32")
    inner = rows.withColumn("_in", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_row", F.row_number().over(order))
    inner = materialise(inner.select("doc_id", "size", "text_crc32", "range", "sub", "_in", "_row"), "ranges")
    sizes = materialise(inner.groupBy("range", "sub").agg(F.sum("size").alias("b")), "sizes")
    starts = _starts(sizes, "b", []).select("range", "sub", "start")
    n = sizes.count()
    middle = F.col("start") + F.col("_in") + F.floor(F.col("size") / 2)
    placed = _joined(inner, starts, ["range", "sub"], n).withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1)))
    placed = placed.select("doc_id", "size", "text_crc32", "range", "sub", "_row", "shard")
    # Rows of a shard before a subdivision, and of a subdivision before its first row in a shard.
    runs = materialise(placed.groupBy("shard", "range", "sub").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first")), "runs")
    shift = _starts(runs, "n", ["shard"]).select("shard", "range", "sub", (F.col("start") - F.col("_first")).alias("_shift"))
    return _joined(placed, shift, ["range", "sub", "shard"], runs.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") + F.col("_shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
