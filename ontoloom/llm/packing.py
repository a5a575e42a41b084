"""Best-fit packing by minimum bin slack.

Documents become token ids plus an end id; only documents longer than a
sequence are cut, into full pieces with the shorter piece first.  A piece's
place depends on its length alone, so packing works on the histogram of piece
lengths (at most `capacity` entries, whatever the corpus).  For each bin the
longest length left is fixed and a bitset subset-sum over the lengths left
finds the fullest combination that still fits; the combination is taken as
often as the counts allow, so each pattern uses up at least one length and the
number of patterns is bounded by the number of lengths.

Pieces then get ranks within their length: each length has shelves of about
SHELF_ROWS pieces, which are counted, summed up and ranked apart, so a length
that holds most pieces is no bottleneck.  By rank they look their sequence and
offset up in the patterns.

Null and empty texts become the end id alone.  Repeated rows are packed each;
an empty table gives no pieces; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.llm import tokens
from ontoloom.llm.common import BROADCAST_IDS, materialise, own_columns, small_batches, table

CAPACITY = 1024
#: Pieces are ranked within (length, shelf); shelves of about so many pieces spread a frequent length over tasks.
SHELF_ROWS = 100_000


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, tokens.gathered(batches)):
            ids, at = tokens.encoded(batch.column("text"), path, True, end_id)
            raw, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), []
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                rows += [(row, i, s, m, zlib.crc32(raw[4 * (a + s) : 4 * (a + s + m)])) for i, (s, m) in enumerate(cuts(b - a, capacity))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how many of each, with the largest sum of at most room; bounded subset-sum over bitsets."""
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (length, how many at once, sums reachable before)
    bits = 1
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            size *= 2
        if bits >> room & 1:
            break
    total, chosen = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: how many in each}); the histogram is used up."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        chosen = fullest(rest, capacity - longest) if capacity > longest else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in chosen.items())
        out.append((times, chosen))
        for k, v in chosen.items():
            counts[k] -= times * v
            if not counts[k]:
                del counts[k]
    return out


def shelves_of(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Rows of (length, first rank, first sequence, pieces of the length in a sequence, offset of the first of them)."""
    rows, used, sequence = [], {}, 0
    for times, chosen in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, chosen[length], offset))
            used[length] = rank + times * chosen[length]
            offset += length * chosen[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def _placed(plan: pd.DataFrame):
    """(length, rank) -> sequence and offset; the plan has a few thousand rows at most."""
    length, rank = plan["length"].to_numpy(np.int64), plan["rank"].to_numpy(np.int64)
    sequence, each, offset = (plan[c].to_numpy(np.int64) for c in ("sequence", "each", "offset"))
    start = {int(k): (int(np.searchsorted(length, k)), int(np.searchsorted(length, k, side="right"))) for k in np.unique(length)}

    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        m, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.empty(len(m), dtype=np.int64)
        for k in np.unique(m):
            a, b = start[int(k)]
            mine = m == k
            at[mine] = a + np.searchsorted(rank[a:b], r[mine], side="right") - 1
        past = r - rank[at]
        return pd.DataFrame({"sequence_id": sequence[at] + past // each[at], "offset": offset[at] + m * (past % each[at])})

    return F.pandas_udf(placed, "struct<sequence_id:long,offset:long>").asNondeterministic()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = own_columns(docs, "doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    cut = materialise(docs.mapInArrow(_pieces(path, capacity, end_id), schema), "pieces")
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.collect()}  # at most capacity rows
    plan = shelves_of(patterns(dict(sorted(histogram.items())), capacity))
    shelves = spark.createDataFrame([(k, -(-n // SHELF_ROWS)) for k, n in histogram.items()], "length long, _shelves long")
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.col("_shelves")).cast("int")
    cut = materialise(cut.join(F.broadcast(shelves), "length").select(*cut.columns, spread.alias("_shelf")), "shelved")  # shelves has at most capacity rows
    first = cut.groupBy("length", "_shelf").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_shelf").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(first.select("length", "_shelf", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first")), "shelves")
    order = Window.partitionBy("length", "_shelf").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_n", F.row_number().over(order)).join(F.broadcast(first) if first.count() <= BROADCAST_IDS else first, ["length", "_shelf"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_n") - 1)
    return ranked.withColumn("_at", _placed(plan)("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))
