"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, then encoded, so the files
in name order hold ascending doc_ids and each stripe covers a narrow range of
them: readers take stripes in parallel and skip those whose statistics or Bloom
filter exclude a document.  Ids are kept as signed integers, which ORC stores
run-length encoded (its second version).

The files hold doc_id, ids, part (files in doc_id order) and row (place in its
part), so positions follow the files' own order, also among rows that share a
doc_id.

Null and empty texts hold the end id alone.  Rows without doc_id come first.
Repeated rows are kept each; rows that share a doc_id stand in order of a hash of
their texts.  An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.llm import tokens
from ontoloom.llm.common import materialise, new_path, own_columns, small_batches, table

#: Documents in a file, about.
PART_ROWS = 50_000
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "doc_id long, ids array<int>, part int, row long"


def _encoded(path: str, end_id: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0  # a task holds one part
        for batch in tokens.gathered(batches):
            ids, at = tokens.encoded(batch.column("text"), path, False, end_id)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
            rows = pa.array(np.arange(row, row + len(batch), dtype=np.int64))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, batch.column("part"), rows], names=["doc_id", "ids", "part", "row"])

    return encoded


def write(docs: DataFrame, out: str, path: str, end_id: int = tokens.END_ID, parts: int | None = None) -> None:
    """Write (doc_id, ids, part, row) as ORC under out; part numbers the files in doc_id order, row the documents in a part.

    parts: number of files; where it is not given, Spark sizes them, unless that would put over about PART_ROWS documents into one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = own_columns(docs, "doc_id", "text")
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    least = -(-docs.count() // PART_ROWS)
    if parts is None and least > int(spark.conf.get("spark.sql.shuffle.partitions")):
        parts = least
    dealt = docs.repartitionByRange(parts, *by) if parts else docs.repartitionByRange(*by)
    placed = dealt.sortWithinPartitions(*by).select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    ids = placed.mapInArrow(_encoded(path, end_id), FILE_SCHEMA)
    ids.write.options(**ORC).orc(out)


def read(spark, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids, part, row); doc_ids prunes stripes by statistics and Bloom filters."""
    found = spark.read.schema(FILE_SCHEMA).orc(out)
    return found.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else found


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy() * 4
        raw = memoryview(ids.values.buffers()[1] or b"")
        shift = ids.values.offset * 4
        crcs = [zlib.crc32(raw[shift + a : shift + b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(at) // 4, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def index(spark, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    start sums tokens in the order of the part's rows and adds the tokens of the parts before it (one row a part).
    """
    found = materialise(read(spark, out).mapInArrow(_summed, "doc_id long, part int, row long, n_tokens long, ids_crc32 long"), "token-index")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    summed = found.withColumn("_in", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return summed.join(before, "part").select("doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_orc(spark, sf_dir: str) -> DataFrame:
    out = new_path(spark, "orc")
    write(table(spark, sf_dir, "documents"), out, tokens.default_path("word_bpe_49k.json"))
    return index(spark, out)
