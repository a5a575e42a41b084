"""Token counts of whole texts through a cache of digests.

A text's key is the SHA-256 of its normal form, a tokenizer's that of its file
with the name and version of its library.  Counts are kept in Parquet folders,
one a tokenizer key (`tokenizer=<key>`), as rows (digest, n_tokens).  A call joins the
corpus's distinct digests with the stored counts, encodes each missing text once
and appends what it found; later calls, also of other applications, encode only
what no call has met.  Texts travel only to the join with the missing digests,
all else by digest.  A copy is told by the smallest doc_id of its digest, so no
text is gathered.

The normal form is the text itself, null as empty: the given tokenizers count
differently under any other one.  For tokenizers that, say, ignore case, `normal`
is a column expression under which counts don't change.

Files ending in .json go to tokenizers, .model to sentencepiece.  Special strings
in a text count as the library counts them by default; none is added, nothing is
cut.  Repeated rows are counted each; an empty table gives no rows; extra columns
are left out.  Appends are whole files, so a call that fails leaves the cache as
it was; rows that two calls append at once are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm import tokens
from ontoloom.llm.common import claim, materialise, new_path, own_columns, small_batches, table

LIMIT = 1024
CACHE_SCHEMA = "digest binary, n_tokens long"
#: Missing digests up to this many rows are broadcast (about 3 MB); more are shuffled.
BROADCAST_MISSES = 20_000

_pieces: dict[str, object] = {}


def tokenizer_key(path: str) -> str:
    """SHA-256 of the tokenizer's file with its library's name and version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {version(library)}\n".encode() + Path(path).read_bytes()).hexdigest()


def _counts_of(path: str) -> Callable[[list[str | None]], np.ndarray]:
    """Token counts of texts, in a worker."""
    if path.endswith(".model"):
        claim("pieces", _pieces.clear)
        if path not in _pieces:
            import sentencepiece

            _pieces[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in _pieces[path].encode([t or "" for t in texts], num_threads=1)], np.int64)
    from tokenizers import Tokenizer

    names = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    spaces = "a</w>" not in names  # word-end vocabularies drop white space
    return lambda texts: np.diff(tokens.encoder(path, spaces).encode_flat(texts)[1])


def _counted(path: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in filter(len, tokens.gathered(batches)):
            counts = counts or _counts_of(path)
            n = counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return counted


def stored(spark: SparkSession, cache: str, key: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, each digest once; empty where the cache has none."""
    at = f"{cache}/tokenizer={key}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(at).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, normal: Callable[[Column], Column] | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; counts that cache lacks are made and appended to it."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    form = normal(text) if normal else text
    known = own_columns(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(form.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), form.alias("text"))
    keyed = materialise(known.drop("text"), "text-digests")
    key = tokenizer_key(path)
    distinct = materialise(keyed.groupBy("digest").agg(F.min("doc_id").alias("_copy")), "distinct-digests")
    missing = materialise(distinct.join(stored(spark, cache, key), "digest", "left_anti").withColumnRenamed("digest", "_digest"), "missing-digests")
    n_missing = missing.count()
    if n_missing:
        one = F.broadcast(missing) if n_missing <= BROADCAST_MISSES else missing.hint("shuffle_hash")
        new = known.join(one, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_copy")), "left_semi").select("digest", "text")
        new.mapInArrow(_counted(path), CACHE_SCHEMA).write.mode("append").parquet(f"{cache}/tokenizer={key}")
    counts = materialise(distinct.select("digest").join(stored(spark, cache, key), "digest"), "counts")
    out = keyed.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """With an empty cache of its own, so that every distinct text is encoded."""
    return count_tokens(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
