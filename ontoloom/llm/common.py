"""Shared helpers: tables, intermediate tables in the cluster's shared folder, caches of Python workers, word rules."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.plans.session import delete_path, shared_path, ship_package

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same rule for Spark's Java regular expressions, as a separator.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch that Python gets; texts may be long.
BATCH_ROWS = 256
#: Id lists up to this many rows may be broadcast (at most 16 MB); longer ones are shuffled.
BROADCAST_IDS = 1_000_000

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Prepare Python stages: ship this code, and pass long texts in small Arrow batches, so that memory stays bounded."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def new_path(spark: SparkSession, label: str) -> str:
    path = shared_path(spark, label)
    _made.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._ontoloom_path = path
    return found


def discard(table: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more, such as the last round of an iteration."""
    delete_path(table.sparkSession, table._ontoloom_path)
    _made.remove(table._ontoloom_path)


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process made; results that still read them must be written first.

    Tables made inside `ontoloom.plans.session.run_folder` go at its end, all others when the process ends.
    """
    for path in _made:
        delete_path(spark, path)
    _made.clear()


_owner: list[tuple[str, Callable[[], None]]] = []


def claim(kind: str, clear: Callable[[], None]) -> None:
    """Called in Python workers by a stage that keeps a cache: the one of another kind is emptied, so that a worker, which Spark uses again for later stages, holds one at a time."""
    if _owner and _owner[0][0] == kind:
        return
    if _owner:
        _owner.pop()[1]()
        release_memory()
    _owner.append((kind, clear))


def release_memory() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def semi(df: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """Keep (or with left_anti drop) the rows of df whose key is in ids; broadcast only behind the check of n_ids."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, how)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns that an operator needs, so that extra ones can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
