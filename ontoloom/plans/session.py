"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
#: Per Spark application the folders of its intermediate tables; the last one takes new tables.
_folders: dict[str, list[str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package's code, once per Spark application, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_ontoloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ontoloom-code-"), "ontoloom_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    sc.addPyFile(path)
    sc._ontoloom_shipped = True


def _eraser(spark: SparkSession, path: str):
    """A call that deletes path, also when the session has been stopped by then."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(sc._jsc.hadoopConfiguration())

    def erase() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            system.delete(at, True)

    return erase


def delete_path(spark: SparkSession, path: str) -> None:
    _eraser(spark, path)()


def shared_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under spark.checkpoint.dir; deleted when the process ends.

    Where the setting is absent (one machine, as in tests), it lies in a local temporary folder.
    """
    sc = spark.sparkContext
    held = _folders.setdefault(sc.applicationId, [])
    if not held:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ontoloom-")
        held.append(f"{base.rstrip('/')}/ontoloom-{uuid.uuid4().hex}")
        atexit.register(_eraser(spark, held[0]))
    return held[-1]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of the innermost run_folder(), or else of the application."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: write or collect the results before it."""
    path = shared_path(spark, "run")
    held = _folders[spark.sparkContext.applicationId]
    held.append(path)
    try:
        yield
    finally:
        held.remove(path)
        delete_path(spark, path)


#: While a table is settled, files count this many times their bytes when Spark decides what to broadcast:
#: repeated keys take far less room in Parquet than as rows in the driver's memory.
_ROOM = {"spark.sql.sources.fileCompressionFactor": "16", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4MB"}


@contextlib.contextmanager
def roomy(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside broadcast only what is small as rows; the session's own settings come back at the end."""
    with _settings(spark, _ROOM):
        yield


#: Bytes of input files for which a spread table's shuffles have one partition, before Spark joins small ones.
SPREAD = 2 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes that the tables read by df have as files."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(found.apply(i).stats().sizeInBytes()) for i in range(found.size()))


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def settle(df: DataFrame, label: str, spread: bool = False) -> DataFrame:
    """Write df and read it again: an iteration's lineage is cut, and lost executors cost no recomputation.

    With spread, shuffles have more partitions for larger inputs, so a task's memory doesn't grow with them.
    """
    path, spark, more = shared_path(df.sparkSession, label), df.sparkSession, {}
    if spread:
        more["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // SPREAD))
    with roomy(spark), _settings(spark, more):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._ontoloom_path = path
    return found


def discard(table: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more, such as the last round of an iteration."""
    delete_path(table.sparkSession, table._ontoloom_path)
