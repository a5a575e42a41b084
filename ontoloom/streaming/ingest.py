"""Annotation files as a stream: lines are parsed and checked as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ontoloom.sources.annotations import GAF


def rows(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """The columns of read_rows() for each new file in folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", str(files_a_trigger)).text(folder).where("value not like '!%' and trim(value) <> ''")
    cut = lines.select(F.col("value").alias("line"), F.split("value", "\t", -1).alias("_c"))
    n = F.size("_c")
    return cut.select(*[F.get("_c", F.lit(i)).alias(x) for i, x in enumerate(GAF)], F.when(n < 15, "short").when(n > len(GAF), "long").otherwise("ok").alias("status"), "line")


def violations(stream: DataFrame, rules: dict) -> DataFrame:
    """(line, rule): one row a broken rule; rules are conditions on the columns of rows()."""
    broken = F.filter(F.array(F.when(F.col("status") == "short", "short_row"), *[F.when((F.col("status") != "short") & c, name) for name, c in rules.items()]), lambda x: x.isNotNull())
    return stream.select("line", F.explode(broken).alias("rule"))


def write(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append found to Parquet files under out until all files present are done; a restart goes on from the checkpoint."""
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
