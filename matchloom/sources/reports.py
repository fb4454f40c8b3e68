"""Report files: one JSON document a file, over several lines, some of them broken; newest by the time of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROKEN = "_corrupt_record"


def write_documents(rows: DataFrame, path: str, unit: str, text: Column) -> None:
    """A file of its own for each row, in a folder named by its unit; files that are there stay."""
    rows.select(unit, text.alias("value")).repartition(unit).write.mode("append").partitionBy(unit).text(path)


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents below path with `file` and `modified`; what is no JSON document of this schema has its text in BROKEN."""
    found = spark.read.schema(f"{schema}, {BROKEN} string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return found.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def usable(documents: DataFrame, *required: str) -> DataFrame:
    """Without broken documents and ones that lack a required field."""
    out = documents.where(F.col(BROKEN).isNull()).drop(BROKEN)
    for c in required:
        out = out.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return out


def latest(documents: DataFrame, key: str) -> DataFrame:
    """For each key the document of the newest file (the first by name of equally new ones), and `runs`, how many there are."""
    each = F.struct(*[F.col(c) for c in documents.columns])
    best = documents.groupBy(key).agg(F.min_by(each, F.struct((-F.unix_micros("modified")).alias("t"), "file")).alias("x"), F.count("*").alias("runs"))
    return best.select("x.*", "runs")
