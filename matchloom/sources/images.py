"""Image trees as tables: bucket, person and path of each file, from a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of image files, in either case.
ENDINGS = ("png", "jpg", "jpeg", "bmp", "webp")


def scan(spark: SparkSession, base: str) -> DataFrame:
    """path, length and content of the image files under a folder; only the columns used are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(is_image(F.col("path")))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*ENDINGS)


def entries(files: DataFrame) -> DataFrame:
    """bucket (raw, processed or augmented/<split>[/<train|test>]) and person of image files with a `path`."""
    path = F.col("path")
    nested = F.regexp_extract(path, r"(augmented/[^/]+/(?:train|test))/", 1)
    flat = F.regexp_extract(path, r"(augmented/[^/]+)/", 1)
    plain = F.regexp_extract(path, r"(?:^|/)(raw|processed)/", 1)
    bucket = F.when(nested != "", nested).when(flat != "", flat).otherwise(plain)
    return files.where(is_image(path)).withColumn("bucket", bucket).withColumn("person", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def by_sources(listing: DataFrame, raw: bool, processed: bool, augmented: bool) -> DataFrame:
    wanted = F.lit(False)
    for use, c in ((raw, F.col("bucket") == "raw"), (processed, F.col("bucket") == "processed"), (augmented, F.startswith("bucket", F.lit("augmented/")))):
        wanted = wanted | c if use else wanted
    return listing.where(wanted)


def split_of(bucket: Column) -> Column:
    """train or test if the last part of the bucket says so, else null."""
    base = F.regexp_extract(bucket, "([^/]+)$", 1)
    return F.when(base.isin("train", "test"), base)


def augmented(listing: DataFrame, split: str | None) -> DataFrame:
    """Augmented files: those nested under the split if there are any, else all nested ones, else the flat layout."""
    a = listing.where(F.startswith("bucket", F.lit("augmented/"))).withColumn("__split", split_of(F.col("bucket")))
    level = F.when(F.col("__split") == split, 0).when(F.col("__split").isNotNull(), 1).otherwise(2) if split else F.when(F.col("__split").isNotNull(), 0).otherwise(1)
    a = a.withColumn("__level", level)
    return a.join(F.broadcast(a.agg(F.min("__level").alias("__least"))), F.col("__level") == F.col("__least")).drop("__split", "__level", "__least")


def seeded(seed: int) -> Column:
    """A reproducible random order of files."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "bucket", "person", "path").cast("binary"))


def seeded_cap(listing: DataFrame, most: int, grain: list[str], seed: int) -> DataFrame:
    """At most so many files of each group, in seeded order."""
    return listing.withColumn("__rn", F.row_number().over(Window.partitionBy(*grain).orderBy(seeded(seed)))).where(F.col("__rn") <= most).drop("__rn")
