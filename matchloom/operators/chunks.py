"""Windows over ordered streams without a task that sees a whole stream.

placed() cuts frames(stream, ts, frame, ..) into ranges, so a stream that holds most rows is many chunks, a column `part` each. What a
window over the stream would need from earlier chunks is small: a sum so far (a row for each chunk), or the last few rows (a few for
each chunk), which are handed on. Streams must not be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.frames import votes
from matchloom.sources.shared import written


def placed(frames: DataFrame) -> DataFrame:
    """frames with `part`, in ranges of (stream, ts, frame); a written table, as places must stay."""
    return written(frames.repartitionByRange("stream", "ts", "frame").withColumn("part", F.spark_partition_id()))


def before(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over earlier rows of the same `by`, in order of ts and frame; 0 for the first."""
    each = rows.groupBy(*by, "part").agg(F.sum(value).alias("__n"))
    so_far = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    each = each.select(*by, "part", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "part").orderBy("ts", "frame").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(each, [*by, "part"]).select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))


def numbered(rows: DataFrame, by: list[str], name: str = "rn") -> DataFrame:
    """rows with their place in `by`, from 0."""
    return before(rows, by, F.lit(1), name)


def episodes(rows: DataFrame, reset: Column) -> DataFrame:
    """rows with `episode`: resets so far in the stream, its own included."""
    marked = rows.withColumn("__reset", F.when(reset, 1).otherwise(0))
    out = before(marked, ["stream"], F.col("__reset"), "__so_far")
    return out.withColumn("episode", F.col("__so_far") + F.col("__reset")).drop("__so_far", "__reset")


def with_last(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rows, with halo false, and for each chunk of each `by` the k rows that come before it (fewer at the start), with its part and halo true."""
    inside = Window.partitionBy(*by, "part")
    tails = rows.withColumn("__back", F.row_number().over(inside.orderBy(F.desc("ts"), F.desc("frame")))).where(F.col("__back") <= k).drop("__back")
    over = Window.partitionBy(*by).orderBy("part", "ts", "frame").rowsBetween(-k, -1)  # k rows for each chunk
    first = tails.withColumn("__last", F.collect_list(F.struct(*[F.col(c) for c in rows.columns])).over(over)).withColumn("__at", F.row_number().over(inside.orderBy("ts", "frame"))).where("__at = 1")
    handed = first.select(F.col("part").alias("__part"), F.explode("__last").alias("__x")).select(*[F.col("__part").alias(c) if c == "part" else F.col(f"__x.{c}").alias(c) for c in rows.columns], F.lit(True).alias("halo"))
    return rows.withColumn("halo", F.lit(False)).unionByName(handed)


def count_vote(rows: DataFrame, last: int = 5, least: int = 3) -> DataFrame:
    """rows(.., name, score, episode) with the vote over the last frames of an episode."""
    w = Window.partitionBy("stream", "episode", "part").orderBy("ts", "frame").rowsBetween(-(last - 1), 0)
    voted = with_last(rows, ["stream", "episode"], last - 1).withColumn("vote", votes(F.collect_list(F.struct("name", "score")).over(w), least))
    return voted.where("not halo").drop("halo")


def lagged(rows: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
    """rows with the value of c in the row before of the same `by`; null for the first."""
    w = Window.partitionBy(*by, "part").orderBy("ts", "frame")
    return with_last(rows, by, 1).withColumn(name, F.lag(c).over(w)).where("not halo").drop("halo")
