"""Smoothing of ordered prediction streams, in batch: episodes, votes, averages and gates by window functions.

Each stream is a window of its own, so a long stream is one task's sort; give `stream` a time part to split it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(*keys: str) -> Window:
    return Window.partitionBy("stream", *keys).orderBy("ts", "frame")


def episodes(frames: DataFrame, reset: Column) -> DataFrame:
    """episode: number of resets so far in the stream; a reset starts a new one."""
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("episode", F.sum(F.when(reset, 1).otherwise(0)).over(upto))


def ema(frames: DataFrame, x: str, keep: float = 0.85, new: float = 0.15) -> DataFrame:
    """stream, frame, average: x where the average so far is 0, else keep * average + new * x.

    The recursion needs the value before, so partitions hold whole streams in order and are passed through once: a task
    holds a batch and one number, however long the streams are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, average = None, 0.0
        for b in batches:
            out = []
            for s, v in zip(b["stream"], b["x"]):
                if s != stream:
                    stream, average = s, 0.0
                average = v if average == 0 else keep * average + new * v
                out.append(average)
            yield pd.DataFrame({"stream": b["stream"], "frame": b["frame"], "average": out})

    rows = frames.select("stream", "ts", "frame", F.col(x).cast("double").alias("x")).repartition("stream").sortWithinPartitions("stream", "ts", "frame")
    kinds = dict(frames.dtypes)
    return rows.select("stream", "frame", "x").mapInPandas(run, f"stream {kinds['stream']}, frame {kinds['frame']}, average double")


def ema_scanned(frames: DataFrame, x: str, keep: float = 0.85, new: float = 0.15) -> DataFrame:
    """ema() without a task that sees a whole stream: a parallel scan.

    Rows are cut into ranges of (stream, ts, frame), so a long stream is many chunks. What a chunk does to the average before it is an affine
    map, or a number of its own where that is 0. Maps of a stream's chunks, a row each, are put one after the other; then every chunk is gone
    through again from the average that it starts with. Streams with negative values, whose average may come back to 0 in the middle of
    a chunk, go through ema()."""
    from matchloom.sources.shared import written

    kinds = dict(frames.dtypes)
    rows = frames.select("stream", "ts", "frame", F.col(x).cast("double").alias("x"))
    order = ["stream", "ts", "frame"]
    placed = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    signed = placed.where("x < 0").select("stream").distinct()
    plain = placed.join(signed, "stream", "left_anti")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a, b, own, out = None, 1.0, 0.0, 0.0, []
        for d in batches:
            for part, stream, v in zip(d["__part"], d["stream"], d["x"]):
                if (part, stream) != at:
                    if at is not None:
                        out.append((*at, a, b, own))
                    at, a, b, own = (part, stream), 1.0, 0.0, 0.0
                a, b, own = keep * a, keep * b + new * v, v if own == 0 else keep * own + new * v
        if at is not None:
            out.append((*at, a, b, own))
        yield pd.DataFrame(out, columns=["__part", "stream", "a", "b", "own"])

    def starts(d: pd.DataFrame) -> pd.DataFrame:
        d, at = d.sort_values("__part"), []
        now = 0.0
        for a, b, own in zip(d["a"], d["b"], d["own"]):
            at.append(now)
            now = own if now == 0 else a * now + b
        return pd.DataFrame({"__part": d["__part"], "stream": d["stream"], "start": at})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, average = None, 0.0
        for d in batches:
            out = []
            for part, stream, v, start in zip(d["__part"], d["stream"], d["x"], d["start"]):
                if (part, stream) != at:
                    at, average = (part, stream), start
                average = v if average == 0 else keep * average + new * v
                out.append(average)
            yield pd.DataFrame({"stream": d["stream"], "frame": d["frame"], "average": out})

    chunked = plain.repartition("__part", "stream").sortWithinPartitions("__part", *order)
    made = chunked.select("__part", "stream", "x").mapInPandas(maps, f"__part int, stream {kinds['stream']}, a double, b double, own double")
    begun = made.groupBy("stream").applyInPandas(starts, f"__part int, stream {kinds['stream']}, start double")
    again = plain.join(begun, ["__part", "stream"]).repartition("__part", "stream").sortWithinPartitions("__part", *order)
    scanned = again.select("__part", "stream", "frame", "x", "start").mapInPandas(run, f"stream {kinds['stream']}, frame {kinds['frame']}, average double")
    return scanned.unionByName(ema(placed.join(signed, "stream", "left_semi"), "x", keep, new))


def votes(history: Column, least: int) -> Column:
    """Struct name, score, hits of the most frequent name in a list of structs (name, score), the first seen on ties; null
    below `least` hits."""
    names = F.array_distinct(F.transform(history, lambda h: h["name"]))
    tally = F.transform(names, lambda n, i: F.struct(F.size(F.filter(history, lambda h: h["name"] == n)).alias("hits"), (-i).alias("place"), n.alias("name")))
    top = F.array_max(tally)
    mine = F.filter(history, lambda h: h["name"] == top["name"])
    mean = F.aggregate(mine, F.lit(0.0), lambda a, h: a + h["score"]) / F.size(mine)
    return F.when(top["hits"] >= least, F.struct(top["name"].alias("name"), mean.alias("score"), top["hits"].alias("hits")))


def count_vote(frames: DataFrame, last: int = 5, least: int = 3) -> DataFrame:
    """vote over the last frames of an episode."""
    w = ordered("episode").rowsBetween(-(last - 1), 0)
    return frames.withColumn("vote", votes(F.collect_list(F.struct("name", "score")).over(w), least))


def time_vote(frames: DataFrame, seconds: int, least: int = 2) -> DataFrame:
    """vote over the last seconds of an episode: the largest mean score, then the most hits, then the smaller name."""
    w = Window.partitionBy("stream", "episode").orderBy("seconds").rangeBetween(-seconds, 0)
    h = F.collect_list(F.struct("name", "score")).over(w)
    names = F.array_distinct(F.transform(h, lambda x: x["name"]))

    def one(n):
        mine = F.filter(h, lambda x: x["name"] == n)
        mean = F.aggregate(F.array_sort(F.transform(mine, lambda x: x["score"])), F.lit(0.0), lambda a, x: a + x) / F.size(mine)
        return F.struct((-F.round(mean, 9)).alias("minus_mean"), (-F.size(mine)).alias("minus_hits"), n.alias("name"))

    top = F.array_min(F.filter(F.transform(names, one), lambda x: -x["minus_hits"] >= least))
    return frames.withColumn("vote", F.when(top.isNotNull(), F.struct(top["name"].alias("name"), (-top["minus_mean"]).alias("score"), (-top["minus_hits"]).alias("hits"))))


def stable(frames: DataFrame, least: int = 2) -> DataFrame:
    """stable: at least so many frames since the episode's start."""
    return frames.withColumn("run", F.row_number().over(ordered("episode"))).withColumn("stable", F.col("run") >= least)


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumn("rn", F.row_number().over(ordered()) - 1).where(F.col("rn") % n == 0)
