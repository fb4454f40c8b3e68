"""Live loops on streaming frames: stream, frame, ts, name, score.

stateless(), last_per_slot() and summary() are plain expressions and aggregations, which work on batches, too. The voting
loops keep the state of each stream: the last frames of its episode, which a frame without a face (or a box that jumps)
ends. Rows of a micro-batch are put in order of ts and frame, so a task holds one stream's rows of one micro-batch: sources
bound it (maxFilesPerTrigger, maxBytesPerTrigger). Rows that come in a later batch than their successors are taken as
they come; no watermark drops any."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.sources.shared import shared_dir

NO_FACE = "error"


def stateless(frames: DataFrame, least: float) -> DataFrame:
    return frames.withColumn("decision", F.when(F.col("name") == NO_FACE, "no_face").when(F.col("score") >= least, F.col("name")).otherwise("Unknown"))


def last_per_slot(frames: DataFrame, slot: str) -> DataFrame:
    """The last frame of each tumbling window, and how many there were."""
    w = F.window("ts", slot)
    return frames.groupBy("stream", w.alias("w")).agg(F.max(F.struct("ts", "frame")).alias("x"), F.count("*").alias("frames")).select("stream", F.col("w.start").alias("slot"), "x.frame", "frames")


def summary(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream").agg(F.count("*").alias("frames"), F.count_if(F.col("name") == NO_FACE).alias("without_face"), F.round(F.avg("score"), 4).alias("mean_score"), F.size(F.collect_set("name")).cast("long").alias("names"))


def vote(history: list[tuple[str, float]], least: int) -> tuple[str, float, int] | None:
    """The most frequent name, the first seen on ties, with its mean score and hits."""
    hits: dict[str, list[float]] = {}
    for name, score in history:
        hits.setdefault(name, []).append(score)
    name = max(hits, key=lambda n: len(hits[n]), default=None)
    if name is None or len(hits[name]) < least:
        return None
    return name, sum(hits[name]) / len(hits[name]), len(hits[name])


def voting(frames: DataFrame, last: int = 5, least: int = 3, no_face: str | None = NO_FACE) -> DataFrame:
    """stream, frame, name, score, hits of every frame at which the vote of its stream's last frames has a winner."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, scores = state.get if state.exists else ([], [])
        history = list(zip(names, scores))
        rows = pd.concat(list(batches))
        order, out = np.lexsort((rows["frame"].to_numpy(), rows["ts"].to_numpy())), []
        for frame, name, score in zip(*(rows[c].to_numpy()[order].tolist() for c in ("frame", "name", "score"))):
            if name == no_face:
                history = []
                continue
            history = [*history, (name, float(score))][-last:]
            if (won := vote(history, least)) is not None:
                out.append((key[0], frame, *won))
        state.update(([n for n, _ in history], [s for _, s in history]))
        if out:
            yield pd.DataFrame(dict(zip(("stream", "frame", "name", "score", "hits"), zip(*out))))

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame long, name string, score double, hits long", "names array<string>, scores array<double>", "append", GroupStateTimeout.NoTimeout)


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of boxes x, y, w, h."""
    w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    either = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / either if either > 0 else 0.0


def box_voting(frames: DataFrame, last: int = 5, least: int = 2, least_overlap: float = 0.20) -> DataFrame:
    """Like voting(), on frames(.., x, y, w, h): an episode also ends where the box overlaps the one before too little."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, scores, before = state.get if state.exists else ([], [], [])
        history, out = list(zip(names, scores)), []
        for r in pd.concat(list(batches)).sort_values(["ts", "frame"]).itertuples():
            if r.name == NO_FACE:
                history, before = [], []
                continue
            box = (int(r.x), int(r.y), int(r.w), int(r.h))
            if not before or overlap(tuple(before), box) < least_overlap:
                history = []
            history, before = [*history, (r.name, float(r.score))][-last:], list(box)
            if (won := vote(history, least)) is not None:
                out.append((key[0], r.frame, *won))
        state.update(([n for n, _ in history], [s for _, s in history], before))
        yield pd.DataFrame(out, columns=["stream", "frame", "name", "score", "hits"])

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame long, name string, score double, hits long", "names array<string>, scores array<double>, box array<long>", "append", GroupStateTimeout.NoTimeout)


def detect_or_track(frames: DataFrame, every: int = 3, least_points: int = 3, least_overlap: float = 0.05, stable: int = 2) -> DataFrame:
    """stream, frame, action, x, y, w, h, steady, recognize: the box that each stream carries from frame to frame.

    frames(stream, frame, ts, name, x, y, w, h, tx, ty, tw, th, points): the box that a detector would find (none where name is NO_FACE), and
    the box around the points that were followed into this frame, of which `points` are good. Every `every`-th frame detects, and any that
    has no box; others follow it while there are enough good points and the box overlaps the one before. Where following fails the box is
    held. A detection that finds nothing drops it. recognize: the box has stood for `stable` frames; a detection begins anew at 1."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, steady, box = state.get if state.exists else (0, 0, [])
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "frame"]).itertuples():
            count += 1
            moved = (int(r.tx), int(r.ty), int(r.tw), int(r.th))
            if box and count % every and r.points >= least_points and overlap(tuple(box), moved) > least_overlap:
                action, box, steady = "track", list(moved), steady + 1
            elif box and count % every:
                action = "hold"
            elif r.name == NO_FACE:
                action, box, steady = "miss", [], 0
            else:
                action, box, steady = "detect", [int(r.x), int(r.y), int(r.w), int(r.h)], 1
            out.append((key[0], r.frame, action, *(box or [None] * 4), steady, bool(box) and steady >= stable))
        state.update((count, steady, box))
        yield pd.DataFrame(out, columns=["stream", "frame", "action", "x", "y", "w", "h", "steady", "recognize"]).astype({c: "Int64" for c in "xywh"})

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame long, action string, x long, y long, w long, h long, steady long, recognize boolean", "count long, steady long, box array<long>", "append", GroupStateTimeout.NoTimeout)


def resets(frames: DataFrame, last: int = 5) -> DataFrame:
    """stream, frame, cleared: frames without a face, and how many held frames each of them clears."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,), out = state.get if state.exists else (0,), []
        rows = pd.concat(list(batches)).sort_values(["ts", "frame"])
        for frame, name in zip(rows["frame"], rows["name"]):
            if name == NO_FACE:
                out.append((key[0], frame, held))
                held = 0
            else:
                held = min(last, held + 1)
        state.update((held,))
        yield pd.DataFrame(out, columns=["stream", "frame", "cleared"])

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame long, cleared long", "held long", "append", GroupStateTimeout.NoTimeout)


def time_voting(frames: DataFrame, seconds: int, least: int = 2) -> DataFrame:
    """Like voting(), over the last seconds: the largest mean score, then the most hits, then the smaller name."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "frame"])
        out = []
        for ts, frame, name, score in zip(rows["ts"], rows["frame"], rows["name"], rows["score"]):
            if name == NO_FACE:
                held = []
                continue
            now = int(ts.timestamp() // 1)
            held = [h for h in held if h[0] >= now - seconds] + [(now, name, float(score))]
            by_name: dict[str, list[float]] = {}
            for _, n, s in held:
                by_name.setdefault(n, []).append(s)
            ranked = sorted((-round(sum(s) / len(s), 9), -len(s), n) for n, s in by_name.items() if len(s) >= least)
            if ranked:
                out.append((key[0], frame, ranked[0][2], -ranked[0][0], -ranked[0][1]))
        state.update(tuple([h[i] for h in held] for i in range(3)))
        yield pd.DataFrame(out, columns=["stream", "frame", "name", "score", "hits"])

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame long, name string, score double, hits long", "seconds array<long>, names array<string>, scores array<double>", "append", GroupStateTimeout.NoTimeout)


def counting(frames: DataFrame, least: float) -> DataFrame:
    """stream, frames, escalated so far, after each micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, escalated = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            escalated += int(((b["name"] != NO_FACE) & (b["score"] < least)).sum())
        state.update((n, escalated))
        yield pd.DataFrame([(key[0], n, escalated)], columns=["stream", "frames", "escalated"])

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frames long, escalated long", "frames long, escalated long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, schema: str) -> DataFrame:
    """Runs a stream over what is there now into Parquet files of the shared folder, and reads them."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(schema).parquet(f"{at}/out")


def drained_totals(totals: DataFrame, schema: str) -> DataFrame:
    """Like drained() for a streaming aggregation: after each micro-batch all rows so far are written anew, in a folder of
    their own; the last one is read."""
    spark, written = totals.sparkSession, []
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def put(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/{epoch}")
        written.append(epoch)

    q = totals.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(schema).parquet(f"{at}/out/{max(written)}") if written else spark.createDataFrame([], schema)


def rate_limited(frames: DataFrame, slot: str, delay: str = "1 hour") -> DataFrame:
    """last_per_slot() of a stream in append mode: a slot comes out when the watermark has passed it."""
    return last_per_slot(frames.withWatermark("ts", delay), slot)


def log_json(stats: DataFrame, path: str, every: str | None = "10 seconds", slot: str | None = None):
    """A rate-limited log: at each trigger the rows of the micro-batch are appended as JSON lines; with a slot only the last frame
    of each stream and slot. Without `every` what is there now is logged. Returns the query."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = last_per_slot(batch, slot) if slot else batch
        rows.withColumn("epoch", F.lit(epoch)).write.mode("append").json(f"{path}/log")

    w = stats.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
