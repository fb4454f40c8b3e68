"""What a live loop writes while it runs and when it ends, by event time.

Frames come as stream, frame, ts, name, score, in any number of micro-batches. The watermark tells when a slot of time or a session is
over: a timer of the state then emits it, once, whichever micro-batches its frames came in. A session ends when no frame has come for
longer than `gap`; its state goes with it, so streams that are over hold nothing. Frames later than the watermark are dropped, as
`delay` says how late a frame may be."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchloom.sources.shared import shared_dir
from matchloom.streaming.loops import NO_FACE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "kind string, stream long, start timestamp, stop timestamp, frame long, frames long, without_face long, mean_score double, average double"
KEEP, NEW = 0.85, 0.15


class Sessions(StatefulProcessor):
    """Per stream: the open slots, each with its last frame and count, and the session with its counters and moving average of scores."""

    def __init__(self, slot_ms: int, gap_ms: int):
        self.slot_ms, self.gap_ms = slot_ms, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value for each stream, as every look at the state is a call to the JVM
        self.slots = handle.getValueState("slots", "slot array<long>, micros array<long>, frame array<long>, frames array<long>, timer long")
        self.session = handle.getValueState("session", "first long, last long, frame long, frames long, without_face long, total double, average double")

    def _row(self, kind: str, key, start: int, stop: int, frame: int, frames: int, *rest) -> tuple:
        return (kind, key[0], start, stop, frame, frames, *(rest or (None, None, None)))

    def _ended(self, key, s) -> tuple:
        first, last, frame, frames, without_face, total, average = s
        return self._row("session", key, first, last, frame, frames, without_face, total / frames, average)

    def _due(self, last_micros: int) -> int:
        return last_micros // 1000 + self.gap_ms + 1

    def _open(self) -> tuple[dict[int, tuple], int | None]:
        """Open slots with time and number of their last frame and how many they had, and when the timer is due."""
        if not self.slots.exists():
            return {}, None
        slot, micros, frame, frames, timer = self.slots.get()
        return {k: v for k, *v in zip(slot, micros, frame, frames)}, timer

    def _keep(self, slots: dict[int, tuple], timer: int | None, s: tuple | None) -> None:
        """Puts slots away, with a timer for what is over first. One that is due earlier stays and is set again when it has come."""
        due = min([(k + 1) * self.slot_ms for k in slots] + ([self._due(s[1])] if s else []), default=None)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if timer is None:
            self.slots.clear()
        else:
            self.slots.update((list(slots), *([v[i] for v in slots.values()] for i in range(3)), timer))

    def _taken(self, key, slots: dict[int, tuple], s: tuple | None, rows, out: list[tuple]) -> tuple | None:
        """Takes rows (micros, frame, score, without a face) in order of time into open slots and the session, which is returned; sessions that end go to out."""
        for us, frame, score, lost in rows:
            slot, lost = us // 1000 // self.slot_ms, int(lost)
            before = slots.get(slot)
            slots[slot] = (us, frame, 1) if before is None else (*max((us, frame), tuple(before[:2])), before[2] + 1)
            if s and us - s[1] > self.gap_ms * 1000:  # more than one session in this batch
                out.append(self._ended(key, s))
                s = None
            if s is None:
                s = (us, us, frame, 1, lost, score, score)
            else:
                s = (min(s[0], us), max(s[1], us), frame, s[3] + 1, s[4] + lost, s[5] + score, score if s[6] == 0 else KEEP * s[6] + NEW * score)
        return s

    def _over(self, key, slots: dict[int, tuple], s: tuple | None, at: int, out: list[tuple]) -> tuple | None:
        """Puts out what is over at a watermark; the session that is left is returned."""
        for slot in sorted(k for k in slots if (k + 1) * self.slot_ms <= at):
            _, frame, frames = slots.pop(slot)
            out.append(self._row("slot", key, slot * self.slot_ms * 1000, (slot + 1) * self.slot_ms * 1000, frame, frames))
        if s and self._due(s[1]) <= at:
            out.append(self._ended(key, s))
            return None
        return s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, (slots, timer) = [], self._open()
        s = self.session.get() if self.session.exists() else None
        _, *columns = _columns(pd.concat(list(rows)))
        s = self._taken(key, slots, s, zip(*(c.tolist() for c in columns)), out)
        if s:
            self.session.update(s)
        self._keep(slots, timer, s)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out, (slots, _) = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [], self._open()
        before = self.session.get() if self.session.exists() else None
        s = self._over(key, slots, before, at, out)
        if before and not s:
            self.session.clear()
        self._keep(slots, None, s)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


#: Keys that streams are dealt to: a call to Python and a look at the state take far longer than the few rows that a stream has in a micro-batch.
KEYS = 256
_SLOTS = np.dtype([(c, np.int64) for c in ("stream", "slot", "micros", "frame", "frames")])
_SESSIONS = np.dtype([(c, np.int64) for c in ("stream", "first", "last", "frame", "frames", "without_face")] + [("total", np.float64), ("average", np.float64)])


class SharedSessions(Sessions):
    """Sessions of all streams of a key: their open slots and sessions are packed into one value, with one timer for what is over first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "slots binary, sessions binary, timer long")

    def _unpacked(self) -> tuple[dict[int, dict[int, tuple]], dict[int, tuple], int | None]:
        slots: dict[int, dict[int, tuple]] = {}
        if not self.held.exists():
            return slots, {}, None
        packed, sessions, timer = self.held.get()
        for stream, slot, *last in np.frombuffer(bytes(packed), _SLOTS).tolist():
            slots.setdefault(stream, {})[slot] = tuple(last)
        return slots, {stream: tuple(s) for stream, *s in np.frombuffer(bytes(sessions), _SESSIONS).tolist()}, timer

    def _pack(self, slots: dict[int, dict[int, tuple]], sessions: dict[int, tuple], timer: int | None) -> None:
        """Puts all away, with a timer for what is over first. One that is due earlier stays and is set again when it has come."""
        ends = [*((k + 1) * self.slot_ms for own in slots.values() for k in own), *(self._due(s[1]) for s in sessions.values())]
        due = min(ends, default=None)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if timer is None:
            self.held.clear()
            return
        packed = np.array([(stream, k, *v) for stream, own in slots.items() for k, v in own.items()], _SLOTS)
        self.held.update((packed.tobytes(), np.array([(stream, *s) for stream, s in sessions.items()], _SESSIONS).tobytes(), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, (slots, sessions, timer) = [], self._unpacked()
        streams, *columns = _columns(pd.concat(list(rows)))
        columns = [c.tolist() for c in columns]
        starts = [0, *(np.flatnonzero(np.diff(streams)) + 1).tolist(), len(streams)]
        for low, high in zip(starts, starts[1:]):
            stream = int(streams[low])
            sessions[stream] = self._taken((stream,), slots.setdefault(stream, {}), sessions.get(stream), zip(*(c[low:high] for c in columns)), out)
        self._pack(slots, sessions, timer)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out, (slots, sessions, _) = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [], self._unpacked()
        left = {stream: self._over((stream,), slots.setdefault(stream, {}), sessions.get(stream), at, out) for stream in {*slots, *sessions}}
        self._pack(slots, {k: s for k, s in left.items() if s}, None)
        if out:
            yield _frame(out)


def _columns(r: pd.DataFrame) -> list[np.ndarray]:
    """Stream, micros, frame, score and whether there is no face, in order of stream, time and frame."""
    at, frame, stream = r["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), r["frame"].to_numpy(), r["stream"].to_numpy()
    order = np.lexsort((frame, at, stream))
    return [c[order] for c in (stream, at, frame, r["score"].to_numpy(np.float64), (r["name"] == NO_FACE).to_numpy())]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = (object, "int64", "datetime64[us]", "datetime64[us]", "int64", "int64", "Int64", "float64", "float64")
    names = ("kind", "stream", "start", "stop", "frame", "frames", "without_face", "mean_score", "average")
    return pd.DataFrame({n: pd.array(x, dtype=t) if t == "Int64" else np.array(x, dtype=t) for n, t, x in zip(names, kinds, zip(*rows))})


def logged(frames: DataFrame, slot_seconds: int, gap_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """The rows of SCHEMA of a stream of frames: kind slot (the last frame of each slot of time of each stream, and how many it had) and kind
    session (its first and last time, last frame, frames, frames without a face, mean score and moving average), each once and when it is over."""
    spark = frames.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)  # the only store with timers and several states for each key
    marked = frames.withWatermark("ts", delay).withColumn("key", F.pmod(F.xxhash64("stream"), F.lit(KEYS)))
    return marked.groupBy("key").transformWithStateInPandas(SharedSessions(slot_seconds * 1000, gap_seconds * 1000), SCHEMA, "Append", "EventTime")


def landed(frames: DataFrame, cuts: int, over: str = "10000 days") -> tuple[DataFrame, str]:
    """A batch of frames as a live source would leave it: `cuts` files or sets of files in order of time, one after the other, and a last frame
    of no stream after all of them, which moves the watermark past the end. Returns a stream that takes a file at a time, and the folder."""
    spark = frames.sparkSession
    at = f"{shared_dir(spark)}/landed/{uuid.uuid4().hex}"
    times = frames.agg(F.percentile_approx(F.unix_micros("ts"), F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), F.lit(10_000)), F.max("ts")).first()
    edges = [None, *(times[0] or []), None]
    for low, high in zip(edges, edges[1:]):
        us = F.unix_micros("ts")
        part = frames.where((F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high))
        part.coalesce(1).write.mode("append").parquet(at)
    end = frames.sparkSession.range(1).select(F.lit(None).cast("long").alias("frame"), F.lit(-1).cast("long").alias("stream"), (F.lit(times[1]).cast("timestamp") + F.expr(f"INTERVAL {over}")).alias("ts"), F.lit(NO_FACE).alias("name"), F.lit(0.0).alias("score"))
    end.select(*[F.coalesce(F.col("frame"), F.lit(-1).cast("long")).alias("frame") if c == "frame" else F.col(c) for c in frames.columns]).write.mode("append").parquet(at)
    return spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(at), at


def log_json_once(rows: DataFrame, path: str, every: str | None = "10 seconds"):
    """Appends the slots of logged() as JSON lines while the stream runs; a micro-batch that is run again after a failure overwrites what it
    wrote. Without `every` what is there now is logged. Returns the query; read_log() reads the log."""

    def put(batch: DataFrame, epoch: int) -> None:
        slots = batch.where("kind = 'slot'").select("stream", F.unix_seconds("start").alias("slot"), "frame", "frames")
        slots.write.mode("overwrite").json(f"{path}/log/epoch={epoch}")

    w = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema("stream long, slot long, frame long, frames long, epoch int").json(f"{path}/log")
