"""Streaming state over several micro-batches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import chunks as C
from matchloom.operators import frames as R
from matchloom.streaming import loops, sessions

SCHEMA = "stream long, frame long, ts timestamp, name string, score double"


def made(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, at = [], 1_700_000_000.0
    for i in range(n):
        at += rng.choice([0.0, 1.0, 30.0, 4000.0])  # ties, and gaps that end sessions
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, at, rng.choice(["a", "b", "error"]), float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "stream long, frame long, s double, name string, score double")
    return rows, df.select("stream", "frame", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "name", "score")


@pytest.mark.parametrize("cuts", [1, 4])
def test_slots_and_sessions_come_once(spark, cuts):
    rows, df = made(spark)
    slot, gap = 600, 3600
    stream, _ = sessions.landed(df, cuts)
    got = loops.drained(sessions.logged(stream, slot, gap), sessions.SCHEMA).where("stream >= 0").select("kind", "stream", F.unix_micros("start").alias("a"), F.unix_micros("stop").alias("b"), "frame", "frames", "without_face", "mean_score", "average").collect()
    slots, ended = {}, []
    for s in (1, 2, 3):
        own = sorted((at, f, name, score) for st, f, at, name, score in rows if st == s)
        for at, f, *_ in own:
            k = (s, int(at // slot) * slot)
            slots[k] = (f, slots.get(k, (0, 0))[1] + 1)
        parts = [[own[0]]]
        for before, now in zip(own, own[1:]):
            if now[0] - before[0] > gap:
                parts.append([])
            parts[-1].append(now)
        for p in parts:
            average = 0.0
            for x in p:
                average = x[3] if average == 0 else 0.85 * average + 0.15 * x[3]
            ended.append((s, int(p[0][0] * 1e6), int(p[-1][0] * 1e6), p[-1][1], len(p), sum(x[2] == "error" for x in p), round(sum(x[3] for x in p) / len(p), 9), round(average, 9)))
    assert sorted((r.stream, r.a // 1_000_000, r.frame, r.frames) for r in got if r.kind == "slot") == sorted((s, at, f, n) for (s, at), (f, n) in slots.items())
    assert sorted((r.stream, r.a, r.b, r.frame, r.frames, r.without_face, round(r.mean_score, 9), round(r.average, 9)) for r in got if r.kind == "session") == sorted(ended)
    assert len(ended) > 6 and all(r.b - r.a == slot * 1_000_000 for r in got if r.kind == "slot")


def test_log_has_each_slot_once_and_a_batch_run_again_overwrites(spark):
    _, df = made(spark, 120)
    stream, at = sessions.landed(df, 3)
    sessions.log_json_once(sessions.logged(stream, 600, 3600), f"{at}-log", None).awaitTermination()
    log = sessions.read_log(spark, f"{at}-log").where("stream >= 0")
    assert log.count() == log.select("stream", "slot").distinct().count() == df.select("stream", F.floor(F.unix_seconds("ts") / 600)).distinct().count()
    assert log.agg(F.sum("frames")).first()[0] == 120


def plain_box_loop(rows, every, least_points, least_overlap, stable):
    box, steady, out = None, 0, []
    for n, r in enumerate(rows, 1):
        tracked = False
        if box and n % every and r["points"] >= least_points and loops.overlap(box, r["moved"]) > least_overlap:
            box, steady, tracked, action = r["moved"], steady + 1, True, "track"
        if not tracked:
            if n % every == 0 or box is None:
                box, action = (None, "miss") if r["name"] == "error" else (r["box"], "detect")
                steady = int(box is not None)
            else:
                action = "hold"
        out.append((r["frame"], action, box, steady, box is not None and steady >= stable))
    return out


@pytest.mark.parametrize("every, cuts", [(3, 4), (1, 1), (5, 2)])
def test_detect_or_track_is_the_plain_loop(spark, tmp_path, every, cuts):
    rows, df = made(spark, 300, seed=every)
    n = lambda k, m: (F.col("frame") * k) % m
    boxed = df.withColumns({"x": n(7, 60), "y": n(11, 50), "w": F.lit(40).cast("long"), "h": F.lit(30).cast("long"), "tx": n(5, 70), "ty": n(3, 60), "tw": F.lit(35).cast("long"), "th": F.lit(40).cast("long"), "points": n(13, 6)})
    at = str(tmp_path / "landed")
    for k in range(cuts):  # in order of time, a file at a time
        boxed.where((F.col("frame") >= k * 300 // cuts) & (F.col("frame") < (k + 1) * 300 // cuts)).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(boxed.schema).option("maxFilesPerTrigger", 1).parquet(at)
    out = loops.drained(loops.detect_or_track(stream, every), "stream long, frame long, action string, x long, y long, w long, h long, steady long, recognize boolean").collect()
    seen = set()
    for s in (1, 2, 3):
        own = [{"frame": f, "name": name, "box": (f * 7 % 60, f * 11 % 50, 40, 30), "moved": (f * 5 % 70, f * 3 % 60, 35, 40), "points": f * 13 % 6} for st, f, at, name, _ in sorted(rows, key=lambda r: (r[2], r[1])) if st == s]
        got = sorted((r.frame, r.action, None if r.x is None else (r.x, r.y, r.w, r.h), r.steady, r.recognize) for r in out if r.stream == s)
        assert got == sorted(plain_box_loop(own, every, 3, 0.05, 2))
        seen |= {r[1] for r in got}
    assert seen == ({"detect", "miss"} if every == 1 else {"detect", "miss", "track", "hold"})


def test_scan_of_a_stream_that_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(1 if i % 10 else 2 + i % 3, i, i // 3, rng.choice([0.0, 0.0, rng.random() * 50])) for i in range(6000)]
    rows += [(9, i, i, rng.choice([-1.0, 0.0, 1.0])) for i in range(200)]  # its average comes back to 0
    df = spark.createDataFrame(rows, "stream long, frame long, ts long, x double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {(r.stream, r.frame): r.average for r in R.ema_scanned(df, "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for s in {r[0] for r in rows}:
        average = 0.0
        for _, f, _, x in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            average = x if average == 0 else 0.85 * average + 0.15 * x
            want[s, f] = average
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert R.ema_scanned(df.limit(0), "x").collect() == []


def test_windows_over_chunks_of_a_stream_that_holds_most_rows(spark):
    """Against windows over whole streams; chunks of fewer rows than are handed on included."""
    rng = random.Random(7)
    rows = [(1 if i % 9 else 2 + i % 4, i, i // 2, rng.choice(["a", "b", "c", "error"] if i % 500 else ["error"]), float(rng.randrange(50))) for i in range(2500)]
    df = spark.createDataFrame(rows, "stream long, frame long, ts long, name string, score double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("3", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # or small ranges would be put together
        try:
            placed = C.placed(df)
            assert placed.where("stream = 1").select("part").distinct().count() > 2
            reset = F.col("name") == "error"
            own = C.episodes(placed, reset)
            want = R.episodes(df, reset)
            assert rows_of(own.select("stream", "frame", "episode")) == rows_of(want.select("stream", "frame", "episode"))
            for last, least in ((5, 3), (9, 2)):
                a, b = C.count_vote(own.where("not name = 'error'"), last, least), R.count_vote(want.where("not name = 'error'"), last, least)
                assert rows_of(a.select("stream", "frame", "vote")) == rows_of(b.select("stream", "frame", "vote"))
            lag = df.withColumn("b", F.lag("score").over(R.ordered()))
            assert rows_of(C.lagged(placed, ["stream"], "score", "b").select("stream", "frame", "b")) == rows_of(lag.select("stream", "frame", "b"))
            assert rows_of(C.numbered(placed, ["stream"]).where("rn % 7 = 0").select("stream", "frame")) == rows_of(R.every_nth(df, 7).select("stream", "frame"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_one_timer_for_open_slots():
    """Any number of open slots of a stream takes one timer and one look at the state; a timer emits all that is over."""
    import pandas as pd

    from matchloom.streaming import sessions

    class Value:
        held, looks = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            self.looks += 1
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.values, self.timers = {}, []

        def getValueState(self, name, schema):
            return self.values.setdefault(name, Value())

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 50_000)
        getExpiryTimeInMs = staticmethod(lambda: 1_000)

    p, handle = sessions.Sessions(1_000, 10_000_000), Handle()
    p.init(handle)
    rows = pd.DataFrame({"stream": 7, "frame": range(100), "ts": pd.to_datetime([i * 999 for i in range(100)], unit="ms"), "name": "view", "score": 1.0})
    assert not list(p.handleInputRows((7,), iter([rows[50:], rows[:50]]), Now))
    assert handle.timers == [1_000] and handle.values["slots"].looks == 0
    (out,) = p.handleExpiredTimer((7,), Now, Now)
    assert handle.timers == [1_000, 51_000]  # the first has come
    want = {}
    for i in range(100):
        if i * 999 < 50_000:
            want[i * 999 // 1000 * 1_000_000] = (i, want.get(i * 999 // 1000 * 1_000_000, (0, 0))[1] + 1)
    assert {int(r.start.value // 1000): (r.frame, r.frames) for r in out.itertuples()} == want and set(out["kind"]) == {"slot"}
