"""Streams that share a key of the state against plain loops."""

import random

from pyspark.sql import functions as F

from matchloom.streaming import loops, sessions


def test_streams_of_a_key_keep_apart(spark, monkeypatch):
    monkeypatch.setattr(sessions, "KEYS", 2)
    rng, rows, at = random.Random(3), [], 1_700_000_000
    for i in range(600):
        at += rng.choice([0, 1, 30, 700])
        rows.append((rng.randrange(40), i, at, rng.choice(["a", "b", "error"]), float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "stream long, frame long, s long, name string, score double").select("stream", "frame", F.timestamp_seconds("s").alias("ts"), "name", "score")
    stream, _ = sessions.landed(df, 3)
    got = loops.drained(sessions.logged(stream, 600, 7200), sessions.SCHEMA).where("stream >= 0").select("kind", "stream", F.unix_seconds("start").alias("a"), F.unix_seconds("stop").alias("b"), "frame", "frames", "without_face").collect()
    slots, ended = {}, []
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        for _, frame, at, *_ in own:
            slots[s, at // 600 * 600] = (frame, slots.get((s, at // 600 * 600), (0, 0))[1] + 1)
        parts = [[own[0]]]
        for before, now in zip(own, own[1:]):
            if now[2] - before[2] > 7200:
                parts.append([])
            parts[-1].append(now)
        ended += [(s, p[0][2], p[-1][2], p[-1][1], len(p), sum(x[3] == "error" for x in p)) for p in parts]
    assert sorted((r.stream, r.a, r.frame, r.frames) for r in got if r.kind == "slot") == sorted((*k, *v) for k, v in slots.items())
    assert sorted((r.stream, r.a, r.b, r.frame, r.frames, r.without_face) for r in got if r.kind == "session") == sorted(ended)
    assert len(ended) > 60
