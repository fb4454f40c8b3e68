"""Frame windows W13-W19 and the streaming loops R1-R9 on events: stream = user_id, name = event_type, score = value;
an `error` event is a frame without a face."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import boxes as B
from matchloom.operators import chunks as C
from matchloom.operators import frames as R
from matchloom.operators.spread import Spread
from matchloom.plans import tables as T
from matchloom.plans.registry import query, sql_of
from matchloom.sources.shared import shared_dir
from matchloom.streaming import loops, sessions


def frames(spark, d) -> DataFrame:
    e = T.read(spark, d, "events")
    return e.select(F.col("event_id").alias("frame"), F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.col("value").alias("score"))


def faces(spark, d) -> DataFrame:
    """Frames with a face, in episodes that frames without one end."""
    return R.episodes(frames(spark, d), F.col("name") == "error").where("name <> 'error'")


_F = """f AS (SELECT event_id AS frame, user_id AS stream, ts, event_type AS name, value AS score FROM events),
ep AS (SELECT *, sum((name = 'error')::INT) OVER (PARTITION BY stream ORDER BY ts, frame) AS episode FROM f), faces AS (SELECT * FROM ep WHERE name <> 'error')"""


_EMA = f"WITH RECURSIVE {_F}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts, frame) AS rn FROM f), r AS (SELECT stream, frame, rn, score AS average FROM n WHERE rn = 1 UNION ALL SELECT n.stream, n.frame, n.rn, CASE WHEN r.average = 0 THEN n.score ELSE 0.85::DOUBLE * r.average + 0.15::DOUBLE * n.score END FROM r JOIN n ON n.stream = r.stream AND n.rn = r.rn + 1) SELECT stream, frame, round(average + 1e-9, 5) AS average FROM r"


@query("w13_ema", _EMA)
def w13(spark, d):
    return R.ema(frames(spark, d), "score").withColumn("average", F.round(F.col("average") + 1e-9, 5))


@query("w13_ema_scan", _EMA)
def w13_scan(spark, d):
    """The same averages by a parallel scan over chunks of streams."""
    return R.ema_scanned(frames(spark, d), "score").withColumn("average", F.round(F.col("average") + 1e-9, 5))


_VOTES = """h AS (SELECT stream, frame, list({{'name': name, 'score': score}}) OVER (PARTITION BY stream, episode ORDER BY ts, frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM {src}),
x AS (SELECT stream, frame, u.i AS i, h[u.i].name AS name, h[u.i].score AS score FROM h, unnest(range(1, 6)) AS u(i) WHERE u.i <= len(h)),
t AS (SELECT stream, frame, name, count(*) AS hits, min(i) AS first_seen, avg(score) AS score FROM x GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY stream, frame ORDER BY hits DESC, first_seen) AS rn FROM t)"""


@query("w14_count_vote", f"WITH {_F}, {_VOTES.format(src='faces')} SELECT stream, frame, name, round(score, 6) AS score, hits FROM v WHERE rn = 1 AND hits >= 3")
def w14(spark, d):
    return R.count_vote(faces(spark, d)).where("vote is not null").select("stream", "frame", "vote.name", F.round("vote.score", 6).alias("score"), F.col("vote.hits").cast("long").alias("hits"))


_SECONDS = 4 * 3600


@query("w15_time_vote", f"WITH {_F}, s AS (SELECT *, epoch(ts)::BIGINT AS seconds FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM faces)), t AS (SELECT a.stream, a.frame, b.name, count(*) AS hits, round(avg(b.score), 9) AS score FROM s a JOIN s b ON a.stream = b.stream AND a.episode = b.episode AND b.seconds BETWEEN a.seconds - {_SECONDS} AND a.seconds GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY stream, frame ORDER BY score DESC, hits DESC, name) AS rn FROM t WHERE hits >= 2) SELECT stream, frame, name, round(score, 6) AS score, hits FROM v WHERE rn = 1")
def w15(spark, d):
    f = faces(spark, d).withColumn("seconds", F.floor(F.unix_micros("ts") / 1_000_000))
    return R.time_vote(f, _SECONDS).where("vote is not null").select("stream", "frame", "vote.name", F.round("vote.score", 6).alias("score"), F.col("vote.hits").cast("long").alias("hits"))


_BOXES = "bx AS (SELECT *, floor(score * 3)::BIGINT % 60 AS x, floor(score * 7)::BIGINT % 60 AS y, 40 AS w, 40 AS h FROM faces), lg AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM bx WINDOW o AS (PARTITION BY stream ORDER BY ts, frame)), io AS (SELECT *, CASE WHEN px IS NULL THEN NULL ELSE greatest(0, 40 - abs(x - px)) * greatest(0, 40 - abs(y - py)) END AS i FROM lg), re AS (SELECT *, i IS NULL OR i::DOUBLE / (3200 - i) < 0.2 AS reset FROM io)"


def boxed(spark, d):
    s = F.col("score")
    near = lambda k: (F.floor(s * k).cast("long") % 60)
    return faces(spark, d).withColumn("box", F.struct(near(3).alias("x"), near(7).alias("y"), F.lit(40).alias("w"), F.lit(40).alias("h")))


@query("w16_iou_reset", f"WITH {_F}, {_BOXES} SELECT stream, frame, sum(reset::INT) OVER (PARTITION BY stream ORDER BY ts, frame)::BIGINT AS episode FROM re")
def w16(spark, d):
    """A new episode where the box overlaps the one before by less than a fifth."""
    b = boxed(spark, d).withColumn("before", F.lag("box").over(R.ordered()))
    reset = F.col("before").isNull() | (B.iou(F.col("box"), F.col("before")) < 0.20)
    return R.episodes(b.drop("episode").withColumn("reset", reset), F.col("reset")).select("stream", "frame", "episode")


@query("w17_slot_vote", f"WITH {_F}, sl AS (SELECT * REPLACE (stream * 3 + frame % 3 AS stream) FROM f), e2 AS (SELECT *, 0 AS episode FROM sl), {_VOTES.format(src='e2')} SELECT stream, frame, name, hits FROM v WHERE rn = 1")
def w17(spark, d):
    """A vote for each detection slot, over all names."""
    f = frames(spark, d).withColumn("stream", F.col("stream") * 3 + F.col("frame") % 3).withColumn("episode", F.lit(0))
    return R.count_vote(f, 5, 1).select("stream", "frame", "vote.name", F.col("vote.hits").cast("long").alias("hits"))


@query("w18_every_nth", f"WITH {_F} SELECT stream, frame FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts, frame) - 1 AS rn FROM f) WHERE rn % 3 = 0")
def w18(spark, d):
    return R.every_nth(frames(spark, d), 3).select("stream", "frame")


@query("w19_stable_gate", f"WITH {_F} SELECT stream, frame, row_number() OVER (PARTITION BY stream, episode ORDER BY ts, frame) >= 2 AS stable FROM faces")
def w19(spark, d):
    return R.stable(faces(spark, d)).select("stream", "frame", "stable")


def faces_placed(spark, d) -> DataFrame:
    """faces() in chunks: episodes are counted over chunks, too."""
    return C.episodes(C.placed(frames(spark, d)), F.col("name") == "error").where("name <> 'error'")


@query("w14_count_vote_scan", sql_of("w14_count_vote"))
def w14_scan(spark, d):
    """The same votes, each chunk of a stream with the frames handed on to it."""
    v = C.count_vote(faces_placed(spark, d)).where("vote is not null")
    return v.select("stream", "frame", "vote.name", F.round("vote.score", 6).alias("score"), F.col("vote.hits").cast("long").alias("hits"))


@query("w16_iou_reset_scan", sql_of("w16_iou_reset"))
def w16_scan(spark, d):
    s = F.col("score")
    near = lambda k: (F.floor(s * k).cast("long") % 60)
    b = C.placed(frames(spark, d).where("name <> 'error'").withColumn("box", F.struct(near(3).alias("x"), near(7).alias("y"), F.lit(40).alias("w"), F.lit(40).alias("h"))))
    b = C.lagged(b, ["stream"], "box", "before")
    return C.episodes(b, F.col("before").isNull() | (B.iou(F.col("box"), F.col("before")) < 0.20)).select("stream", "frame", F.col("episode").cast("long").alias("episode"))


@query("w18_every_nth_scan", sql_of("w18_every_nth"))
def w18_scan(spark, d):
    return C.numbered(C.placed(frames(spark, d)), ["stream"]).where("rn % 3 = 0").select("stream", "frame")


@query("w19_stable_scan", sql_of("w19_stable_gate"))
def w19_scan(spark, d):
    return C.numbered(faces_placed(spark, d), ["stream", "episode"]).select("stream", "frame", (F.col("rn") >= 1).alias("stable"))


@query("r4_stateless_loop", f"WITH {_F} SELECT stream, frame, CASE WHEN name = 'error' THEN 'no_face' WHEN score >= 50 THEN name ELSE 'Unknown' END AS decision FROM f")
def r4(spark, d):
    """Frame by frame, without state."""
    out = loops.stateless(live(spark, d), 50).select("stream", "frame", "decision")
    return loops.drained(out, "stream long, frame long, decision string")


_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def live(spark, d) -> DataFrame:
    """The same frames as a stream."""
    e = spark.readStream.schema(_SCHEMA).option("maxBytesPerTrigger", str(256 << 20)).parquet(f"{d}/events.parquet*")
    return e.select(F.col("event_id").alias("frame"), F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.col("value").alias("score"))


@query("r1_live_count_vote", f"WITH {_F}, {_VOTES.format(src='faces')} SELECT stream, frame, name, round(score, 6) AS score, hits FROM v WHERE rn = 1 AND hits >= 3")
def r1(spark, d):
    """The counted vote as a stateful stream, drained into a table: the same rows as the batch windows."""
    out = loops.drained(loops.voting(live(spark, d)), "stream long, frame long, name string, score double, hits long")
    return out.withColumn("score", F.round("score", 6))


@query("r2_live_counters", f"WITH {_F} SELECT stream, count(*) AS frames, count(*) FILTER (WHERE name <> 'error' AND score < 50) AS escalated FROM f GROUP BY stream")
def r2(spark, d):
    """Escalation counters of each stream, kept as state; the last row of each stream is its total."""
    out = loops.drained(loops.counting(live(spark, d), 50.0), "stream long, frames long, escalated long")
    return out.groupBy("stream").agg(F.max("frames").alias("frames"), F.max("escalated").alias("escalated"))


@query("r3_live_time_vote", f"WITH {_F}, s AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS seconds, row_number() OVER (PARTITION BY stream ORDER BY ts, frame) AS pos FROM faces), t AS (SELECT a.stream, a.frame, b.name, count(*) AS hits, round(avg(b.score), 9) AS score FROM s a JOIN s b ON a.stream = b.stream AND a.episode = b.episode AND b.pos <= a.pos AND b.seconds >= a.seconds - {_SECONDS} GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY stream, frame ORDER BY score DESC, hits DESC, name) AS rn FROM t WHERE hits >= 2) SELECT stream, frame, name, hits FROM v WHERE rn = 1")
def r3(spark, d):
    out = loops.drained(loops.time_voting(live(spark, d), _SECONDS), "stream long, frame long, name string, score double, hits long")
    return out.select("stream", "frame", "name", "hits")


@query("r5_live_slot_vote", f"WITH {_F}, sl AS (SELECT * REPLACE (stream * 3 + frame % 3 AS stream) FROM f), e2 AS (SELECT *, 0 AS episode FROM sl), {_VOTES.format(src='e2')} SELECT stream, frame, name, hits FROM v WHERE rn = 1")
def r5(spark, d):
    slots = live(spark, d).withColumn("stream", F.col("stream") * 3 + F.col("frame") % 3)
    out = loops.drained(loops.voting(slots, 5, 1, no_face=None), "stream long, frame long, name string, score double, hits long")
    return out.select("stream", "frame", "name", "hits")


@query("r7_no_face_resets", f"WITH {_F}, p AS (SELECT *, count(*) FILTER (WHERE name <> 'error') OVER (PARTITION BY stream, episode ORDER BY ts, frame) AS n FROM ep), l AS (SELECT stream, frame, name, lag(CASE WHEN name = 'error' THEN 0 ELSE n END, 1, 0) OVER (PARTITION BY stream ORDER BY ts, frame) AS n FROM p) SELECT stream, frame, least(5, n)::BIGINT AS cleared FROM l WHERE name = 'error'")
def r7(spark, d):
    """Frames without a face clear what the vote held."""
    return loops.drained(loops.resets(live(spark, d)), "stream long, frame long, cleared long")


_SLOTS = f"WITH {_F} SELECT stream, epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS slot, last(frame ORDER BY ts, frame) AS frame, count(*) AS frames FROM f GROUP BY ALL"


@query("r8_rate_limited", _SLOTS)
def r8(spark, d):
    """The last frame of each slot, as totals of a stream."""
    out = loops.drained_totals(loops.last_per_slot(live(spark, d), "6 hours"), "stream long, slot timestamp, frame long, frames long")
    return out.select("stream", F.unix_seconds("slot").alias("slot"), "frame", "frames")


@query("r9_session_summary", f"WITH {_F} SELECT stream, count(*) AS frames, count(*) FILTER (WHERE name = 'error') AS without_face, round(avg(score), 4) AS mean_score, count(DISTINCT name) AS names FROM f GROUP BY stream")
def r9(spark, d):
    """Totals of the session when the stream has ended."""
    return loops.drained_totals(loops.summary(live(spark, d)), "stream long, frames long, without_face long, mean_score double, names long")


@query("k7_fps_log", _SLOTS)
def k7(spark, d):
    """A rate-limited JSON log of a stream, read back."""
    at = f"{shared_dir(spark)}/logs/{uuid.uuid4().hex}"
    loops.log_json(live(spark, d), at, None, "6 hours").awaitTermination()
    log = spark.read.schema("stream long, slot timestamp, frame long, frames long, epoch long").json(f"{at}/log")
    return log.select("stream", F.unix_seconds("slot").alias("slot"), "frame", "frames")


@query(
    "i18_detect_or_track",
    f"""WITH RECURSIVE {_F}, n AS (SELECT stream, frame, name, row_number() OVER (PARTITION BY stream ORDER BY ts, frame) AS rn, floor(score * 3)::BIGINT % 60 AS x, floor(score * 7)::BIGINT % 60 AS y, floor(score * 5)::BIGINT % 60 AS tx, floor(score * 11)::BIGINT % 60 AS ty, floor(score)::BIGINT % 7 AS points FROM f),
    r AS (SELECT stream, rn, frame, CASE WHEN name = 'error' THEN 'miss' ELSE 'detect' END AS action, CASE WHEN name <> 'error' THEN x END AS x, CASE WHEN name <> 'error' THEN y END AS y, (name <> 'error')::BIGINT AS steady FROM n WHERE rn = 1
    UNION ALL SELECT stream, rn, frame, action, CASE action WHEN 'track' THEN tx WHEN 'hold' THEN bx WHEN 'detect' THEN x END, CASE action WHEN 'track' THEN ty WHEN 'hold' THEN by_ WHEN 'detect' THEN y END, CASE action WHEN 'track' THEN steady + 1 WHEN 'hold' THEN steady WHEN 'detect' THEN 1 ELSE 0 END
    FROM (SELECT n.*, r.x AS bx, r.y AS by_, r.steady, CASE WHEN r.x IS NOT NULL AND n.rn % 3 <> 0 THEN CASE WHEN points >= 3 AND inter::DOUBLE / (3200 - inter) > 0.05 THEN 'track' ELSE 'hold' END WHEN name = 'error' THEN 'miss' ELSE 'detect' END AS action
        FROM r JOIN n ON n.stream = r.stream AND n.rn = r.rn + 1, LATERAL (SELECT coalesce(greatest(0, least(r.x, n.tx) + 40 - greatest(r.x, n.tx)) * greatest(0, least(r.y, n.ty) + 40 - greatest(r.y, n.ty)), 0) AS inter)))
    SELECT stream, frame, action, x, y, steady, x IS NOT NULL AND steady >= 2 AS recognize FROM r""",
)
def i18(spark, d):
    """A box followed between detections as a stateful stream: every third frame detects, others follow the box or hold it."""
    near = lambda k: F.floor(F.col("score") * k).cast("long") % 60
    side = F.lit(40)
    boxed = live(spark, d).withColumns({"x": near(3), "y": near(7), "w": side, "h": side, "tx": near(5), "ty": near(11), "tw": side, "th": side, "points": F.floor("score").cast("long") % 7})
    out = loops.drained(loops.detect_or_track(boxed), "stream long, frame long, action string, x long, y long, w long, h long, steady long, recognize boolean")
    return out.drop("w", "h")


SLOT, GAP, CUTS = 6 * 3600, 12 * 3600, 4


@query("r8_event_time_slots", _SLOTS)
def r8_slots(spark, d):
    """The last frame of each slot, emitted once when the watermark has passed the slot, over several micro-batches in order of time."""
    stream, _ = sessions.landed(frames(spark, d), CUTS)
    out = loops.drained(sessions.logged(stream, SLOT, GAP), sessions.SCHEMA)
    return out.where("kind = 'slot'").select("stream", F.unix_seconds("start").alias("slot"), "frame", "frames")


@query(
    "r9_session_end",
    f"WITH {_F}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY stream ORDER BY ts, frame)) <= {GAP * 1_000_000} THEN 0 ELSE 1 END AS new FROM f), s AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts, frame) AS session FROM g) SELECT stream, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, last(frame ORDER BY ts, frame) AS frame, count(*) AS frames, count(*) FILTER (WHERE name = 'error') AS without_face, round(avg(score), 4) AS mean_score FROM s GROUP BY stream, session",
)
def r9_sessions(spark, d):
    """A summary of each session of each stream, emitted when no frame has come for twelve hours of event time."""
    stream, _ = sessions.landed(frames(spark, d), CUTS)
    out = loops.drained(sessions.logged(stream, SLOT, GAP), sessions.SCHEMA).where("kind = 'session'")
    # a mean of decimals may be a half at the fifth digit: it is rounded times 10,000, as SQL does, not by its decimal form
    mean = F.round(F.col("mean_score") * 10_000, 0) / 10_000
    return out.select("stream", F.unix_micros("start").alias("started"), F.unix_micros("stop").alias("ended"), "frame", "frames", "without_face", mean.alias("mean_score"))


@query("k7_event_time_log", _SLOTS)
def k7_log(spark, d):
    """The rate-limited JSON log of the same stream, read back: a slot is logged once, whichever micro-batches its frames came in."""
    stream, at = sessions.landed(frames(spark, d), CUTS)
    sessions.log_json_once(sessions.logged(stream, SLOT, GAP), f"{at}-log", None).awaitTermination()
    return sessions.read_log(spark, f"{at}-log").select("stream", "slot", "frame", "frames")


@query("r10_bounded_pair_pass", f"WITH {T.FEAT}, p AS (SELECT sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM feat a JOIN feat b ON a.vec_id < b.vec_id) SELECT floor(d * 10)::BIGINT AS bin, count(*) AS n FROM p GROUP BY 1")
def r10(spark, d):
    """All unique pairs by tiles, never held: only counts leave the tasks."""
    s = Spread(T.feat(spark, d), "vec_id", "v", 1, floor=True)
    n, below = s.below(s.places())
    upto = [[*sorted(below[g].items()), (None, n[g])] for g in n]
    rows = [(k, m - b) for each in upto for (k, b), (_, m) in zip(each, each[1:]) if m > b]
    return spark.createDataFrame(rows, "bin long, n long")
