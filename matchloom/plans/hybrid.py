"""Two-engine cascade: P10-P12, J15, A24-A26, A31, F13, F22. Quality probes and distances come from lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import labels as L
from matchloom.operators import matching as M
from matchloom.operators import ranks
from matchloom.plans import tables as T
from matchloom.plans.registry import query
from matchloom.sources.shared import written

#: Anchors (distance, rate) of the first engine's false accepts.
ANCHORS = ((20.0, 1e-7), (40.0, 1e-5), (60.0, 1e-3), (73.04, 1e-2), (90.0, 0.5))

_CASES = """c AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS d, l_discount * 2 AS margin, l_tax * 1000 AS blur, l_quantity * 5 AS luma, l_discount * 100 AS noise, (l_partkey % 60)::DOUBLE AS pose, (l_suppkey % 100 + 20)::DOUBLE AS px FROM lineitem),
q AS (SELECT *, list_filter([CASE WHEN blur < 10 THEN 'blur' END, CASE WHEN luma < 15 OR luma > 245 THEN 'low_light' END, CASE WHEN noise > 9 THEN 'noise' END, CASE WHEN pose > 55 THEN 'off_pose' END, CASE WHEN px < 22 THEN 'small_face' END], lambda x: x IS NOT NULL) AS flags FROM c),
g AS (SELECT *, CASE WHEN len(flags) > 0 THEN 'quality:' || array_to_string(flags, ',') WHEN d > 73.04 AND d < 76.85 THEN 'ambiguous_band' WHEN margin < 0.05 THEN 'low_margin' WHEN d <= 73.04 THEN 'confident_accept' ELSE 'confident_reject' END AS reason FROM q),
h AS (SELECT *, reason NOT LIKE 'confident%' AS escalate FROM g)"""


def cases(spark, d) -> DataFrame:
    c = T.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("d"), (F.col("l_discount") * 2).alias("margin"), (F.col("l_tax") * 1000).alias("blur"), (F.col("l_quantity") * 5).alias("luma"),
        (F.col("l_discount") * 100).alias("noise"), (F.col("l_partkey") % 60).cast("double").alias("pose"), (F.col("l_suppkey") % 100 + 20).cast("double").alias("px"),
    )
    return c.withColumn("flags", M.quality_flags(*map(F.col, ("blur", "luma", "noise", "pose", "px")), 10, 15, 245, 9, 55, 22))


def gated(spark, d) -> DataFrame:
    return cases(spark, d).withColumn("g", M.gate(F.col("flags"), F.col("d"), F.col("margin"))).select("*", "g.escalate", "g.reason")


@query("p10_quality_flags", f"WITH {_CASES} SELECT array_to_string(flags, ',') AS flags, count(*) AS n FROM q GROUP BY 1")
def p10(spark, d):
    return cases(spark, d).groupBy(F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


@query("p11_escalation_gate", f"WITH {_CASES} SELECT reason, escalate, count(*) AS n, round(min(d), 6) AS lo, round(max(d), 6) AS hi FROM h GROUP BY reason, escalate")
def p11(spark, d):
    return gated(spark, d).groupBy("reason", "escalate").agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("lo"), F.round(F.max("d"), 6).alias("hi"))


def decided(g: DataFrame, mode: str) -> DataFrame:
    """accepted and engine by mode. In a cascade only rows that the gate escalates reach the second engine: the two sides
    are separate branches, so an expensive second engine would not run for the rest."""
    first, second = F.col("d") <= 76.85, F.col("margin") >= 0.1
    if mode == "cv_only":
        return g.select("reason", first.alias("accepted"), F.lit("first").alias("engine"))
    if mode == "dl_only":
        return g.select("reason", second.alias("accepted"), F.lit("second").alias("engine"))
    if mode == "parallel":
        return g.select("reason", F.when(F.col("escalate"), second).otherwise(F.col("reason") == "confident_accept").alias("accepted"), F.lit("both").alias("engine"))
    kept = g.where("not escalate").select("reason", (F.col("reason") == "confident_accept").alias("accepted"), F.lit("first").alias("engine"))
    return kept.unionByName(g.where("escalate").select("reason", second.alias("accepted"), F.lit("second").alias("engine")))


@query("p12_mode_dispatch", f"WITH {_CASES} SELECT mode, engine, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted FROM (SELECT 'cv_only' AS mode, 'first' AS engine, d <= 76.85 AS accepted FROM h UNION ALL SELECT 'dl_only', 'second', margin >= 0.1 FROM h UNION ALL SELECT 'parallel', 'both', CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END FROM h UNION ALL SELECT 'cascade', CASE WHEN escalate THEN 'second' ELSE 'first' END, CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END FROM h) GROUP BY mode, engine")
def p12(spark, d):
    """All modes in one pass over the rows: each row tells what every mode would do with it."""
    first, second, sure = F.col("d") <= 76.85, F.col("margin") >= 0.1, F.col("reason") == "confident_accept"
    both = F.when(F.col("escalate"), second).otherwise(sure)
    way = lambda mode, engine, accepted: F.struct(F.lit(mode).alias("mode"), engine.alias("engine"), accepted.alias("accepted"))
    ways = F.array(way("cv_only", F.lit("first"), first), way("dl_only", F.lit("second"), second), way("parallel", F.lit("both"), both), way("cascade", F.when(F.col("escalate"), "second").otherwise("first"), both))
    g = gated(spark, d).select(F.explode(ways).alias("w"))
    return g.groupBy("w.mode", "w.engine").agg(F.count("*").alias("n"), F.count_if("w.accepted").alias("accepted"))


def far_at(d, anchors=ANCHORS):
    """Rate between anchors, straight in the logarithm; held to the first and last, never below 1e-9."""
    out = F.lit(anchors[-1][1])
    for (d0, r0), (d1, r1) in reversed(list(zip(anchors, anchors[1:]))):
        between = F.pow(F.lit(10.0), F.log10(F.lit(r0)) + (d - d0) / (d1 - d0) * (F.log10(F.lit(r1)) - F.log10(F.lit(r0))))
        out = F.when(d <= d1, between).otherwise(out)
    return F.greatest(F.lit(1e-9), F.when(d <= anchors[0][0], F.lit(anchors[0][1])).otherwise(out))


@query("j15_piecewise_far", "WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"({x}::DOUBLE, {r}::DOUBLE, {y}::DOUBLE, {q}::DOUBLE)" for (x, r), (y, q) in zip(ANCHORS, ANCHORS[1:])) + ") t(d0, r0, d1, r1)), x AS (SELECT DISTINCT l_quantity * 2 AS d FROM lineitem), j AS (SELECT d, first(pow(10, log10(r0) + (d - d0) / (d1 - d0) * (log10(r1) - log10(r0))) ORDER BY d0) AS r FROM x JOIN a ON d >= d0 AND d <= d1 GROUP BY d) SELECT x.d, round(greatest(1e-9, CASE WHEN x.d <= 20 THEN 1e-7 WHEN x.d > 90 THEN 0.5 ELSE r END), 9) AS far FROM x LEFT JOIN j ON x.d = j.d")
def j15(spark, d):
    return T.read(spark, d, "lineitem").select((F.col("l_quantity") * 2).alias("d")).distinct().select("d", F.round(far_at(F.col("d")), 9).alias("far"))


@query(
    "j15_anchor_table",
    "WITH p AS (SELECT o_totalprice::DOUBLE AS d, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT d, sum(n) OVER (ORDER BY d)::DOUBLE / sum(n) OVER () AS f FROM p), i AS (SELECT d AS d0, f AS f0, lead(d) OVER (ORDER BY d) AS d1, lead(f) OVER (ORDER BY d) AS f1 FROM a), e AS (SELECT min(d) AS lo, max(d) AS hi, min(f) AS flo, max(f) AS fhi FROM a), x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE * 1.5 AS raw FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN raw <= lo THEN flo WHEN raw >= hi THEN fhi ELSE exp(ln(f0) + (raw - d0) / (d1 - d0) * (ln(f1) - ln(f0))) END, 9) AS far FROM x CROSS JOIN e ASOF LEFT JOIN i ON x.raw > i.d0",
)
def j15_table(spark, d):
    """Rates of false accepts between anchors, of which there are as many as order prices; each line's raw distance finds its interval."""
    p = T.read(spark, d, "orders").groupBy(F.col("o_totalprice").cast("double").alias("d")).agg(F.count("*").alias("n"))
    total = F.broadcast(p.agg(F.sum("n").alias("total")))
    anchors = ranks.running(p, "d", {"upto": "n"}).crossJoin(total).select("d", (F.col("upto") / F.col("total")).alias("f"))
    x = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("double") * 1.5).alias("raw"))
    return M.interpolated(x, "raw", written(anchors), "d", "f", "far").select("l_orderkey", "l_linenumber", F.round("far", 9).alias("far"))


@query("a24_latency", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 3) AS mean_ms, round(quantile_cont(value, 0.95), 3) AS p95_ms FROM events GROUP BY event_type")
def a24(spark, d):
    e = T.read(spark, d, "events").select(F.col("event_type").alias("stage"), "value")
    p95 = ranks.percentiles(e, "value", (0.95,), ["stage"])
    return e.groupBy("stage").agg(F.round(F.avg("value"), 3).alias("mean_ms")).join(p95, "stage").select("stage", "n", "mean_ms", F.round(F.col("p")[0], 3).alias("p95_ms"))


@query("a25_hybrid_evaluation", f"WITH {_CASES}, e AS (SELECT *, l_orderkey % 5 <> 0 AS known, l_linenumber % 4 <> 3 AS face, CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END AS accepted FROM h) SELECT string_split(reason, ':')[1] AS prefix, count(*) AS n, count(*) FILTER (WHERE face) AS evaluated, count(*) FILTER (WHERE face AND accepted) AS hits, round(count(*) FILTER (WHERE known AND face AND accepted)::DOUBLE / nullif(count(*) FILTER (WHERE known), 0), 6) AS tar, round(avg(escalate::INT), 6) AS escalation_rate FROM e GROUP BY 1")
def a25(spark, d):
    """Hits over evaluated rows; accepts of known ones over all known, those without a face included."""
    e = gated(spark, d).withColumn("known", F.col("l_orderkey") % 5 != 0).withColumn("face", F.col("l_linenumber") % 4 != 3)
    e = e.withColumn("accepted", F.when(F.col("escalate"), F.col("margin") >= 0.1).otherwise(F.col("reason") == "confident_accept"))
    known, face, ok = F.col("known"), F.col("face"), F.col("accepted")
    return e.groupBy(F.split("reason", ":")[0].alias("prefix")).agg(F.count("*").alias("n"), F.count_if(face).alias("evaluated"), F.count_if(face & ok).alias("hits"), F.round(F.count_if(known & face & ok) / F.nullif(F.count_if(known), F.lit(0)), 6).alias("tar"), F.round(F.avg(F.col("escalate").cast("int")), 6).alias("escalation_rate"))


@query("a26_detector_benchmark", "WITH i AS (SELECT l_orderkey, l_shipmode, count(*) AS n, avg(l_quantity) AS ms FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS l_shipmode FROM lineitem) GROUP BY ALL) SELECT l_shipmode AS detector, count(*) AS images, round(avg((n >= 1)::INT), 6) AS rate, count(*) FILTER (WHERE n = 1) AS exactly_one, sum(n - 1)::BIGINT AS extra, round(avg(ms), 4) AS mean_ms, round(median(ms), 4) AS median_ms, round(1000 / avg(ms), 4) AS fps FROM i GROUP BY 1")
def a26(spark, d):
    i = T.read(spark, d, "lineitem").groupBy("l_orderkey", F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("detector")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("ms"))
    middle = ranks.percentiles(i, "ms", (0.5,), ["detector"]).select("detector", F.round(F.col("p")[0], 4).alias("median_ms"))
    return i.groupBy("detector").agg(F.count("*").alias("images"), F.round(F.avg((F.col("n") >= 1).cast("int")), 6).alias("rate"), F.count_if(F.col("n") == 1).alias("exactly_one"), F.sum(F.col("n") - 1).alias("extra"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(1000 / F.avg("ms"), 4).alias("fps")).join(middle, "detector")


@query("a31_quality_fit", f"WITH {_CASES} SELECT round(quantile_cont(blur, 0.05), 6) AS blur, round(greatest(0, quantile_cont(luma, 0.02)), 6) AS luma_low, round(least(255, quantile_cont(luma, 0.98)), 6) AS luma_high, round(quantile_cont(noise, 0.95), 6) AS noise, round(quantile_cont(pose, 0.95), 6) AS pose, greatest(1, floor(quantile_cont(px, 0.05) * 0.9))::BIGINT AS px FROM c")
def a31(spark, d):
    asked = (("blur", 0.05), ("luma", 0.02), ("luma", 0.98), ("noise", 0.95), ("pose", 0.95), ("px", 0.05))
    probes = cases(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("probe"), F.col(c).cast("double").alias("x")) for c in ("blur", "luma", "noise", "pose", "px")])).alias("e")).select("e.*")
    p = ranks.percentiles(probes, "x", tuple(sorted({q for _, q in asked})), ["probe"])
    shares = sorted({q for _, q in asked})
    one = p.agg(*[F.max(F.when(F.col("probe") == c, F.col("p")[shares.index(q)])).alias(f"{c}_{q}") for c, q in asked])
    at = lambda c, q: F.col(f"`{c}_{q}`")
    return one.select(F.round(at("blur", 0.05), 6).alias("blur"), F.round(F.greatest(F.lit(0.0), at("luma", 0.02)), 6).alias("luma_low"), F.round(F.least(F.lit(255.0), at("luma", 0.98)), 6).alias("luma_high"), F.round(at("noise", 0.95), 6).alias("noise"), F.round(at("pose", 0.95), 6).alias("pose"), F.greatest(F.lit(1).cast("long"), F.floor(at("px", 0.05) * 0.9)).alias("px"))


@query("f13_feature_bytes", "SELECT p_partkey, (8 * 8 * pow(2, p_size % 9) * 4)::BIGINT AS histogram_bytes, (p_size * 4)::BIGINT AS subspace_bytes FROM part")
def f13(spark, d):
    return T.read(spark, d, "part").select("p_partkey", (8 * 8 * F.pow(F.lit(2.0), F.col("p_size") % 9) * 4).cast("long").alias("histogram_bytes"), (F.col("p_size") * 4).cast("long").alias("subspace_bytes"))


@query("f22_confidence", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, 100 * (1 - l_quantity / greatest(1, l_discount * 400)))), 6) AS confidence FROM lineitem")
def f22(spark, d):
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(L.confidence(F.col("l_quantity"), F.col("l_discount") * 400), 6).alias("confidence"))


@query("q20_hybrid_by_mode", f"WITH {_CASES}, e AS (SELECT *, CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END AS cascade, d <= 76.85 AS cv_only, margin >= 0.1 AS dl_only FROM h) SELECT escalate, count(*) AS n, count(*) FILTER (WHERE cascade) AS cascade, count(*) FILTER (WHERE cv_only) AS cv_only, count(*) FILTER (WHERE dl_only) AS dl_only, round(quantile_cont(d, 0.95), 6) AS p95 FROM e GROUP BY escalate")
def q20(spark, d):
    g = gated(spark, d)
    cascade = F.when(F.col("escalate"), F.col("margin") >= 0.1).otherwise(F.col("reason") == "confident_accept")
    return g.groupBy("escalate").agg(F.count("*").alias("n"), F.count_if(cascade).alias("cascade"), F.count_if(F.col("d") <= 76.85).alias("cv_only"), F.count_if(F.col("margin") >= 0.1).alias("dl_only")).join(ranks.percentiles(g, "d", (0.95,), ["escalate"]).select("escalate", F.round(F.col("p")[0], 6).alias("p95")), "escalate")
