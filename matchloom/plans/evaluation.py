"""Evaluation aggregates A1-A6, A9-A19, A27-A33, A36, A37; operating points W4, P15."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import curves, pairs, ranks, tiles
from matchloom.operators import matching as M
from matchloom.plans import tables as T
from matchloom.plans.registry import query

_EVAL = f"WITH {T.MATCHES}, e AS (SELECT *, CASE WHEN score >= 0.2 THEN best_person ELSE 'Unknown' END AS predicted FROM matches), o AS (SELECT *, CASE WHEN known THEN predicted = person ELSE predicted = 'Unknown' END AS ok FROM e)"


def _evaluated(spark, d, t=0.2):
    e = T.matches(spark, d).withColumn("predicted", M.accepted_by_cosine(F.col("best_person"), F.col("score"), t))
    return e.withColumn("ok", M.correct(F.col("person"), F.col("predicted"), F.col("known")))


def balanced(known_hits, known, unknown_hits, unknown):
    """The mean of both rates, 0 where a side is empty."""
    return F.when((known > 0) & (unknown > 0), (known_hits / known + unknown_hits / unknown) / 2).otherwise(F.lit(0.0))


@query("a1_bucket_counters", _EVAL + " SELECT coalesce(bucket, 'overall') AS bucket, count(*) AS evaluated, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE known AND ok) AS known_correct, count(*) FILTER (WHERE NOT known AND ok) AS unknown_correct, count(*) FILTER (WHERE known AND predicted = 'Unknown') AS false_reject, count(*) FILTER (WHERE NOT known AND predicted <> 'Unknown') AS false_accept, count(*) FILTER (WHERE known AND NOT ok AND predicted <> 'Unknown') AS misidentified FROM o GROUP BY GROUPING SETS ((bucket), ())")
def a1(spark, d):
    known, ok, unknown = F.col("known"), F.col("ok"), F.col("predicted") == "Unknown"
    out = _evaluated(spark, d).rollup("bucket").agg(
        F.count("*").alias("evaluated"), F.count_if(ok).alias("correct"), F.count_if(known & ok).alias("known_correct"), F.count_if(~known & ok).alias("unknown_correct"), F.count_if(known & unknown).alias("false_reject"), F.count_if(~known & ~unknown).alias("false_accept"), F.count_if(known & ~ok & ~unknown).alias("misidentified")
    )
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("overall")))


@query("a2_rates", _EVAL + ", c AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE ok) AS h, count(*) FILTER (WHERE known) AS k, count(*) FILTER (WHERE known AND ok) AS kh, count(*) FILTER (WHERE NOT known) AS u, count(*) FILTER (WHERE NOT known AND ok) AS uh FROM o GROUP BY bucket) SELECT bucket, round(h::DOUBLE / n, 6) AS hit_rate, round(CASE WHEN k > 0 THEN kh::DOUBLE / k ELSE 0 END, 6) AS known_accuracy, round(CASE WHEN u > 0 THEN uh::DOUBLE / u ELSE 0 END, 6) AS unknown_rejection, round(CASE WHEN k > 0 AND u > 0 THEN (kh::DOUBLE / k + uh::DOUBLE / u) / 2 ELSE 0 END, 6) AS balanced FROM c")
def a2(spark, d):
    known, ok = F.col("known"), F.col("ok")
    c = _evaluated(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(ok).alias("h"), F.count_if(known).alias("k"), F.count_if(known & ok).alias("kh"), F.count_if(~known).alias("u"), F.count_if(~known & ok).alias("uh"))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return c.select("bucket", rate("h", "n").alias("hit_rate"), rate("kh", "k").alias("known_accuracy"), rate("uh", "u").alias("unknown_rejection"), F.round(balanced(*map(F.col, ("kh", "k", "uh", "u"))), 6).alias("balanced"))


@query("a3_rank1", f"WITH {T.MATCHES} SELECT bucket, round(avg((best_person = person)::INT), 6) AS rank1 FROM matches WHERE known GROUP BY bucket")
def a3(spark, d):
    return T.matches(spark, d).where("known").groupBy("bucket").agg(F.round(F.avg((F.col("best_person") == F.col("person")).cast("int")), 6).alias("rank1"))


_AT = "round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 6) AS overall, round(CASE WHEN count(*) FILTER (WHERE known) > 0 THEN count(*) FILTER (WHERE known AND ok)::DOUBLE / count(*) FILTER (WHERE known) ELSE 0 END, 6) AS known_rate, round(CASE WHEN count(*) FILTER (WHERE NOT known) > 0 THEN count(*) FILTER (WHERE NOT known AND ok)::DOUBLE / count(*) FILTER (WHERE NOT known) ELSE 0 END, 6) AS unknown_rate"
_SWEPT = f"WITH {T.MATCHES}, q AS (SELECT *, CASE WHEN score >= t THEN best_person ELSE 'Unknown' END AS predicted FROM matches, unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS u(t)), o AS (SELECT *, CASE WHEN known THEN predicted = person ELSE predicted = 'Unknown' END AS ok FROM q)"


def _rates():
    known, ok = F.col("known"), F.col("ok")
    rate = lambda a, b: F.round(F.when(F.count_if(b) > 0, F.count_if(a) / F.count_if(b)).otherwise(0.0), 6)
    return [F.round(F.count_if(ok) / F.count("*"), 6).alias("overall"), rate(known & ok, known).alias("known_rate"), rate(~known & ok, ~known).alias("unknown_rate")]


def _swept(spark, d):
    m = T.matches(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)))))
    m = m.withColumn("predicted", F.when(F.col("score") >= F.col("t"), F.col("best_person")).otherwise("Unknown"))
    return m.withColumn("ok", M.correct(F.col("person"), F.col("predicted"), F.col("known")))


@query("a4_threshold_metrics", _EVAL + f" SELECT {_AT} FROM o")
def a4(spark, d):
    return _evaluated(spark, d).agg(*_rates())


@query("a5_threshold_sweep", _SWEPT + f" SELECT t, coalesce(bucket, 'overall') AS bucket, {_AT} FROM o GROUP BY GROUPING SETS ((t, bucket), (t))")
def a5(spark, d):
    both = _swept(spark, d)
    swept = both.groupingSets([[F.col("t"), F.col("bucket")], [F.col("t")]], "t", "bucket").agg(*_rates())
    return swept.withColumn("bucket", F.coalesce("bucket", F.lit("overall")))


@query("a6_closed_set_sweep", _SWEPT + " SELECT t, count(*) AS evaluated, count(*) FILTER (WHERE ok) AS hits, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 6) AS hit_rate FROM o WHERE known GROUP BY t")
def a6(spark, d):
    return _swept(spark, d).where("known").groupBy("t").agg(F.count("*").alias("evaluated"), F.count_if("ok").alias("hits"), F.round(F.count_if("ok") / F.count("*"), 6).alias("hit_rate"))


@query("a9_pair_mean_over_runs", "WITH r AS (SELECT l_returnflag AS query, l_linestatus AS candidate, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) SELECT query, candidate, round(m, 4) AS raw, round(100 * m / (SELECT max(m) FROM r), 6) AS normalized FROM r")
def a9(spark, d):
    r = T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("query"), F.col("l_linestatus").alias("candidate")).agg(F.avg("l_extendedprice").alias("m"))
    return r.crossJoin(F.broadcast(r.agg(F.max("m").alias("top")))).select("query", "candidate", F.round("m", 4).alias("raw"), F.round(100 * F.col("m") / F.col("top"), 6).alias("normalized"))


def tar_at_far(s, milli):
    """target_far_percent, threshold, actual_far_percent, tar_percent, resolvable of s(d, kind, ok) at targets of milli / 1000 percent."""
    n = s.agg(F.count_if(F.col("kind") == "impostor").alias("n"))
    k = n.withColumn("milli", F.explode(F.array(*[F.lit(m) for m in milli]))).withColumn("k", F.expr("milli * n div 100000"))
    imp = s.where("kind = 'impostor'")
    at = ranks.at_ranks(imp, "d", k.where("k >= 1")).select("milli", F.col("value").alias("t"), F.lit(True).alias("resolvable"))
    none = k.where("k < 1").crossJoin(F.broadcast(imp.agg((F.min("d") - 1e-9).alias("t")))).select("milli", "t", F.lit(False).alias("resolvable"))
    p = at.unionByName(none)
    # rates at a threshold: what lies at or below it, one pass over distinct scores
    base = curves.by_score(s, "kind", "d", "ok")
    got = base.crossJoin(F.broadcast(p)).groupBy("milli", "t", "resolvable").agg(F.sum(F.when(F.col("d") <= F.col("t"), F.col("imp")).otherwise(0)).alias("i"), F.sum("imp").alias("ni"), F.sum(F.when(F.col("d") <= F.col("t"), F.col("hits")).otherwise(0)).alias("h"), F.sum("gen").alias("ng"))
    return got.select((F.col("milli") / 1000.0).alias("target_far_percent"), F.round("t", 6).alias("threshold"), F.round(100.0 * F.col("i") / F.col("ni"), 6).alias("actual_far_percent"), F.round(100.0 * F.col("h") / F.col("ng"), 6).alias("tar_percent"), "resolvable")


for _n, _sql, _of in (("small", T.SMALL, T.scores_small), ("large", T.LARGE, T.scores_large)):

    @query(f"a10_roc_{_n}", f"WITH {_sql}{T.ROC} SELECT t, round(far, 6) AS far, round(tar, 6) AS tar, round(100 - tar, 6) AS frr FROM roc")
    def a10(spark, d, of=_of):
        return curves.roc(of(spark, d)).select("t", *[F.round(c, 6).alias(c) for c in ("far", "tar", "frr")])

    @query(f"a11_eer_{_n}", f"WITH {_sql}{T.ROC} SELECT t, round((far + 100 - tar) / 2, 6) AS eer FROM roc ORDER BY round(abs(far - (100 - tar)), 9), t LIMIT 1")
    def a11(spark, d, of=_of):
        c = curves.roc(of(spark, d)).withColumn("gap", F.round(F.abs(F.col("far") - F.col("frr")), 9))
        x = c.agg(F.min(F.struct("gap", "t", "far", "frr")).alias("m"))
        return x.select("m.t", F.round((F.col("m.far") + F.col("m.frr")) / 2, 6).alias("eer"))

    _TARGETS = ("20.0", "10.0", "5.0", "1.058", "0.01") if _n == "small" else ("1.058", "1.0", "0.1", "0.01")
    _MILLI = [round(float(x) * 1000) for x in _TARGETS]

    @query(
        f"w4_tar_at_far_{_n}",
        f"""WITH {_sql}{T.ROC}, r AS (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM s WHERE kind = 'impostor'), k AS (SELECT milli, n_imp, milli * n_imp // 100000 AS k FROM n, unnest({_MILLI}) AS u(milli)),
        p AS (SELECT milli, k, CASE WHEN k >= 1 THEN (SELECT d FROM r WHERE rn = k) ELSE (SELECT min(d) FROM r) - 1e-9 END AS t, k >= 1 AS resolvable FROM k)
        SELECT milli / 1000.0::DOUBLE AS target_far_percent, round(p.t, 6) AS threshold, round(coalesce(max(roc.far), 0), 6) AS actual_far_percent, round(coalesce(max(roc.tar), 0), 6) AS tar_percent, resolvable FROM p LEFT JOIN roc ON roc.t <= p.t GROUP BY milli, p.t, resolvable""",
    )
    def w4(spark, d, of=_of, milli=tuple(_MILLI)):
        """k = floor(target / 100 * impostors); the k-th smallest impostor is the threshold, below the first if k is 0."""
        return tar_at_far(of(spark, d), milli)


@query("p15_resolvable", f"WITH {T.SMALL}, n AS (SELECT count(*) FILTER (WHERE kind = 'impostor') AS n FROM s) SELECT milli, milli * n // 100000 AS k, milli * n // 100000 >= 1 AS resolvable FROM n, unnest([10, 1058, 5000, 10000]) AS u(milli)")
def p15(spark, d):
    n = T.scores_small(spark, d).agg(F.count_if(F.col("kind") == "impostor").alias("n"))
    return n.select(F.explode(F.array(*map(F.lit, (10, 1058, 5000, 10000)))).alias("milli"), "n").select("milli", F.expr("milli * n div 100000").alias("k"), F.expr("milli * n div 100000 >= 1").alias("resolvable"))


_PCT = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("a12_distance_stats", f"WITH {T.LARGE} SELECT round(min(d), 4) AS lo, round(max(d), 4) AS hi, round(avg(d), 4) AS mean, round(median(d), 4) AS median, round(stddev_pop(d), 4) AS std, " + ", ".join(f"round(quantile_cont(d, {p / 100}), 4) AS p{p:02d}" for p in _PCT) + " FROM s")
def a12(spark, d):
    """The percentiles by exact selection, all of them together; the moments by one aggregation."""
    s, ps = T.scores_large(spark, d), (0.5, *(p / 100 for p in _PCT))
    a = s.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std")).crossJoin(F.broadcast(ranks.percentiles(s, "d", ps)))
    return a.select(*[F.round(c, 4).alias(c) for c in ("lo", "hi", "mean", "std")], F.round(F.col("p")[0], 4).alias("median"), *[F.round(F.col("p")[i + 1], 4).alias(f"p{p:02d}") for i, p in enumerate(_PCT)])


@query("a13_false_positive_rate", f"WITH {T.LARGE} SELECT bucket, count(*) FILTER (WHERE d <= 20000) AS false_positive_count, count(*) AS total_comparisons, round(avg((d <= 20000)::INT), 6) AS rate FROM s GROUP BY bucket")
def a13(spark, d):
    hit = F.col("d") <= 20000
    return T.scores_large(spark, d).groupBy("bucket").agg(F.count_if(hit).alias("false_positive_count"), F.count("*").alias("total_comparisons"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))


@query("a14_histogram", f"WITH {T.LARGE}, m AS (SELECT min(d) AS lo, max(d) AS hi FROM s) SELECT least(19, floor((d - lo) / ((hi - lo) / 20))::BIGINT) AS bin, count(*) AS n FROM s, m GROUP BY 1")
def a14(spark, d):
    """Twenty equal bins; the upper edge belongs to the last."""
    s = T.scores_large(spark, d)
    m = s.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return s.crossJoin(F.broadcast(m)).groupBy(F.least(F.lit(19).cast("long"), F.floor((F.col("d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20))).alias("bin")).agg(F.count("*").alias("n"))


@query("a15_kde", f"WITH {T.SMALL}, b AS (SELECT count(*) AS n, stddev_samp(d) AS sd, min(d) AS lo, max(d) AS hi FROM s), h AS (SELECT *, CASE WHEN 1.06 * sd * pow(n, -0.2) > 0 THEN 1.06 * sd * pow(n, -0.2) ELSE greatest((hi - lo) / 50, 1) END AS h FROM b), g AS (SELECT i, h, lo - 3 * h + i * (hi - lo + 6 * h) / 24 AS x FROM h, unnest(range(0, 25)) AS u(i)) SELECT i AS point, round(x, 4) AS x, round(avg(exp(-0.5 * ((x - d) / h) * ((x - d) / h))) / (h * sqrt(2 * pi())), 10) AS density FROM g, s GROUP BY i, x, h")
def a15(spark, d):
    """Silverman's width 1.06 * sd * n^-0.2; a grid of 25 points three widths beyond the ends. Distinct values are weighted."""
    s = T.scores_small(spark, d)
    b = s.agg(F.count("*").alias("n"), F.stddev_samp("d").alias("sd"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    h = 1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    b = b.withColumn("h", F.when(h > 0, h).otherwise(F.greatest((F.col("hi") - F.col("lo")) / 50, F.lit(1.0))))
    grid = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("x", F.col("lo") - 3 * F.col("h") + F.col("i") * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / 24)
    z = (F.col("x") - F.col("d")) / F.col("h")
    each = s.groupBy("d").agg(F.count("*").alias("m")).crossJoin(F.broadcast(grid)).groupBy("i", "x", "h").agg((F.sum(F.col("m") * F.exp(-0.5 * z * z)) / F.sum("m")).alias("k"))
    return each.select(F.col("i").cast("long").alias("point"), F.round("x", 4).alias("x"), F.round(F.col("k") / (F.col("h") * F.sqrt(2 * F.pi())), 10).alias("density"))


_CAND = "c AS (SELECT 'p01' AS label, round(quantile_cont(d, 0.01), 6) AS t FROM s UNION ALL SELECT 'p05', round(quantile_cont(d, 0.05), 6) FROM s UNION ALL SELECT 'p10', round(quantile_cont(d, 0.1), 6) FROM s UNION ALL SELECT 'p25', round(quantile_cont(d, 0.25), 6) FROM s UNION ALL SELECT 'mean_minus_std', round(greatest(0, avg(d) - stddev_pop(d)), 6) FROM s)"


@query("a16_named_sweep", f"WITH {T.LARGE}, {_CAND} SELECT label, t, count(*) FILTER (WHERE d <= t) AS false_positive_count, count(*) AS total_comparisons FROM s, c GROUP BY label, t")
def a16(spark, d):
    s = T.scores_large(spark, d)
    names = (("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("p25", 0.25))
    a = s.agg(F.round(F.greatest(F.lit(0.0), F.avg("d") - F.stddev_pop("d")), 6).alias("mean_minus_std")).crossJoin(F.broadcast(ranks.percentiles(s, "d", tuple(p for _, p in names))))
    a = a.select(*[F.round(F.col("p")[i], 6).alias(n) for i, (n, _) in enumerate(names)], "mean_minus_std")
    c = a.unpivot([], a.columns, "label", "t")
    return s.crossJoin(F.broadcast(c)).groupBy("label", "t").agg(F.count_if(F.col("d") <= F.col("t")).alias("false_positive_count"), F.count("*").alias("total_comparisons"))


@query("a17_suggested_thresholds", f"WITH {T.SMALL}, a AS (SELECT quantile_cont(d, 0.01) AS p01, quantile_cont(d, 0.05) AS p05, quantile_cont(d, 0.1) AS p10, min(d) AS minimum, CASE WHEN stddev_pop(d) > 0 THEN avg(d) - stddev_pop(d) END AS mean_minus_std FROM s) SELECT label, round(t, 6) AS t FROM (UNPIVOT a ON p01, p05, p10, minimum, mean_minus_std INTO NAME label VALUE t)")
def a17(spark, d):
    s = T.scores_small(spark, d)
    a = s.agg(F.min("d").alias("minimum"), F.when(F.stddev_pop("d") > 0, F.avg("d") - F.stddev_pop("d")).alias("mean_minus_std")).crossJoin(F.broadcast(ranks.percentiles(s, "d", (0.01, 0.05, 0.1))))
    a = a.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("p01", "p05", "p10"))], "minimum", "mean_minus_std")
    return a.unpivot([], a.columns, "label", "t").where("t is not null").withColumn("t", F.round("t", 6))


_CAL = f"WITH {T.MATCHES}, j AS (SELECT vec_id, known, person, round(max(score) FILTER (WHERE other = person), 9) AS own, round(max(score) FILTER (WHERE other <> person), 9) AS best_other, first(other ORDER BY score DESC, other) AS best, round(max(score), 9) AS top FROM scored GROUP BY vec_id, known, person), g AS (SELECT t, avg((best = person AND top >= t)::INT) FILTER (WHERE known) AS id_accuracy, avg((own >= t)::INT) FILTER (WHERE own IS NOT NULL) AS tpr, avg((best_other < t)::INT) FILTER (WHERE best_other >= -0.5) AS tnr FROM j, unnest([0.05, 0.1, 0.15, 0.2, 0.25]::DOUBLE[]) AS u(t) GROUP BY t)"


def _calibrated(spark, d):
    g = T.gallery(spark, d).withColumnRenamed("person", "other")
    s = pairs.each_with_each(T.probes(spark, d).select("vec_id", "person", "known", "v"), g).withColumn("score", V.dot(F.col("v"), F.col("centroid")))
    own = F.col("other") == F.col("person")
    j = s.groupBy("vec_id", "known", "person").agg(F.round(F.max(F.when(own, F.col("score"))), 9).alias("own"), F.round(F.max(F.when(~own, F.col("score"))), 9).alias("best_other"), F.min(F.struct(-F.col("score"), "other")).alias("b"), F.round(F.max("score"), 9).alias("top"))
    j = j.withColumn("best", F.col("b.other")).withColumn("t", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.15, 0.2, 0.25)))))
    share = lambda c, where: F.avg(F.when(where, c.cast("int")))
    return j.groupBy("t").agg(share((F.col("best") == F.col("person")) & (F.col("top") >= F.col("t")), F.col("known")).alias("id_accuracy"), share(F.col("own") >= F.col("t"), F.col("own").isNotNull()).alias("tpr"), share(F.col("best_other") < F.col("t"), F.col("best_other") >= -0.5).alias("tnr"))


@query("a18_calibration_grid", _CAL + " SELECT t, round(id_accuracy, 6) AS id_accuracy, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round((tpr + tnr) / 2, 6) AS balanced FROM g")
def a18(spark, d):
    return _calibrated(spark, d).select("t", *[F.round(c, 6).alias(c) for c in ("id_accuracy", "tpr", "tnr")], F.round((F.col("tpr") + F.col("tnr")) / 2, 6).alias("balanced"))


@query("a19_objective_arg_max", _CAL + " SELECT 'balanced' AS objective, first(t ORDER BY round((tpr + tnr) / 2, 9) DESC, t) AS t FROM g UNION ALL SELECT 'id', first(t ORDER BY round(id_accuracy, 9) DESC, t) FROM g")
def a19(spark, d):
    """The first best threshold in candidate order."""
    g = _calibrated(spark, d)
    first = lambda c: F.min_by("t", F.struct(-F.round(c, 9), F.col("t")))
    a = g.agg(first((F.col("tpr") + F.col("tnr")) / 2).alias("balanced"), first(F.col("id_accuracy")).alias("id"))
    return a.unpivot([], a.columns, "objective", "t")


@query("a27_same_folder_check", f"WITH {T.MATCHES} SELECT person, count(*) AS n, round(avg((best_person = person)::INT), 6) AS hit_rate, round(avg(score), 6) AS mean, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM matches WHERE known GROUP BY person")
def a27(spark, d):
    return T.matches(spark, d).where("known").groupBy("person").agg(F.count("*").alias("n"), F.round(F.avg((F.col("best_person") == F.col("person")).cast("int")), 6).alias("hit_rate"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("lo"), F.round(F.max("score"), 6).alias("hi"))


_FISHER = f"WITH {T.FEAT}, x AS (SELECT label, u.i - 1 AS dim, v[u.i] AS x FROM feat, unnest(range(1, 65)) AS u(i)), c AS (SELECT label, dim, count(*) AS n, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS ss FROM x GROUP BY ALL), g AS (SELECT dim, sum(n * m) / sum(n) AS g FROM c GROUP BY dim), fs AS (SELECT c.dim, sum(n * (m - g) * (m - g)) / (sum(ss) + 1e-9) AS f FROM c JOIN g USING (dim) GROUP BY c.dim)"


def fisher_scores(spark, d):
    """dim, f: spread of class means over spread within classes, from one pass of grouped moments."""
    x = T.feat(spark, d).select("label", F.posexplode("v").alias("dim", "x"))
    c = x.groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("sq"))
    g = c.withColumn("g", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("dim")) / F.sum("n").over(Window.partitionBy("dim")))
    between = F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))
    return g.groupBy("dim").agg((F.sum(between) / (F.sum(F.col("sq") - F.col("n") * F.col("m") * F.col("m")) + 1e-9)).alias("f"))


@query("a28_fisher_scores", _FISHER + " SELECT dim, round(f, 6) AS f FROM fs")
def a28(spark, d):
    return fisher_scores(spark, d).select(F.col("dim").cast("long").alias("dim"), F.round("f", 6).alias("f"))


@query("a29_far_model", f"WITH {T.FEAT}, c AS (SELECT round({T.dot_sql('a.v', 'b.v')}, 9) AS c FROM feat a JOIN feat b ON a.vec_id < b.vec_id AND a.label <> b.label) SELECT t, round(greatest(0, least(1, count(*) FILTER (WHERE c >= t)::DOUBLE / count(*))), 9) AS far FROM c, unnest([0.0, 0.1, 0.2, 0.3, 0.363, 0.5]::DOUBLE[]) AS u(t) GROUP BY t")
def a29(spark, d):
    ts = (0.0, 0.1, 0.2, 0.3, 0.363, 0.5)
    p = tiles.places(T.feat(spark, d), "vec_id", "v", list(ts), "label")
    a = p.agg(F.sum("m").alias("n"), *[F.coalesce(F.sum(F.when(F.col("place") > i, F.col("m"))), F.lit(0)).alias(str(i)) for i in range(len(ts))]).where("n is not null")
    return a.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(str(i)).alias("k")) for i, t in enumerate(ts)])).alias("x")).select("x.t", F.round(F.col("x.k") / F.col("n"), 9).alias("far"))


@query("a29_far_of_matches", f"WITH {T.MATCHES}, c AS (SELECT round({T.dot_sql('a.v', 'b.v')}, 9) AS c FROM feat a JOIN feat b ON a.vec_id < b.vec_id AND a.label <> b.label), m AS (SELECT vec_id, best_person, round(score, 9) AS score FROM matches), n AS (SELECT count(*) AS n FROM c) SELECT vec_id, best_person, score, round(count(*) FILTER (WHERE c >= score)::DOUBLE / n, 9) AS far FROM m, c, n GROUP BY vec_id, best_person, score, n")
def a29_matches(spark, d):
    """The rate of false accepts that each probe's own score stands for: the share of all impostor cosines that reach it."""
    m = T.matches(spark, d).select("vec_id", "best_person", F.round("score", 9).alias("score"))
    return tiles.shares_reached(T.feat(spark, d), "vec_id", "v", "label", m, "score", "far").withColumn("far", F.round("far", 9))


@query("a30_spread", f"WITH {T.MATCHES} SELECT known, round(min(score), 3) AS lo, round(quantile_cont(score, 0.05), 3) AS p5, round(median(score), 3) AS median, round(quantile_cont(score, 0.95), 3) AS p95, round(max(score), 3) AS hi FROM matches GROUP BY known")
def a30(spark, d):
    m = T.matches(spark, d).select("known", "score")
    p = ranks.percentiles(m, "score", (0.05, 0.5, 0.95), ["known"])
    ends = m.groupBy("known").agg(F.round(F.min("score"), 3).alias("lo"), F.round(F.max("score"), 3).alias("hi"))
    return ends.join(p, "known").select("known", "lo", *[F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate(("p5", "median", "p95"))], "hi")


@query("a32_segment_merge", f"WITH {T.LARGE} SELECT segment, count(*) FILTER (WHERE d <= t) AS n, round(t, 4) AS threshold FROM (SELECT *, bucket AS segment FROM s), (SELECT quantile_cont(d, 0.05) AS t FROM s) GROUP BY segment, t")
def a32(spark, d):
    """One threshold over all segments first, then the counts."""
    s = T.scores_large(spark, d)
    t = ranks.percentiles(s, "d", (0.05,)).select(F.col("p")[0].alias("t"))
    return s.crossJoin(F.broadcast(t)).groupBy(F.col("bucket").alias("segment"), "t").agg(F.count_if(F.col("d") <= F.col("t")).alias("n")).select("segment", "n", F.round("t", 4).alias("threshold"))


@query("a36_parity_false_positives", f"WITH {T.FEAT}, p AS (SELECT {T.dot_sql('a.v', 'b.v')} AS c FROM feat a JOIN feat b ON a.vec_id <> b.vec_id), n AS (SELECT count(*) AS n FROM feat) SELECT n * (n - 1) AS comparisons, count(*) FILTER (WHERE c >= 0.363 AND sqrt(greatest(0, 2 - 2 * c)) <= 1.128) AS fp, round(100.0::DOUBLE * count(*) FILTER (WHERE c >= 0.363 AND sqrt(greatest(0, 2 - 2 * c)) <= 1.128) / (n * (n - 1)), 6) AS fp_percent FROM p, n GROUP BY n")
def a36(spark, d):
    """Both orders of a pair fare alike, so unique pairs are counted twice."""
    a = accepted_pairs(spark, d).select((2 * F.col("n")).alias("comparisons"), (2 * F.col("fp")).alias("fp"))
    return a.select("comparisons", "fp", F.round(100.0 * F.col("fp") / F.col("comparisons"), 6).alias("fp_percent"))


def accepted_pairs(spark, d):
    """n, fp: unique pairs, and those that both rules accept. These rise with the cosine, so they are one bound on it."""
    accepts = lambda c: c >= 0.363 and math.sqrt(max(0.0, 2 - 2 * c)) <= 1.128
    low, high = 0.0, 1.0  # refused, accepted
    while (mid := (low + high) / 2) not in (low, high):
        low, high = (low, mid) if accepts(mid) else (mid, high)
    p = tiles.places(T.feat(spark, d), "vec_id", "v", [high], rounded=False)
    return p.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("place") > 0, F.col("m"))), F.lit(0)).alias("fp"))
