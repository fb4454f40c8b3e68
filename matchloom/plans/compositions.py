"""Reports put together from the other operators: Q2, Q3, Q5, Q6, Q8, Q10-Q17, Q19, Q21, Q23-Q28, A37, L8, R6."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import labels as L
from matchloom.functions import vectors as V
from matchloom.operators import curves, pairs, ranks, subspace
from matchloom.operators import matching as M
from matchloom.operators.spread import Spread, percentile, rounded, share_ranks, units
from matchloom.operators.tiles import nearest, ordered_at
from matchloom.plans import frames as FR
from matchloom.plans import tables as T
from matchloom.plans.evaluation import accepted_pairs
from matchloom.plans.hybrid import _CASES
from matchloom.plans.kernels import _IN, REGIONS, region, tiles
from matchloom.plans.registry import query
from matchloom.plans.reports import fps_runs
from matchloom.plans.scans import _REPORTS, reports
from matchloom.plans.vectors import cosines, cosines_at_far
from matchloom.sources.shared import written
from matchloom.streaming import loops


_HIT = "(best_person = person)::INT"


@query("a37_variant_row", f"WITH {T.MATCHES}, s AS (SELECT round(1 - score, 9) AS d, CASE WHEN known THEN 'genuine' ELSE 'impostor' END AS kind, best_person = person AS ok FROM matches){T.ROC} SELECT round(max(tar) FILTER (WHERE far <= 10), 6) AS tar_at_10, round(min(abs(far - 100 + tar)), 6) AS gap, (SELECT round(avg({_HIT}), 6) FROM matches WHERE known) AS rank1, 64 * 4 AS bytes FROM roc")
def a37(spark, d):
    m = T.matches(spark, d).select(F.round(1 - F.col("score"), 9).alias("d"), F.when(F.col("known"), "genuine").otherwise("impostor").alias("kind"), (F.col("best_person") == F.col("person")).alias("ok"))
    c = curves.roc(m).agg(F.round(F.max(F.when(F.col("far") <= 10, F.col("tar"))), 6).alias("tar_at_10"), F.round(F.min(F.abs(F.col("far") - 100 + F.col("tar"))), 6).alias("gap"))
    rank1 = m.where("kind = 'genuine'").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("rank1"))
    return c.crossJoin(F.broadcast(rank1)).withColumn("bytes", F.lit(64 * 4))


@query("l8_train_loop", f"WITH {T.GALLERY}, c AS (SELECT f.vec_id, f.person, {T.dot_sql('f.v', 'g.centroid')} AS own FROM feat f JOIN gallery g USING (person) WHERE NOT probe AND known) SELECT g.person, g.sample_count, round(list_sum(list_transform(g.centroid, lambda x: x * x)), 6) AS squared, round(min(own), 6) AS worst, round(avg(own), 6) AS mean FROM gallery g JOIN c USING (person) GROUP BY g.person, g.sample_count, g.centroid")
def l8(spark, d):
    """Scan, enrol, check: the centroids' lengths are one; how near each identity's own images come to its centroid."""
    g = T.gallery(spark, d)
    own = T.members(spark, d).select("person", "v").join(g.select("person", "centroid"), "person").select("person", V.dot(F.col("v"), F.col("centroid")).alias("own"))
    near = own.groupBy("person").agg(F.round(F.min("own"), 6).alias("worst"), F.round(F.avg("own"), 6).alias("mean"))
    return g.select("person", "sample_count", F.round(V.dot(F.col("centroid"), F.col("centroid")), 6).alias("squared")).join(near, "person")


_JUMPS = FR._BOXES.replace("PARTITION BY stream", "PARTITION BY stream, episode")


@query("r6_iou_and_count_vote", f"WITH {FR._F}, {_JUMPS}, e2 AS (SELECT * EXCLUDE (episode), episode * 1000000 + sum(reset::INT) OVER (PARTITION BY stream, episode ORDER BY ts, frame) AS episode FROM re), {FR._VOTES.format(src='e2')} SELECT stream, frame, name, hits FROM v WHERE rn = 1 AND hits >= 2")
def r6(spark, d):
    """Votes within episodes that end where the box jumps or no face is seen, as a stateful stream."""
    f, s = FR.live(spark, d), F.col("score")
    near = lambda k: (F.floor(s * k).cast("long") % 60)
    boxed = f.withColumn("x", near(3)).withColumn("y", near(7)).withColumn("w", F.lit(40)).withColumn("h", F.lit(40))
    return loops.drained(loops.box_voting(boxed), "stream long, frame long, name string, score double, hits long").select("stream", "frame", "name", "hits")


@query("q2_enroll_and_calibrate", f"WITH {T.MATCHES}, j AS (SELECT vec_id, known, round(max(score) FILTER (WHERE other = person), 9) AS own, round(max(score) FILTER (WHERE other <> person), 9) AS best_other FROM scored GROUP BY vec_id, known, person), g AS (SELECT t, (avg((own >= t)::INT) + avg((best_other < t)::INT)) / 2 AS b FROM j, unnest([0.0, 0.1, 0.2, 0.3]::DOUBLE[]) AS u(t) WHERE known GROUP BY t) SELECT first(t ORDER BY round(b, 9) DESC, t) AS threshold, round(max(b), 6) AS balanced FROM g")
def q2(spark, d):
    g = T.gallery(spark, d).withColumnRenamed("person", "other")
    s = pairs.each_with_each(T.probes(spark, d).where("known").select("vec_id", "person", "v"), g).withColumn("score", V.dot(F.col("v"), F.col("centroid")))
    own = F.col("other") == F.col("person")
    j = s.groupBy("vec_id").agg(F.round(F.max(F.when(own, F.col("score"))), 9).alias("own"), F.round(F.max(F.when(~own, F.col("score"))), 9).alias("best_other"))
    j = j.withColumn("t", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3)))))
    b = j.groupBy("t").agg(((F.avg((F.col("own") >= F.col("t")).cast("int")) + F.avg((F.col("best_other") < F.col("t")).cast("int"))) / 2).alias("b"))
    return b.agg(F.min_by("t", F.struct(-F.round("b", 9), F.col("t"))).alias("threshold"), F.round(F.max("b"), 6).alias("balanced"))


@query("q3_closed_set_evaluation", f"WITH {T.MATCHES} SELECT bucket, count(*) AS evaluated, count(*) FILTER (WHERE score >= 0.2 AND best_person = person) AS hits, count(*) FILTER (WHERE score < 0.2) AS unknown FROM matches WHERE known GROUP BY bucket")
def q3(spark, d):
    hit = (F.col("score") >= 0.2) & (F.col("best_person") == F.col("person"))
    return T.matches(spark, d).where("known").groupBy("bucket").agg(F.count("*").alias("evaluated"), F.count_if(hit).alias("hits"), F.count_if(F.col("score") < 0.2).alias("unknown"))


_FIRST = "ids AS (SELECT person, first(v ORDER BY vec_id) AS v FROM feat GROUP BY person), p AS (SELECT a.person AS query, b.person AS candidate, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM ids a JOIN ids b ON a.person < b.person)"


def _first_of_each(spark, d):
    f = T.feat(spark, d).groupBy("person").agg(F.min_by("v", "vec_id").alias("v"))
    p = pairs.unique_pairs(f, "person")
    return p.select(F.col("a_person").alias("query"), F.col("b_person").alias("candidate"), F.round(V.euclidean(F.col("a_v"), F.col("b_v")), 9).alias("d"))


_HIST = "h AS (SELECT least(9, floor((d - lo) / ((hi - lo) / 10))::BIGINT) AS bin, count(*) AS n, lo, hi FROM p, (SELECT min(d) AS lo, max(d) AS hi FROM p) GROUP BY ALL)"


@query("q5_light_front_independence", f"WITH {T.FEAT}, {_FIRST}, {_HIST}, c AS (SELECT label, round(t, 6) AS t FROM (UNPIVOT (SELECT quantile_cont(d, 0.05) AS p05, quantile_cont(d, 0.25) AS p25, greatest(0, avg(d) - stddev_pop(d)) AS mean_minus_std FROM p) ON p05, p25, mean_minus_std INTO NAME label VALUE t)), w AS (SELECT query, candidate, d, row_number() OVER (ORDER BY d, query, candidate) AS rn FROM p) SELECT 'sweep' AS part, label AS name, t AS x, count(*) FILTER (WHERE d <= t) AS n FROM p, c GROUP BY label, t UNION ALL SELECT 'histogram', bin::VARCHAR, round(lo + bin * (hi - lo) / 10, 6), n FROM h UNION ALL SELECT 'lowest', query || '/' || candidate, round(d, 6), rn FROM w WHERE rn <= 5")
def q5(spark, d):
    """A test of one image for each identity: counts at named thresholds, the histogram that is plotted, the lowest pairs."""
    p = _first_of_each(spark, d)
    two = ranks.percentiles(p, "d", (0.05, 0.25)).select(F.col("p")[0].alias("p05"), F.col("p")[1].alias("p25"))
    a = two.crossJoin(p.agg(F.greatest(F.lit(0.0), F.avg("d") - F.stddev_pop("d")).alias("mean_minus_std")))
    c = a.unpivot([], a.columns, "name", "x").withColumn("x", F.round("x", 6))
    sweep = p.crossJoin(F.broadcast(c)).groupBy("name", "x").agg(F.count_if(F.col("d") <= F.col("x")).alias("n")).select(F.lit("sweep").alias("part"), "name", "x", "n")
    ends = p.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    bins = p.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(9).cast("long"), F.floor((F.col("d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10))).alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    bins = bins.select(F.lit("histogram").alias("part"), F.col("bin").cast("string").alias("name"), F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / 10, 6).alias("x"), "n")
    order = ["d", "query", "candidate"]
    low = p.orderBy(*order).limit(5).withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return sweep.unionByName(bins).unionByName(low.select(F.lit("lowest").alias("part"), F.concat_ws("/", "query", "candidate").alias("name"), F.round("d", 6).alias("x"), "n"))


@query("q6_subspace_independence")
def q6(spark, d):
    """A basis fitted to at most 200 members by hash, all vectors projected, and the error pairs at ranks 1, 2, 4, .. of all
    unique pairs; the k-th ordered pair is the ceil(k / 2)-th unique one. Distances as they are and normalized to 100."""
    sample = T.members(spark, d).orderBy(F.xxhash64("vec_id")).limit(200)
    x = written(subspace.projected(T.feat(spark, d).select("vec_id", "v"), subspace.pca(sample, 20)).select("vec_id", "p"))
    ordered = lambda n: [1 << i for i in range(40) if 1 << i <= 2 * n]
    found = written(ordered_at(x, "vec_id", "p", lambda n: sorted({*((k + 1) // 2 for k in ordered(n)), n}), unique_ranks=True))
    top = found.where("k = n").select(F.col("d").alias("top"))  # one row
    ks = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda k: (k <= 2 * F.col("n")) & (F.floor((k + 1) / 2) == F.col("k"))))
    return found.withColumn("ordered", ks).crossJoin(F.broadcast(top)).select(F.col("ordered").alias("k"), "query", "candidate", F.round("d", 6).alias("d"), F.round(100 * F.col("d") / F.col("top"), 6).alias("normalized"))


@query("q8_accuracy_ratio_report")
def q8(spark, d):
    """Accuracy ratios over the suite of 41 modifications: a modified image matches if it is nearer to its original than the
    threshold whose rate of false accepts is nearest to five percent. Ratios by level, mean of the levels, worst three."""
    from matchloom.plans.kernels import modified

    originals = tiles(spark, d).select("vec_id", F.col("tile").cast("array<double>").alias("t"))
    shares = (0.01, 0.02, 0.04, 0.06, 0.1)
    n, at = Spread(originals, "vec_id", "t", 6).at(lambda n: share_ranks(n, shares))
    rates = spark.createDataFrame([(percentile(at[g], n[g], s), s) for g in n for s in shares], "t double, rate double")
    at = rates.agg(F.min(F.struct(F.round(F.abs(F.col("rate") - 0.05), 9).alias("gap"), "rate", F.col("t").alias("threshold"))).alias("m")).select("m.rate", "m.threshold")
    m = modified(spark, d).select("kind", "level", F.round(V.euclidean(F.col("made").cast("array<double>"), F.col("tile").cast("array<double>")), 6).alias("d"))
    level = m.crossJoin(F.broadcast(at)).groupBy("kind", "level", "threshold").agg(F.count("*").alias("modified"), F.count_if(F.col("d") <= F.col("threshold")).alias("matched"))
    kind = level.groupBy("kind", "threshold").agg(F.count("*").alias("levels"), F.sum("modified").alias("modified"), F.sum("matched").alias("matched"), F.round(100 * F.avg(F.col("matched") / F.col("modified")), 6).alias("ar_percent"))
    every = Window.partitionBy()  # a dozen rows
    return kind.withColumn("overall", F.round(F.avg("ar_percent").over(every), 6)).withColumn("worst", F.row_number().over(Window.orderBy("ar_percent", "kind")) <= 3)


@query("q10_entity_aggregation", f"WITH {_REPORTS}, k AS (SELECT *, coalesce(family, 'none') || '::' || label AS entity_key FROM r), g AS (SELECT entity_key, count(*) AS runs, first(coalesce(rank1, hit_rate) ORDER BY mtime DESC, id DESC) AS metric FROM k GROUP BY entity_key) SELECT entity_key, runs, metric, row_number() OVER (ORDER BY metric DESC NULLS LAST, entity_key) AS place FROM g")
def q10(spark, d):
    k = reports(spark, d).withColumn("entity_key", F.concat_ws("::", F.coalesce("family", F.lit("none")), "label"))
    g = k.groupBy("entity_key").agg(F.count("*").alias("runs"), F.max(F.struct("mtime", "id", F.coalesce("rank1", "hit_rate").alias("metric"))).alias("x")).select("entity_key", "runs", "x.metric")
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("metric").desc_nulls_last(), "entity_key")).cast("long"))


@query("q11_fps_aggregation", f"WITH e AS (SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'delta' END AS family, count(*) AS frames, epoch(max(ts)) - epoch(min(ts)) AS seconds, avg(value) AS average, max(value) AS best FROM events GROUP BY 1, 2) SELECT family, count(*) AS runs, sum(frames)::BIGINT AS frames, round(CASE WHEN sum(seconds) > 0 THEN sum(frames)::DOUBLE / sum(seconds) ELSE avg(average) END, 8) AS weighted_fps, round(avg(average), 4) AS mean, round(max(best), 4) AS best FROM e WHERE family IS NOT NULL GROUP BY family")
def q11(spark, d):
    """Runs first, then families: frames over seconds of all runs, the mean and the best."""
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    r = fps_runs(spark, d).where("family is not null").groupBy("user_id", "family").agg(F.count("*").alias("frames"), (micros / 1e6).alias("seconds"), F.avg("value").alias("average"), F.max("value").alias("best"))
    weighted = F.when(F.sum("seconds") > 0, F.sum("frames") / F.sum("seconds")).otherwise(F.avg("average"))
    return r.groupBy("family").agg(F.count("*").alias("runs"), F.sum("frames").alias("frames"), F.round(weighted, 8).alias("weighted_fps"), F.round(F.avg("average"), 4).alias("mean"), F.round(F.max("best"), 4).alias("best"))


@query("q12_model_compare", f"WITH {_REPORTS}, a AS (SELECT label, avg(rank1) AS m FROM r WHERE family = 'alpha' GROUP BY label), b AS (SELECT label, avg(rank1) AS m FROM r WHERE family = 'beta' GROUP BY label) SELECT coalesce(a.label, b.label) AS label, round(coalesce(b.m, 0) - coalesce(a.m, 0), 6) AS delta FROM a FULL JOIN b ON a.label = b.label")
def q12(spark, d):
    r = reports(spark, d)
    a = r.where("family = 'alpha'").groupBy("label").agg(F.avg("rank1").alias("a"))
    b = r.where("family = 'beta'").groupBy("label").agg(F.avg("rank1").alias("b"))
    return a.join(b, "label", "full").select("label", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6).alias("delta"))


_MODES = "w AS (SELECT l_orderkey, l_linenumber % 4 <> 3 AS face, l_orderkey % 5 <> 0 AS known, escalate, d / 10 AS ms, unnest([{'mode': 'cv_only', 'ok': d <= 76.85}, {'mode': 'dl_only', 'ok': margin >= 0.1}, {'mode': 'cascade', 'ok': CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END}]) AS m FROM h)"


@query("q13_hybrid_compare", f"WITH {_CASES}, {_MODES}, gm AS (SELECT m.mode AS mode, count(*) FILTER (WHERE face) AS evaluated, count(*) FILTER (WHERE face AND m.ok) AS hits, round(count(*) FILTER (WHERE known AND face AND m.ok)::DOUBLE / count(*) FILTER (WHERE known), 6) AS tar, round(avg(escalate::INT), 6) AS escalation_rate, round(avg(ms + CASE WHEN m.mode = 'cv_only' THEN 0 WHEN m.mode = 'dl_only' OR escalate THEN 20 ELSE 0 END), 4) AS mean_ms, round(quantile_cont(ms + CASE WHEN m.mode = 'cv_only' THEN 0 WHEN m.mode = 'dl_only' OR escalate THEN 20 ELSE 0 END, 0.95), 4) AS p95_ms FROM w GROUP BY 1) SELECT *, round(1000 / mean_ms, 4) AS fps FROM gm")
def q13(spark, d):
    """The engines alone and the cascade, side by side: hits, accepts, escalation and what a row costs."""
    from matchloom.plans.hybrid import gated

    second, mode = F.col("margin") >= 0.1, F.col("m.mode")
    ways = F.array(*[F.struct(F.lit(n).alias("mode"), c.alias("ok")) for n, c in (("cv_only", F.col("d") <= 76.85), ("dl_only", second), ("cascade", F.when(F.col("escalate"), second).otherwise(F.col("reason") == "confident_accept")))])
    w = gated(spark, d).select((F.col("l_linenumber") % 4 != 3).alias("face"), (F.col("l_orderkey") % 5 != 0).alias("known"), "escalate", (F.col("d") / 10).alias("ms"), F.explode(ways).alias("m"))
    w = w.select("face", "known", "escalate", mode.alias("mode"), F.col("m.ok").alias("ok"), (F.col("ms") + F.when(mode == "cv_only", 0).when((mode == "dl_only") | F.col("escalate"), 20).otherwise(0)).alias("ms"))
    face, known, ok = F.col("face"), F.col("known"), F.col("ok")
    g = w.groupBy("mode").agg(F.count_if(face).alias("evaluated"), F.count_if(face & ok).alias("hits"), F.round(F.count_if(known & face & ok) / F.count_if(known), 6).alias("tar"), F.round(F.avg(F.col("escalate").cast("int")), 6).alias("escalation_rate"), F.round(F.avg("ms"), 4).alias("mean_ms"))
    p95 = ranks.percentiles(w, "ms", (0.95,), ["mode"]).select("mode", F.round(F.col("p")[0], 4).alias("p95_ms"))
    return g.join(p95, "mode").withColumn("fps", F.round(1000 / F.col("mean_ms"), 4))


@query("q14_detector_compare", "WITH s AS (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY md5('42:' || l_orderkey), l_orderkey LIMIT 300), x AS (SELECT l_orderkey, d.name AS detector, l_quantity AS ms FROM lineitem JOIN s USING (l_orderkey), (VALUES ('first', 0), ('second', 1)) AS d(name, k) WHERE (l_suppkey + d.k) % 3 > 0), i AS (SELECT s.l_orderkey, d.name AS detector, count(x.ms) AS faces, sum(x.ms) AS ms FROM s, (VALUES ('first'), ('second')) AS d(name) LEFT JOIN x ON x.l_orderkey = s.l_orderkey AND x.detector = d.name GROUP BY ALL), b AS (SELECT l_orderkey, count(*) FILTER (WHERE faces > 0) AS found FROM i GROUP BY 1) SELECT detector, count(*) AS images, round(avg((faces > 0)::INT), 6) AS rate, count(*) FILTER (WHERE faces = 1) AS exactly_one, sum(greatest(0, faces - 1))::BIGINT AS extra, round(avg(ms), 4) AS mean_ms, round(median(ms), 4) AS median_ms, count(*) FILTER (WHERE faces > 0 AND found = 1) AS alone FROM i JOIN b USING (l_orderkey) GROUP BY detector")
def q14(spark, d):
    """Two detectors on a random sample of images: rates, images with one face, further faces, time, and images that only
    one of the two finds a face on."""
    li = T.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    key = F.md5(F.concat(F.lit("42:"), F.col("l_orderkey").cast("string")).cast("binary"))
    s = li.select("l_orderkey").distinct().orderBy(key, "l_orderkey").limit(300)
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.lit(k).alias("k")) for k, n in enumerate(("first", "second"))]))
    seen = li.join(F.broadcast(s), "l_orderkey", "left_semi").withColumn("x", both).where((F.col("l_suppkey") + F.col("x.k")) % 3 > 0)
    seen = seen.groupBy("l_orderkey", F.col("x.detector").alias("detector")).agg(F.count("*").alias("faces"), F.sum("l_quantity").alias("ms"))
    i = s.withColumn("detector", F.explode(F.array(F.lit("first"), F.lit("second")))).join(seen, ["l_orderkey", "detector"], "left").withColumn("faces", F.coalesce("faces", F.lit(0)))
    i = i.join(i.groupBy("l_orderkey").agg(F.count_if(F.col("faces") > 0).alias("found")), "l_orderkey")
    g = i.groupBy("detector").agg(F.count("*").alias("images"), F.round(F.avg((F.col("faces") > 0).cast("int")), 6).alias("rate"), F.count_if(F.col("faces") == 1).alias("exactly_one"), F.sum(F.greatest(F.lit(0), F.col("faces") - 1)).alias("extra"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.count_if((F.col("faces") > 0) & (F.col("found") == 1)).alias("alone"))
    return g.join(ranks.percentiles(i, "ms", (0.5,), ["detector"]).select("detector", F.round(F.col("p")[0], 4).alias("median_ms")), "detector")


@query("q19_hybrid_calibration", f"WITH {T.MATCHES}, {_CASES}, c AS (SELECT round({T.dot_sql('a.v', 'b.v')}, 9) AS c FROM feat a JOIN feat b ON a.vec_id < b.vec_id AND a.label <> b.label), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS rn, count(*) OVER () AS n FROM c) SELECT 'spread' AS part, name, value FROM (UNPIVOT (SELECT round(quantile_cont(score, 0.05), 6) AS accept, round(quantile_cont(score, 0.95), 6) AS reject, round(median(score), 6) AS middle FROM matches WHERE NOT known) ON accept, reject, middle INTO NAME name VALUE value) UNION ALL SELECT 'far', printf('%.3f', t), round(avg((c >= t)::INT), 9) FROM c, unnest([0.0, 0.2, 0.363]::DOUBLE[]) AS u(t) GROUP BY t UNION ALL SELECT 'cosine_at_far', ppm::VARCHAR, c FROM r, unnest([1000, 10000]) AS u(ppm) WHERE rn = least(n, greatest(1, (ppm * n + 999999) // 1000000)) UNION ALL SELECT 'quality', name, value FROM (UNPIVOT (SELECT round(quantile_cont(blur, 0.05), 6) AS blur, round(quantile_cont(noise, 0.95), 6) AS noise, round(quantile_cont(pose, 0.95), 6) AS pose FROM c_) ON blur, noise, pose INTO NAME name VALUE value)".replace("c AS (SELECT l_orderkey", "c_ AS (SELECT l_orderkey").replace("FROM c), g AS", "FROM c_), g AS").replace("IS NOT NULL) AS flags FROM c)", "IS NOT NULL) AS flags FROM c_)"))
def q19(spark, d):
    """What a cascade is calibrated by: the spread of impostors' scores, the model of false accepts by cosine, cosines at given
    rates, and thresholds of quality."""
    from matchloom.plans.hybrid import cases

    m = ranks.percentiles(T.matches(spark, d).where("not known").select("score"), "score", (0.05, 0.95, 0.5))
    rows = lambda part, df, names: df.select(F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(n).alias("name"), v.alias("value")) for n, v in names])).alias("r")).select("r.*")
    out = rows("spread", m, [(n, F.round(F.col("p")[i], 6)) for i, n in enumerate(("accept", "reject", "middle"))])
    c, ts = cosines(T.feat(spark, d)), (0.0, 0.2, 0.363)
    marks = [int(units(t, c.measure.digits)) for t in ts]
    n, below = c.below(marks)
    far = [("far", f"{t:.3f}", rounded((n[g] - below[g][m]) / n[g], 9)) for g in n for t, m in zip(ts, marks)]
    far += [("cosine_at_far", str(ppm), value) for ppm, value in cosines_at_far(c, (1000, 10000))]
    out = out.unionByName(spark.createDataFrame(far, "part string, name string, value double"))
    probes = cases(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in ("blur", "noise", "pose")])).alias("e")).select("e.*")
    q = ranks.percentiles(probes, "x", (0.05, 0.95), ["name"])
    return out.unionByName(q.select(F.lit("quality").alias("part"), "name", F.round(F.when(F.col("name") == "blur", F.col("p")[0]).otherwise(F.col("p")[1]), 6).alias("value")))


@query("q21_parity_gate", f"WITH {T.FEAT}, p AS (SELECT {T.dot_sql('a.v', 'b.v')} AS c FROM feat a JOIN feat b ON a.vec_id < b.vec_id), f AS (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE c >= 0.363 AND sqrt(greatest(0, 2 - 2 * c)) <= 1.128) / count(*) AS fp FROM p) SELECT round(fp, 6) AS fp_percent, abs(fp - 0.0747) <= 0.05 AS within_tolerance FROM f")
def q21(spark, d):
    f = accepted_pairs(spark, d).select((100.0 * F.col("fp") / F.col("n")).alias("fp"))
    return f.select(F.round("fp", 6).alias("fp_percent"), (F.abs(F.col("fp") - 0.0747) <= 0.05).alias("within_tolerance"))


@query("q23_launcher_overview", f"WITH {_REPORTS}, g AS (SELECT coalesce(family, 'none') AS family, 'trainer_raw-' || label || '_labels_x' AS variant, max(coalesce(rank1, hit_rate, 0)) AS best, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT family, trim(regexp_replace(lower(replace(replace(variant, 'trainer_raw-', ''), '_labels_x', '')), '[^a-z0-9]+', '-', 'g'), '-') AS tag, round(best, 6) AS best, n, CASE WHEN best >= 0.6 THEN 'ok' ELSE 'low' END AS state FROM g) SELECT *, row_number() OVER (ORDER BY best DESC, n DESC, family, tag) AS place FROM t")
def q23(spark, d):
    """The overview of all models: the best metric of each family and variant, the variant's short tag, and a place."""
    variant = F.concat(F.lit("trainer_raw-"), "label", F.lit("_labels_x"))
    g = reports(spark, d).groupBy(F.coalesce("family", F.lit("none")).alias("family"), L.compact_tag(variant).alias("tag")).agg(F.max(F.coalesce("rank1", "hit_rate", F.lit(0.0))).alias("b"), F.count("*").alias("n"))
    rows = g.select("family", "tag", F.round("b", 6).alias("best"), "n", F.when(F.col("b") >= 0.6, "ok").otherwise("low").alias("state"))
    order = (F.desc("best"), F.desc("n"), "family", "tag")
    return ranks.numbered(rows, order).withColumn("place", F.col("place").cast("long"))


_CUT = ", ".join(f"({k}, '{n}', {left}, {top}, {w}, {h})" for k, (n, (left, top, w, h)) in enumerate(REGIONS.items()))


@query(
    "q24_failure_analysis",
    f"WITH {T.FEAT}, t AS (SELECT vec_id, list_transform(v, lambda x: greatest(0, least(255, round_even((x + 1) * 127.5, 0)))::INT) AS tile FROM feat), p AS (SELECT a.vec_id, i // 8 AS y, i % 8 AS x, (a.tile[i + 1] - b.tile[i + 1])::DOUBLE AS diff FROM t a JOIN t b ON b.vec_id = a.vec_id + 1, range(64) AS u(i)), r(k, name, l, t, w, h) AS (VALUES {_CUT}), s AS (SELECT vec_id, name, sqrt(coalesce(sum(diff * diff) FILTER (WHERE {_IN}), 0)) AS within, sqrt(coalesce(sum(diff * diff) FILTER (WHERE NOT ({_IN})), 0)) AS without FROM p, r GROUP BY vec_id, name), m AS (SELECT name, avg(within) AS within, avg(without) AS without FROM s GROUP BY name), f AS (SELECT within AS base FROM m WHERE name = 'full_face') SELECT name AS region, round(within, 4) AS within, round(CASE name WHEN 'full_face' THEN 0 ELSE base - without END, 4) AS impact, round(100 * within / base, 6) AS relative FROM m, f",
)
def q24(spark, d):
    """Why neighbours differ: the mean distance of images within each region, what blacking a region out takes off the
    distance, and both against the whole face."""
    t = tiles(spark, d)
    both = t.join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("tile").alias("other")), "vec_id")
    square = F.transform(F.zip_with("tile", "other", lambda a, b: (a - b).cast("double")), lambda x: x * x)
    kept = lambda n, keep: F.sqrt(F.aggregate(F.transform("sq", lambda x, i: F.when(region(n, i) == F.lit(keep), x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x))
    each = both.select(square.alias("sq")).select(F.explode(F.array(*[F.struct(F.lit(n).alias("region"), kept(n, True).alias("within"), kept(n, False).alias("without")) for n in REGIONS])).alias("r")).select("r.*")
    m = each.groupBy("region").agg(F.avg("within").alias("w"), F.avg("without").alias("o"))
    base = m.where("region = 'full_face'").select(F.col("w").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("region", F.round("w", 4).alias("within"), F.round(F.when(F.col("region") == "full_face", 0.0).otherwise(F.col("base") - F.col("o")), 4).alias("impact"), F.round(100 * F.col("w") / F.col("base"), 6).alias("relative"))


@query("q25_self_match", f"WITH {T.FEAT}, p AS (SELECT a.vec_id, first(b.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), b.vec_id) AS best FROM feat a, feat b WHERE a.probe GROUP BY a.vec_id) SELECT count(*) AS n, count(*) FILTER (WHERE vec_id = best) AS hits FROM p")
def q25(spark, d):
    """Matching against a gallery that holds the probes themselves finds them."""
    f = T.feat(spark, d)
    probes, all_ = f.where("probe").select("vec_id", "v"), f.select(F.col("vec_id").alias("best"), F.col("v").alias("u"))
    best = pairs.best(nearest(probes, "vec_id", "v", all_, "best", "u", squared=True), ["vec_id"], [F.col("distance"), F.col("best")], ["best"])
    return best.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") == F.col("best")).alias("hits"))


@query("q26_clean_loop", f"WITH {T.MATCHES}, s AS (SELECT round(1 - score, 9) AS d, CASE WHEN known THEN 'genuine' ELSE 'impostor' END AS kind, best_person = person AS ok FROM matches){T.ROC}, q AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM s WHERE kind = 'impostor'), th AS (SELECT d AS t FROM q WHERE rn = greatest(1, n // 10)) SELECT 'rank1' AS metric, round(avg({_HIT}) FILTER (WHERE known), 6) AS value FROM matches UNION ALL SELECT 'accepted', round(avg((score >= 0.2)::INT), 6) FROM matches UNION ALL SELECT 'false_accept', round(avg((score >= 0.2)::INT) FILTER (WHERE NOT known), 6) FROM matches UNION ALL SELECT 'threshold_at_10', round(t, 6) FROM th UNION ALL SELECT 'tar_at_10', round(100.0::DOUBLE * count(*) FILTER (WHERE kind = 'genuine' AND ok AND d <= t) / count(*) FILTER (WHERE kind = 'genuine'), 6) FROM s, th UNION ALL SELECT 'eer', round(first((far + 100 - tar) / 2 ORDER BY round(abs(far - (100 - tar)), 9), t), 6) FROM roc")
def q26(spark, d):
    """One pass from enrolment to report: rank-1, accepts at a fixed threshold, true accepts at ten percent false ones, equal error rate."""
    m = T.matches(spark, d)
    hit, over = (F.col("best_person") == F.col("person")).cast("int"), (F.col("score") >= 0.2).cast("int")
    a = m.agg(F.round(F.avg(F.when(F.col("known"), hit)), 6).alias("rank1"), F.round(F.avg(over), 6).alias("accepted"), F.round(F.avg(F.when(~F.col("known"), over)), 6).alias("false_accept"))
    s = m.select(F.round(1 - F.col("score"), 9).alias("d"), F.when(F.col("known"), "genuine").otherwise("impostor").alias("kind"), (F.col("best_person") == F.col("person")).alias("ok"))
    imp = s.where("kind = 'impostor'")
    t = ranks.at_ranks(imp, "d", imp.agg(F.expr("greatest(1, count(*) div 10)").alias("k"))).select(F.col("value").alias("t"))
    genuine = F.col("kind") == "genuine"
    b = s.crossJoin(F.broadcast(t)).groupBy("t").agg(F.round(100.0 * F.count_if(genuine & F.col("ok") & (F.col("d") <= F.col("t"))) / F.count_if(genuine), 6).alias("tar_at_10")).select(F.round("t", 6).alias("threshold_at_10"), "tar_at_10")
    e = curves.eer(curves.roc(s)).select(F.round("eer", 6).alias("eer"))
    return functools.reduce(DataFrame.unionByName, (x.unpivot([], x.columns, "metric", "value") for x in (a, b, e)))


@query("q27_independence_by_bucket", f"WITH {T.FEAT}, p AS (SELECT a.bucket, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM feat a JOIN feat b ON a.bucket = b.bucket AND a.vec_id < b.vec_id AND a.label <> b.label) SELECT bucket, count(*) AS pairs, min(d) AS closest, round(median(d), 6) AS median FROM p GROUP BY bucket")
def q27(spark, d):
    """Pairs within a bucket only, by tiles of a bucket: counts, the least distance and the median."""
    n, at = Spread(T.feat(spark, d), "vec_id", "v", label="label", by="bucket").at(lambda n: [1, *share_ranks(n, (0.5,))])
    rows = [(g, n[g], at[g][1], rounded(percentile(at[g], n[g], 0.5), 6)) for g in n]
    return spark.createDataFrame(rows, "bucket string, pairs long, closest double, median double")


@query("q28_figure_data", f"WITH {_REPORTS} SELECT family, round(max(rank1) FILTER (WHERE label = '1-URGENT'), 6) AS urgent, round(max(rank1) FILTER (WHERE label = '5-LOW'), 6) AS low FROM r WHERE family IS NOT NULL GROUP BY family")
def q28(spark, d):
    p = reports(spark, d).where("family is not null").groupBy("family").pivot("label", ["1-URGENT", "5-LOW"]).agg(F.max("rank1"))
    return p.select("family", F.round("1-URGENT", 6).alias("urgent"), F.round("5-LOW", 6).alias("low"))
