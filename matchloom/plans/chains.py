"""Whole reports, every operator of their chain in place: Q1, Q2, Q4/Q5 over runs, Q18, Q20, Q22, Q23, Q26, Q28."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.functions import labels as L
from matchloom.functions import vectors as V
from matchloom.operators import curves, pairs, ranks
from matchloom.operators import matching as M
from matchloom.plans import compositions, studies
from matchloom.plans import reports as reported
from matchloom.plans import tables as T
from matchloom.plans.evaluation import _CAL, _SWEPT, _calibrated, _swept
from matchloom.plans.hybrid import _CASES, gated
from matchloom.plans.registry import query
from matchloom.plans.scans import _REPORTS, reports
from matchloom.sources import sinks
from matchloom.sources.shared import shared_dir, written

_PROFILE = '{"buckets":"all","source":"embeddings"}'


@query(
    "q1_classical_evaluation",
    f"{_SWEPT}, b AS (SELECT coalesce(bucket, 'overall') AS bucket, t, count(*) AS evaluated, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE known AND best_person = person)::DOUBLE / nullif(count(*) FILTER (WHERE known), 0), 6) AS rank1 FROM o GROUP BY GROUPING SETS ((t, bucket), (t))), "
    "w AS (SELECT vec_id, person, best_person, row_number() OVER (ORDER BY vec_id) AS rn FROM matches WHERE known AND person <> best_person) "
    f"SELECT 'ds_' || sha1('{_PROFILE}')[1:12] AS dataset, 'sweep' AS part, bucket AS name, t, evaluated, correct, rank1 FROM b UNION ALL SELECT 'ds_' || sha1('{_PROFILE}')[1:12], 'missed', person || '->' || best_person, NULL, vec_id, rn, NULL FROM w WHERE rn <= 15",
)
def q1(spark, d):
    """The report of an evaluation: counters and rank-1 of each bucket and overall at every threshold, the first misclassified ones, under the
    data set's slug; written as one nested JSON document and read back."""
    s = _swept(spark, d)
    known, hit = F.col("known"), F.col("best_person") == F.col("person")
    b = s.groupingSets([[F.col("t"), F.col("bucket")], [F.col("t")]], "t", "bucket").agg(F.count("*").alias("evaluated"), F.count_if("ok").alias("correct"), F.round(F.count_if(known & hit) / F.nullif(F.count_if(known), F.lit(0)), 6).alias("rank1"))
    missed = T.matches(spark, d).where(known & ~hit).orderBy("vec_id").limit(15)
    of_sweep = F.collect_list(F.struct(F.coalesce("bucket", F.lit("overall")).alias("name"), "t", "evaluated", "correct", "rank1"))  # buckets times thresholds
    of_missed = F.array_sort(F.collect_list(F.struct("vec_id", F.concat_ws("->", "person", "best_person").alias("name"))))
    report = b.agg(of_sweep.alias("sweep")).crossJoin(missed.agg(of_missed.alias("missed"))).withColumn("dataset", L.slug(F.lit(_PROFILE), "ds"))
    at = f"{shared_dir(spark)}/outputs/{uuid.uuid4().hex}"
    sinks.report_json(report, at)
    back = written(spark.read.schema("dataset string, sweep array<struct<name: string, t: double, evaluated: long, correct: long, rank1: double>>, missed array<struct<vec_id: long, name: string>>").json(at))
    sweep = back.select("dataset", F.explode("sweep").alias("x")).select("dataset", F.lit("sweep").alias("part"), "x.name", "x.t", "x.evaluated", "x.correct", "x.rank1")
    none = F.lit(None).cast("double")
    return sweep.unionByName(back.select("dataset", F.posexplode("missed").alias("i", "x")).select("dataset", F.lit("missed").alias("part"), "x.name", none.alias("t"), F.col("x.vec_id").alias("evaluated"), (F.col("i") + 1).cast("long").alias("correct"), none.alias("rank1")))


@query("q2_enrollment_report", f"{_CAL}, b AS (SELECT first(t ORDER BY round((tpr + tnr) / 2, 9) DESC, t) AS balanced, first(t ORDER BY round(id_accuracy, 9) DESC, t) AS by_id FROM g) SELECT person, sample_count, round(centroid[1], 6) AS first, balanced AS threshold, by_id AS threshold_by_id FROM gallery, b")
def q2(spark, d):
    """Enrolment with the thresholds that a calibration over its probes finds, by both objectives, written as JSON and read back."""
    g = _calibrated(spark, d)
    best = lambda c: F.min_by("t", F.struct(-F.round(c, 9), F.col("t")))
    t = g.agg(best((F.col("tpr") + F.col("tnr")) / 2).alias("threshold"), best(F.col("id_accuracy")).alias("threshold_by_id"))
    at = f"{shared_dir(spark)}/outputs/{uuid.uuid4().hex}"
    sinks.report_json(T.gallery(spark, d).crossJoin(F.broadcast(t)), at)
    back = spark.read.schema("person string, sample_count long, centroid array<double>, threshold double, threshold_by_id double").json(at)
    return back.select("person", "sample_count", F.round(F.col("centroid")[0], 6).alias("first"), "threshold", "threshold_by_id")


RUNS = 5
_RUNS = f"WITH {T.FEAT}, pick AS (SELECT run, person, first(v ORDER BY md5(run || '/' || vec_id), vec_id) AS v FROM feat, range(1, {RUNS + 1}) AS r(run) GROUP BY run, person), e AS (SELECT a.person AS query, b.person AS candidate, avg(round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9)) AS raw FROM pick a JOIN pick b ON a.run = b.run AND a.person < b.person GROUP BY ALL)"


def runs_of_pairs(spark, d):
    """query, candidate, raw: of each pair of identities the mean distance over runs, each of which draws one image of every identity anew."""
    f = T.feat(spark, d).select("vec_id", "person", "v").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(RUNS))))
    pick = f.groupBy("run", "person").agg(F.min_by("v", F.struct(F.md5(F.concat_ws("/", "run", "vec_id").cast("binary")).alias("h"), "vec_id")).alias("v"))
    p = pairs.unique_pairs(pick.withColumn("key", F.concat_ws("/", "person", F.col("run").cast("string"))), "key", within="run")
    return p.select(F.least("a_person", "b_person").alias("query"), F.greatest("a_person", "b_person").alias("candidate"), F.round(V.euclidean(F.col("a_v"), F.col("b_v")), 9).alias("d")).groupBy("query", "candidate").agg(F.avg("d").alias("raw"))


@query(
    "q5_independence_over_runs",
    f"{_RUNS}, t AS (SELECT max(raw) AS top FROM e), n AS (SELECT *, 100 * raw / top AS d FROM e, t), s AS (SELECT min(d) AS lo, max(d) AS hi, avg(d) AS mean, quantile_cont(d, 0.05) AS p05, median(d) AS median FROM n), w AS (SELECT *, row_number() OVER (ORDER BY round(d, 9), query, candidate) AS rn FROM n) "
    "SELECT 'stats' AS part, name, round(value, 6) AS value, NULL::BIGINT AS place FROM (UNPIVOT s ON lo, hi, mean, p05, median INTO NAME name VALUE value) UNION ALL SELECT 'histogram', bin::VARCHAR, bin * 10.0::DOUBLE, count(*) FROM (SELECT least(9, floor(round(d, 9) / 10))::BIGINT AS bin FROM n) GROUP BY bin UNION ALL SELECT 'lowest', query || '/' || candidate, round(d, 6), rn FROM w WHERE rn <= 20",
)
def q5(spark, d):
    """An independence test whose pairs are means over runs, normalized to 100 by the largest of these means: what they are like, the
    histogram that is plotted and the lowest twenty pairs."""
    e = written(runs_of_pairs(spark, d))
    n = e.crossJoin(F.broadcast(e.agg(F.max("raw").alias("top")))).select("query", "candidate", (100 * F.col("raw") / F.col("top")).alias("d"))
    n = written(n)
    s = n.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("d").alias("mean")).crossJoin(ranks.percentiles(n, "d", (0.05, 0.5))).select("lo", "hi", "mean", F.col("p")[0].alias("p05"), F.col("p")[1].alias("median"))
    none = F.lit(None).cast("long")
    stats = s.unpivot([], s.columns, "name", "value").select(F.lit("stats").alias("part"), "name", F.round("value", 6).alias("value"), none.alias("place"))
    bins = n.groupBy(F.least(F.lit(9).cast("long"), F.floor(F.round("d", 9) / 10)).alias("bin")).agg(F.count("*").alias("place"))
    bins = bins.select(F.lit("histogram").alias("part"), F.col("bin").cast("string").alias("name"), (F.col("bin") * 10.0).alias("value"), "place")
    low = n.orderBy(F.round("d", 9), "query", "candidate").limit(20)
    low = ranks.numbered(low.withColumn("r", F.round("d", 9)), ["r", "query", "candidate"]).select(F.lit("lowest").alias("part"), F.concat_ws("/", "query", "candidate").alias("name"), F.round("d", 6).alias("value"), F.col("place").cast("long").alias("place"))
    return stats.unionByName(bins).unionByName(low)


@query(
    "q18_enroll_consistency",
    f"WITH {T.FEAT}, m AS (SELECT person, u.i, avg(v[u.i]) AS x, count(*) AS n FROM feat, unnest(range(1, 65)) AS u(i) WHERE NOT probe AND known GROUP BY ALL), a AS (SELECT person, max(n) AS samples, round(sqrt(sum(x * x)), 6) AS length FROM m GROUP BY person), b AS (SELECT DISTINCT person FROM feat WHERE bucket <> 'b2' AND label >= 2) "
    "SELECT coalesce(a.person, b.person) AS person, samples, length, CASE WHEN b.person IS NULL THEN 'gallery_only' WHEN a.person IS NULL THEN 'labels_only' ELSE 'both' END AS state FROM a FULL JOIN b USING (person)",
)
def q18(spark, d):
    """The mean gallery of one engine against the labels of the other: samples and length of each mean, and who is missing on which side."""
    a = M.mean_vector(T.members(spark, d), "person").select("person", F.col("sample_count").alias("samples"), F.round(V.norm(F.col("centroid")), 6).alias("length"), F.lit(True).alias("in_a"))
    b = T.feat(spark, d).where("bucket <> 'b2' and label >= 2").select("person").distinct().withColumn("in_b", F.lit(True))
    state = F.when(F.col("in_b").isNull(), "gallery_only").when(F.col("in_a").isNull(), "labels_only").otherwise("both")
    return a.join(b, "person", "full").select("person", "samples", "length", state.alias("state"))


_WAYS = """w AS (SELECT *, unnest([{'mode': 'cv_only', 'engine': 'first', 'ok': d <= 76.85}, {'mode': 'dl_only', 'engine': 'second', 'ok': margin >= 0.1}, {'mode': 'parallel', 'engine': CASE WHEN escalate THEN 'second' ELSE 'first' END, 'ok': CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END}, {'mode': 'cascade', 'engine': CASE WHEN escalate THEN 'second' ELSE 'first' END, 'ok': CASE WHEN escalate THEN margin >= 0.1 ELSE reason = 'confident_accept' END}]) AS m, l_linenumber % 4 <> 3 AS face, l_orderkey % 5 <> 0 AS known FROM h),
x AS (SELECT m.mode AS mode, m.engine AS engine, m.ok AS accepted, face, known, escalate AND m.mode IN ('parallel', 'cascade') AS escalated, CASE WHEN m.engine = 'first' THEN l_linenumber % 7 <> 0 ELSE d < 90 END AS right_name, CASE m.mode WHEN 'cv_only' THEN d / 10 WHEN 'dl_only' THEN 20 + d / 10 WHEN 'parallel' THEN 20 + d / 10 ELSE d / 10 + CASE WHEN escalate THEN 20 ELSE 0 END END::DOUBLE AS ms FROM w)"""


def by_mode(spark, d):
    """Every row under every mode: mode, engine, accepted, face, known, escalated, right_name, ms."""
    first, second = F.col("d") <= 76.85, F.col("margin") >= 0.1
    both, engine = F.when(F.col("escalate"), second).otherwise(F.col("reason") == "confident_accept"), F.when(F.col("escalate"), "second").otherwise("first")
    cost = F.col("d").cast("double") / 10
    way = lambda mode, engine, ok, ms: F.struct(F.lit(mode).alias("mode"), engine.alias("engine"), ok.alias("accepted"), ms.alias("ms"))
    ways = F.array(way("cv_only", F.lit("first"), first, cost), way("dl_only", F.lit("second"), second, 20 + cost), way("parallel", engine, both, 20 + cost), way("cascade", engine, both, cost + F.when(F.col("escalate"), 20.0).otherwise(0.0)))
    x = gated(spark, d).select("d", "escalate", "reason", (F.col("l_linenumber") % 4 != 3).alias("face"), (F.col("l_orderkey") % 5 != 0).alias("known"), "l_linenumber", F.explode(ways).alias("m"))
    right = F.when(F.col("m.engine") == "first", F.col("l_linenumber") % 7 != 0).otherwise(F.col("d") < 90)
    return x.select("m.mode", "m.engine", "m.accepted", "m.ms", "face", "known", (F.col("escalate") & F.col("m.mode").isin("parallel", "cascade")).alias("escalated"), right.alias("right_name"))


@query(
    "q20_hybrid_evaluation",
    f"WITH {_CASES}, {_WAYS} SELECT mode, count(*) FILTER (WHERE known) AS total, count(*) FILTER (WHERE known AND face) AS evaluated, count(*) FILTER (WHERE known AND NOT face) AS no_face, count(*) FILTER (WHERE known AND face AND accepted AND right_name) AS correct, round(100.0::DOUBLE * count(*) FILTER (WHERE known AND face AND right_name) / count(*) FILTER (WHERE known AND face), 4) AS rank1_percent, round(100.0::DOUBLE * count(*) FILTER (WHERE known AND face AND accepted AND right_name) / count(*) FILTER (WHERE known), 4) AS tar_percent, "
    "round(100.0::DOUBLE * count(*) FILTER (WHERE NOT known AND face AND accepted) / count(*) FILTER (WHERE NOT known AND face), 4) AS far_percent, count(*) FILTER (WHERE NOT known AND face) AS impostors, round(100.0::DOUBLE * count(*) FILTER (WHERE known AND face AND escalated) / count(*) FILTER (WHERE known AND face), 4) AS escalation_percent, count(*) FILTER (WHERE known AND face AND engine = 'first') AS by_first, count(*) FILTER (WHERE known AND face AND engine = 'second') AS by_second, "
    "round(avg(ms) FILTER (WHERE known AND face), 4) AS mean_ms, round(quantile_cont(ms, 0.95) FILTER (WHERE known AND face), 4) AS p95_ms, round(1000 / avg(ms) FILTER (WHERE known AND face), 2) AS projected_fps FROM x GROUP BY mode",
)
def q20(spark, d):
    """The cascade and its engines evaluated, a row for each mode: accepts and errors over known faces and impostors, how often the gate
    escalates, which engine decides, and what a frame costs."""
    x = written(by_mode(spark, d))
    known, face, right, accepted = (F.col(c) for c in ("known", "face", "right_name", "accepted"))
    asked, percent = known & face, lambda a, b: F.round(100.0 * F.count_if(a) / F.count_if(b), 4)
    rates = x.groupBy("mode").agg(
        F.count_if(known).alias("total"), F.count_if(asked).alias("evaluated"), F.count_if(known & ~face).alias("no_face"), F.count_if(asked & accepted & right).alias("correct"), percent(asked & right, asked).alias("rank1_percent"),
        percent(asked & accepted & right, known).alias("tar_percent"), percent(~known & face & accepted, ~known & face).alias("far_percent"), F.count_if(~known & face).alias("impostors"), percent(asked & F.col("escalated"), asked).alias("escalation_percent"),
        F.count_if(asked & (F.col("engine") == "first")).alias("by_first"), F.count_if(asked & (F.col("engine") == "second")).alias("by_second"), F.round(F.avg(F.when(asked, F.col("ms"))), 4).alias("mean_ms"), F.round(1000 / F.avg(F.when(asked, F.col("ms"))), 2).alias("projected_fps"),
    )
    p95 = ranks.percentiles(x.where(asked), "ms", (0.95,), ["mode"]).select("mode", F.round(F.col("p")[0], 4).alias("p95_ms"))
    return rates.join(p95, "mode")


_FIGURES = ("rank1_percent", "tar_percent", "far_percent", "escalation_percent", "mean_ms", "p95_ms")


@query("q28_hybrid_figures")
def q28(spark, d):
    """What is plotted of the evaluation by mode: a row for each figure, a column for each mode."""
    e = q20(spark, d).select("mode", *_FIGURES)
    return e.unpivot(["mode"], list(_FIGURES), "figure", "value").groupBy("figure").pivot("mode", ["cv_only", "dl_only", "parallel", "cascade"]).agg(F.max("value"))


@query(
    "q22_metrics_report",
    f"WITH {T.LARGE}, base AS (SELECT bucket, d, count(*) FILTER (WHERE kind = 'impostor') AS imp, count(*) FILTER (WHERE kind = 'genuine' AND ok) AS hits FROM s GROUP BY ALL), n AS (SELECT bucket, count(*) FILTER (WHERE kind = 'impostor') AS n_imp, count(*) FILTER (WHERE kind = 'genuine') AS n_gen, round(100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*), 6) AS rank1 FROM s GROUP BY bucket), "
    "roc AS (SELECT bucket, d AS t, CASE WHEN n_imp > 0 THEN 100.0::DOUBLE * ci / n_imp ELSE 0 END AS far, CASE WHEN n_gen > 0 THEN 100.0::DOUBLE * ch / n_gen ELSE 0 END AS tar, rank1 FROM (SELECT bucket, d, sum(imp) OVER (PARTITION BY bucket ORDER BY d) AS ci, sum(hits) OVER (PARTITION BY bucket ORDER BY d) AS ch FROM base) JOIN n USING (bucket)), "
    "op AS (SELECT bucket, first(t ORDER BY round(abs(far - 1.058), 9), t) AS t, first(far ORDER BY round(abs(far - 1.058), 9), t) AS far, first(tar ORDER BY round(abs(far - 1.058), 9), t) AS tar, max(rank1) AS rank1 FROM roc GROUP BY bucket), "
    "sev AS (SELECT severity, round_even(2.0::DOUBLE * (row_number() OVER (ORDER BY severity) - 1) / (count(*) OVER () - 1), 0)::BIGINT AS tier FROM (SELECT DISTINCT round(l_discount, 2) AS severity FROM lineitem)), k AS (SELECT l_returnflag AS bucket, tier, severity, avg((l_quantity <= 25)::INT) AS k FROM lineitem JOIN sev ON sev.severity = round(l_discount, 2) GROUP BY ALL), ar AS (SELECT bucket, tier, round(100 * avg(k), 6) AS ar FROM k GROUP BY ALL) "
    "SELECT op.bucket, round(t, 6) AS threshold, round(far, 6) AS far_percent, round(tar, 6) AS tar_percent, max(ar) FILTER (WHERE tier = 0) AS ar_mild, max(ar) FILTER (WHERE tier = 1) AS ar_moderate, max(ar) FILTER (WHERE tier = 2) AS ar_severe, 'TAR(rank-1) ' || CASE WHEN max(rank1) >= 90 THEN 'PASS' ELSE 'below 90%' END || '; feature PASS <1KB; fps n/a' AS verdict FROM op LEFT JOIN ar ON ar.bucket = op.bucket GROUP BY op.bucket, t, far, tar",
)
def q22(spark, d):
    """The table of metrics: of each bucket the operating point nearest to the target rate of false accepts, the accuracy ratio in three tiers of
    severity, and the verdict."""
    s = T.scores_large(spark, d)
    c = curves.roc(s, by=["bucket"]).withColumn("gap", F.round(F.abs(F.col("far") - 1.058), 9))
    op = c.groupBy("bucket").agg(F.min(F.struct("gap", "t", "far", "tar")).alias("m")).select("bucket", F.round("m.t", 6).alias("threshold"), F.round("m.far", 6).alias("far_percent"), F.round("m.tar", 6).alias("tar_percent"))
    rank1 = s.groupBy("bucket").agg(F.round(100.0 * F.count_if("ok") / F.count("*"), 6).alias("rank1"))
    tiers = F.broadcast(reported.a21(spark, d))  # a row for each severity
    k = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("bucket"), F.round("l_discount", 2).alias("severity"), (F.col("l_quantity") <= 25).cast("int").alias("hit")).join(tiers, "severity")
    ar = k.groupBy("bucket", "tier", "severity").agg(F.avg("hit").alias("k")).groupBy("bucket", "tier").agg(F.round(100 * F.avg("k"), 6).alias("ar"))
    wide = ar.groupBy("bucket").pivot("tier", [0, 1, 2]).agg(F.max("ar")).toDF("bucket", "ar_mild", "ar_moderate", "ar_severe")
    out = op.join(rank1, "bucket").join(wide, "bucket", "left")
    return out.withColumn("verdict", L.verdict(F.col("rank1"), F.lit(960), F.lit(None).cast("double"))).drop("rank1")


_FAMILY = {"alpha": "arcface_buffalo_s", "beta": "hybrid", "gamma": "arcface_mobilenet_int8"}


@query(
    "q23_overview",
    f"WITH {_REPORTS}, m AS (SELECT id, family, label, CASE family WHEN 'alpha' THEN 'arcface_buffalo_s' WHEN 'beta' THEN 'hybrid' ELSE 'arcface_mobilenet_int8' END AS tag, coalesce(rank1, hit_rate, round((id % 100) / 100.0::DOUBLE, 6)) AS metric, hit_rate FROM r WHERE family IS NOT NULL), "
    "g AS (SELECT CASE tag WHEN 'arcface_buffalo_s' THEN 'ArcFace' WHEN 'hybrid' THEN 'Hybrid' ELSE 'ArcFace MobileNet INT8' END AS model, trim(regexp_replace(lower(replace(replace('trainer_raw-' || label || '_labels_x', 'trainer_raw-', ''), '_labels_x', '')), '[^a-z0-9]+', '-', 'g'), '-') AS variant, label, count(*) AS evaluated, max(hit_rate) FILTER (WHERE label <> '5-LOW') AS aggregate, round(avg(metric), 6) AS runs FROM m GROUP BY ALL) "
    "SELECT model, variant, evaluated, coalesce(aggregate, runs) AS value, CASE WHEN aggregate IS NOT NULL THEN 'aggregate' ELSE 'runs' END AS origin, row_number() OVER (ORDER BY coalesce(aggregate, runs) DESC, evaluated DESC, model DESC, variant) AS place FROM g",
)
def q23(spark, d):
    """The overview of all models: a report belongs to the model that its family tag and variant tell; the value comes from the aggregate
    where there is one, else from the runs with each run's own fallback of metrics; short tags; best first."""
    variant = F.concat(F.lit("trainer_raw-"), "label", F.lit("_labels_x"))
    tag = F.when(F.col("family") == "alpha", _FAMILY["alpha"]).when(F.col("family") == "beta", _FAMILY["beta"]).otherwise(_FAMILY["gamma"])
    r = reports(spark, d).where("family is not null")
    models = F.array(*[F.when(L.of_model(m, tag, F.concat_ws("_", variant, F.when(F.col("family") == "gamma", "int8"))), F.lit(m)) for m in L.FAMILIES])
    m = r.select("label", "hit_rate", variant.alias("variant"), F.coalesce("rank1", "hit_rate", F.round(F.col("id") % 100 / 100.0, 6)).alias("metric"), F.explode(F.filter(models, lambda x: x.isNotNull())).alias("model"))
    g = m.groupBy("model", "variant").agg(F.count("*").alias("evaluated"), F.max(F.when(F.col("label") != "5-LOW", F.col("hit_rate"))).alias("aggregate"), F.round(F.avg("metric"), 6).alias("runs"))
    g = g.select("model", L.compact_tag(F.col("variant")).alias("variant"), "evaluated", F.coalesce("aggregate", "runs").alias("value"), F.when(F.col("aggregate").isNotNull(), "aggregate").otherwise("runs").alias("origin"))
    return ranks.numbered(g, [F.desc("value"), F.desc("evaluated"), F.desc("model"), F.col("variant")]).withColumn("place", F.col("place").cast("long"))


@query("q26_clean_loop_report")
def q26(spark, d):
    """The clean loop from end to end, a line for each figure: evaluation by bucket at the middle threshold, true accepts at rates of false ones,
    accuracy ratios, and the comparison with the specification."""
    text = lambda c: F.col(c).cast("string")
    one = q1(spark, d).where("part = 'sweep' and t = 0.2").select(F.lit("evaluation").alias("step"), "name", text("rank1").alias("value"))
    far = studies.q7(spark, d).select(F.lit("tar_at_far").alias("step"), F.split("line", r"\|")[1].alias("name"), F.col("line").alias("value"))
    ratio = compositions.q8(spark, d).select(F.lit("accuracy_ratio").alias("step"), F.col("kind").alias("name"), text("ar_percent").alias("value"))
    spec = reported.q9(spark, d).select(F.lit("specification").alias("step"), F.col("family").alias("name"), F.col("verdict").alias("value"))
    return one.unionByName(far).unionByName(ratio).unionByName(spec).withColumn("name", F.trim("name"))
