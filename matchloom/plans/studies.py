"""Model fitting L1-L7, L9-L13 and composed reports Q2, Q4, Q7, Q18, Q19, Q22."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import grids as G
from matchloom.functions import labels as L
from matchloom.functions import vectors as V
from matchloom.operators import curves, pairs, ranks, subspace, tiles
from matchloom.operators import matching as M
from matchloom.operators.spread import Spread, percentile, rounded, share_ranks, units
from matchloom.plans import tables as T
from matchloom.plans.evaluation import _FISHER, fisher_scores, tar_at_far
from matchloom.plans.kernels import SIDE
from matchloom.plans.kernels import tiles as images
from matchloom.plans.registry import query
from matchloom.plans.vectors import _ORDERED, _UNIQUE, error_ranks
from matchloom.sources import sinks
from matchloom.sources.shared import shared_dir, written


def _nearest_in_subspace(spark, d, fit):
    members = T.members(spark, d).select("vec_id", "label", "person", "v")
    basis = fit(members)
    g = subspace.projected(members, basis).select(F.col("person").alias("name"), F.col("p").alias("u"))
    p = subspace.projected(T.probes(spark, d).select("vec_id", "v"), basis).select("vec_id", "p")
    return tiles.nearest_name(p, ["vec_id"], "p", g, "name", "u").select("vec_id", "name", F.round("d", 4).alias("distance"))


@query("l1_eigen_subspace")
def l1(spark, d):
    return _nearest_in_subspace(spark, d, lambda m: subspace.pca(m, 50))


@query("l2_fisher_subspace")
def l2(spark, d):
    return _nearest_in_subspace(spark, d, lambda m: subspace.lda(m, "label", 49))


@query("l3_templates", f"WITH {T.FEAT}, far AS (SELECT p.vec_id, t.vec_id AS template, t.person AS name, round(0.5 * list_sum(list_transform(list_zip(p.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 2 + 1e-10))), 6) AS d FROM feat p, feat t WHERE p.probe AND NOT t.probe AND t.known) SELECT vec_id, first(name ORDER BY d, name, template) AS name, min(d) AS d FROM far GROUP BY vec_id")
def l3(spark, d):
    """All templates are the model: a probe takes the name of the nearest by chi-square, here of components moved to 0..2."""
    moved = lambda v: F.transform(v, lambda x: x + 1)
    t = T.members(spark, d).select(F.col("person").alias("name"), moved("v").alias("u"))
    p = T.probes(spark, d).select("vec_id", moved("v").alias("v"))
    return tiles.nearest_name(p, ["vec_id"], "v", t, "name", "u", chi=True)


@query("l4_basis_on_sample")
def l4(spark, d):
    """The basis from at most 200 members by hash, all vectors projected: length of each projection."""
    sample = T.members(spark, d).orderBy(F.xxhash64("vec_id")).limit(200)
    return subspace.projected(T.feat(spark, d), subspace.pca(sample, 20)).select("vec_id", F.round(V.norm(F.col("p")), 4).alias("length"))


@query("l5_identities_with_two", f"WITH {T.FEAT} SELECT person, count(*) AS n FROM feat GROUP BY person HAVING count(*) >= 2 ORDER BY person LIMIT 500")
def l5(spark, d):
    return T.feat(spark, d).groupBy("person").agg(F.count("*").alias("n")).where("n >= 2").orderBy("person").limit(500)


_TOP = _FISHER + ", top AS (SELECT dim FROM fs ORDER BY round(f, 9) DESC, dim LIMIT {k}), q AS (SELECT vec_id, probe, known, person, dim, round_even((v[dim + 1] + 1) * 127.5, 0)::BIGINT AS b FROM feat, top)"


def _compact(spark, d, k):
    dims = fisher_scores(spark, d).orderBy(F.desc(F.round("f", 9)), "dim").limit(k).select("dim")
    x = T.feat(spark, d).select("vec_id", "probe", "known", "person", F.posexplode("v").alias("dim", "x"))
    return x.join(F.broadcast(dims), "dim").withColumn("b", F.rint((F.col("x") + 1) * 127.5).cast("long"))


@query("l6_compact_features", _TOP.format(k=16) + " SELECT vec_id, list(b ORDER BY dim) AS bytes FROM q GROUP BY vec_id")
def l6(spark, d):
    """The 16 best dimensions by Fisher score, a byte each."""
    q = _compact(spark, d, 16)
    return q.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "b"))), lambda s: s["b"]).alias("bytes"))


@query("l7_compact_matcher", _TOP.format(k=16) + ", cen AS (SELECT person, dim, avg(b) AS m FROM q WHERE NOT probe AND known GROUP BY ALL), near AS (SELECT q.vec_id, cen.person, round(sum((b - m) * (b - m)), 6) AS d FROM q JOIN cen USING (dim) WHERE q.probe GROUP BY q.vec_id, cen.person) SELECT vec_id, first(person ORDER BY d, person) AS best FROM near GROUP BY vec_id")
def l7(spark, d):
    """Nearest centroid among compact features; the join is by dimension, the centroids are small and broadcast by size."""
    q = _compact(spark, d, 16)
    c = q.where("not probe and known").groupBy("person", "dim").agg(F.avg("b").alias("m")).withColumnRenamed("person", "name")
    x = q.where("probe").select("vec_id", "dim", "b").join(c, "dim").groupBy("vec_id", "name").agg(F.round(F.sum((F.col("b") - F.col("m")) * (F.col("b") - F.col("m"))), 6).alias("d"))
    return pairs.best(x, ["vec_id"], [F.col("d"), F.col("name")], ["name"]).withColumnRenamed("name", "best")


@query("l9_single_image_enrollment", f"WITH {T.FEAT}, one AS (SELECT person AS name, first(v ORDER BY vec_id) AS u FROM feat WHERE NOT probe AND known GROUP BY person), x AS (SELECT p.vec_id, p.person, p.known, name, round(sqrt(list_sum(list_transform(list_zip(p.v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM feat p, one WHERE p.probe), b AS (SELECT vec_id, person, known, first(name ORDER BY d, name) AS best FROM x GROUP BY ALL) SELECT person, count(*) AS probes, count(*) FILTER (WHERE best = person) AS hits FROM b WHERE known GROUP BY person")
def l9(spark, d):
    """One image, the first, enrols each identity; how often its other images find it."""
    one = T.members(spark, d).groupBy(F.col("person").alias("name")).agg(F.min_by("v", "vec_id").alias("u"))
    best = M.arg_min(T.probes(spark, d).where("known").select("vec_id", "person", "v"), one, ["vec_id", "person"], F.round(V.euclidean(F.col("v"), F.col("u")), 9), "name")
    return best.groupBy("person").agg(F.count("*").alias("probes"), F.count_if(F.col("name") == F.col("person")).alias("hits"))


def prepared(spark, d):
    """vec_id, label, person, probe, known, equalizer, v: pixels of every tile under three preparations."""
    t = images(spark, d).join(T.feat(spark, d).select("vec_id", "label", "person", "probe", "known"), "vec_id")
    kinds = F.array(*[F.struct(F.lit(n).alias("equalizer"), x.alias("v")) for n, x in (("none", F.col("tile")), ("hist", G.equalized(F.col("tile"))), ("tan_triggs", G.tan_triggs(F.col("tile"), SIDE)))])
    return t.select("vec_id", "label", "person", "probe", "known", F.explode(kinds).alias("k")).select("vec_id", "label", "person", "probe", "known", "k.equalizer", F.col("k.v").cast("array<double>").alias("v"))


def swept(spark, d):
    """equalizer, components, vec_id, person, known, name, d: nearest template of each probe under each configuration."""
    every, out = written(prepared(spark, d)), None
    for equalizer in ("none", "hist", "tan_triggs"):
        rows = every.where(F.col("equalizer") == equalizer)
        one = subspace.projected(rows, subspace.pca(rows.where("not probe and known"), 32)).drop("v")
        out = one if out is None else out.unionByName(one)
    p = written(out)
    u = p.where("not probe and known").select("equalizer", F.col("person").alias("name"), F.col("p").alias("u"))
    # axes come in order, so the first ones are the smaller subspaces
    near = tiles.nearest_name(p.where("probe"), ["vec_id", "person", "known"], "p", u, "name", "u", ["equalizer"], cuts=[8, 16, 32])
    return near.withColumnRenamed("cut", "components")


@query("l10_config_sweep")
def l10(spark, d):
    """Rank-1 rates of a principal subspace, by preparation of the images and number of components."""
    hit = (F.col("name") == F.col("person")).cast("int")
    return swept(spark, d).where("known").groupBy("equalizer", "components").agg(F.count("*").alias("probes"), F.round(F.avg(hit), 6).alias("rank1"))


_GRID = _FISHER + """, top AS (SELECT list(dim ORDER BY round(f, 9) DESC, dim) AS dims FROM fs), grid AS (SELECT k, bits, mode FROM unnest([16, 32, 64]) AS a(k), unnest([8, 16, 32]) AS b(bits), unnest(['centroid', 'all']) AS c(mode)),
q AS (SELECT vec_id, probe, known, person, k, bits, list_transform(dims[1:k], lambda i: CASE bits WHEN 32 THEN v[i + 1] ELSE round_even((v[i + 1] + 1) * (pow(2, bits) - 1) / 2, 0) END) AS b FROM feat, top, (SELECT DISTINCT k, bits FROM grid) AS kb),
alls AS (SELECT k, bits, person AS name, vec_id AS template, b AS u FROM q WHERE NOT probe AND known),
cents AS (SELECT k, bits, person AS name, 0 AS template, list(m ORDER BY i) AS u FROM (SELECT k, bits, person, u.i, avg(b[u.i]) AS m FROM q, unnest(range(1, 65)) AS u(i) WHERE NOT probe AND known AND u.i <= k GROUP BY ALL) GROUP BY ALL),
model AS (SELECT 'all' AS mode, * FROM alls UNION ALL SELECT 'centroid', * FROM cents),
near AS (SELECT q.k, q.bits, mode, q.vec_id, q.person, q.known, name, round(sqrt(list_sum(list_transform(list_zip(b, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / CASE q.bits WHEN 32 THEN 1 ELSE pow(2, q.bits) END, 6) AS d FROM q JOIN model m ON m.k = q.k AND m.bits = q.bits WHERE probe),
best AS (SELECT k, bits, mode, vec_id, person, known, first(name ORDER BY d, name) AS name, min(d) AS d FROM near GROUP BY ALL)"""


def variants(spark, d):
    """k, bits, mode, vec_id, person, known, name, d: the nearest of each probe under 18 compact forms of the vectors: the k
    best dimensions by Fisher score, so many bits each, templates kept as centroids or all of them."""
    top = fisher_scores(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("f", 9)).alias("f"), "dim"))), lambda s: s["dim"]).alias("dims"))  # one row of as many numbers as dimensions
    x = T.feat(spark, d).crossJoin(F.broadcast(top)).withColumn("k", F.explode(F.array(*map(F.lit, (16, 32, 64))))).withColumn("bits", F.explode(F.array(*map(F.lit, (8, 16, 32)))))
    cut = F.transform(F.slice("dims", F.lit(1), F.col("k")), lambda i: F.get(F.col("v"), i))
    x = x.withColumn("b", F.when(F.col("bits") == 32, cut).otherwise(F.transform(cut, lambda y: F.rint((y + 1) * (F.pow(F.lit(2.0), F.col("bits")) - 1) / 2))))
    x = written(x.select("k", "bits", "vec_id", "probe", "known", "person", "b"))
    member = x.where("not probe and known")
    keyed = member.withColumn("key", F.concat_ws("/", "k", "bits", "person"))
    cents = M.mean_vector(keyed, "key", "b").join(keyed.select("key", "k", "bits", "person").distinct(), "key").select(F.lit("centroid").alias("mode"), "k", "bits", F.col("person").alias("name"), F.col("centroid").alias("u"))
    model = cents.unionByName(member.select(F.lit("all").alias("mode"), "k", "bits", F.col("person").alias("name"), F.col("b").alias("u")))
    # distances are over 2 to the bits, and so may the components be without another digit
    short = lambda b: F.when(F.col("bits") == 32, F.col(b)).otherwise(F.transform(b, lambda y: y / F.pow(F.lit(2.0), F.col("bits"))))
    probes = x.where("probe").select("k", "bits", "vec_id", "person", "known", short("b").alias("p"))
    keep, out = ["vec_id", "person", "known"], None
    for mode in ("centroid", "all"):
        one = tiles.nearest_name(probes, keep, "p", model.where(F.col("mode") == mode).select("k", "bits", "name", short("u").alias("u")), "name", "u", ["k", "bits"]).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("k", "bits", "mode", *keep, "name", "d")


@query("l11_variant_grid", _GRID + " SELECT k, bits, mode, k * bits // 8 AS bytes, round(avg((name = person)::INT) FILTER (WHERE known), 6) AS rank1 FROM best GROUP BY k, bits, mode")
def l11(spark, d):
    """Bytes and rank-1 rate of the 18 forms."""
    hit = F.when(F.col("known"), (F.col("name") == F.col("person")).cast("int"))
    return variants(spark, d).groupBy("k", "bits", "mode").agg(F.round(F.avg(hit), 6).alias("rank1")).select("k", "bits", "mode", F.expr("k * bits div 8").alias("bytes"), "rank1")


@query("q15_variant_compare", _GRID + ", e AS (SELECT k, bits, mode, k * bits // 8 AS bytes, round(avg((name = person)::INT) FILTER (WHERE known), 6) AS rank1, round(avg(d) FILTER (WHERE NOT known) - avg(d) FILTER (WHERE known), 5) AS gap FROM best GROUP BY k, bits, mode) SELECT *, k < 64 OR bits < 32 OR mode <> 'all' AS edited, row_number() OVER (ORDER BY k < 64 OR bits < 32 OR mode <> 'all', -rank1, bytes, k, mode) AS place FROM e")
def q15(spark, d):
    """The forms with size, rank-1 rate and the gap between impostors and genuines: the unedited one first, then the best."""
    known, hit = F.col("known"), (F.col("name") == F.col("person")).cast("int")
    g = variants(spark, d).groupBy("k", "bits", "mode").agg(F.round(F.avg(F.when(known, hit)), 6).alias("rank1"), F.round(F.avg(F.when(~known, F.col("d"))) - F.avg(F.when(known, F.col("d"))), 5).alias("gap"))
    g = g.select("k", "bits", "mode", F.expr("k * bits div 8").alias("bytes"), "rank1", "gap", ((F.col("k") < 64) | (F.col("bits") < 32) | (F.col("mode") != "all")).alias("edited"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("edited", -F.col("rank1"), "bytes", "k", "mode")).cast("long"))  # a row for each form


@query("q16_config_sweep")
def q16(spark, d):
    """Each configuration with rank-1 rate, the rate of true accepts at 10 percent false ones, and the equal error rate."""
    own = ["equalizer", "components"]
    s = written(swept(spark, d)).select(*own, "d", F.when(F.col("known"), "genuine").otherwise("impostor").alias("kind"), (F.col("name") == F.col("person")).alias("ok"))
    imp, genuine = s.where("kind = 'impostor'"), s.where("kind = 'genuine'")
    want = imp.groupBy(*own).agg(F.count("*").alias("n")).select(*own, F.expr("greatest(1, n div 10)").alias("k"))
    t = ranks.at_ranks(imp, "d", want, own).select(*own, F.col("value").alias("threshold"))
    rates = genuine.join(F.broadcast(t), own).groupBy(*own, "threshold").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("rank1"), F.round(100.0 * F.count_if(F.col("ok") & (F.col("d") <= F.col("threshold"))) / F.count("*"), 6).alias("tar_percent"))
    eer = curves.eer(curves.roc(s, by=own), own).select(*own, F.round("eer", 6).alias("eer"))
    return rates.join(eer, own)


_TESTED = f"WITH {T.FEAT}, recipes(recipe, least) AS (VALUES ('all', 0), ('two', 2), ('four', 4), ('light', 1), ('dark', 1)), m AS (SELECT recipe, f.vec_id, person, v FROM feat f, recipes WHERE NOT probe AND known AND CASE recipe WHEN 'two' THEN vec_id % 2 = 1 WHEN 'four' THEN vec_id % 4 = 1 WHEN 'light' THEN bucket <> 'b2' WHEN 'dark' THEN bucket = 'b2' ELSE true END), c AS (SELECT recipe, person AS name, list(x ORDER BY i) AS u FROM (SELECT recipe, person, u.i, avg(v[u.i]) AS x FROM m, unnest(range(1, 65)) AS u(i) GROUP BY ALL) GROUP BY ALL), n AS (SELECT recipe, p.bucket AS testset, p.vec_id, p.person, p.known, first(name ORDER BY round(sqrt(list_sum(list_transform(list_zip(p.v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9), name) AS name FROM feat p, c WHERE p.probe GROUP BY ALL)"


def recipes(spark, d):
    """recipe, testset, vec_id, person, known, name: probes against galleries of five recipes, by bucket of the probe."""
    f, i, b = T.members(spark, d).select("vec_id", "person", "bucket", "v"), F.col("vec_id"), F.col("bucket")
    taken = (("all", F.lit(True)), ("two", i % 2 == 1), ("four", i % 4 == 1), ("light", b != "b2"), ("dark", b == "b2"))
    m = f.withColumn("recipe", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in taken]), lambda x: x.isNotNull()))).withColumn("key", F.concat_ws("/", "recipe", "person"))
    c = M.mean_vector(m, "key").select(F.split("key", "/")[0].alias("recipe"), F.split("key", "/")[1].alias("name"), F.col("centroid").alias("u"))
    p = T.probes(spark, d).select("vec_id", "person", "known", F.col("bucket").alias("testset"), "v")
    x = pairs.each_with_each(p, c).withColumn("d", F.round(V.euclidean(F.col("v"), F.col("u")), 9))
    return pairs.best(x, ["recipe", "testset", "vec_id", "person", "known"], [F.col("d"), F.col("name")], ["name"])


@query("l13_recipe_matrix", _TESTED + " SELECT recipe, testset, count(*) AS n, round(avg((name = person)::INT), 6) AS rate FROM n WHERE known GROUP BY recipe, testset")
def l13(spark, d):
    """Five recipes of galleries against three test sets: rank-1 rates."""
    return recipes(spark, d).where("known").groupBy("recipe", "testset").agg(F.count("*").alias("n"), F.round(F.avg((F.col("name") == F.col("person")).cast("int")), 6).alias("rate"))


@query("q17_dataset_matrix", _TESTED + ", r AS (SELECT recipe, testset, round(avg((name = person)::INT), 6) AS rate FROM n WHERE known GROUP BY recipe, testset) SELECT recipe, round(max(rate) FILTER (WHERE testset = 'b0'), 6) AS b0, round(max(rate) FILTER (WHERE testset = 'b1'), 6) AS b1, round(max(rate) FILTER (WHERE testset = 'b2'), 6) AS b2 FROM r GROUP BY recipe")
def q17(spark, d):
    """The matrix of recipes and test sets, made unit by unit: a first run does some, a second what is missing; then the table."""
    at, units = f"{shared_dir(spark)}/outputs/{uuid.uuid4().hex}", written(recipes(spark, d).where("known"))
    work = lambda u: u.groupBy("recipe", "testset").agg(F.round(F.avg((F.col("name") == F.col("person")).cast("int")), 6).alias("rate"))
    sinks.write_units(work(units.where("recipe in ('all', 'dark')")), at, ["recipe", "testset"])
    done = sinks.resumed(units, at, ["recipe", "testset"], "rate double, recipe string, testset string", work)
    return done.groupBy("recipe").pivot("testset", ["b0", "b1", "b2"]).agg(F.round(F.max("rate"), 6))


_REPORT = "part string, name string, k long, value double, share double, query long, candidate long"
_STATS = ("lo", "hi", "mean", "std", "p01", "p05", "p10", "median")


@query(
    "q4_independence",
    f"WITH {T.FEAT}, {_UNIQUE}, {_ORDERED}, a AS (SELECT min(d) AS lo, max(d) AS hi, avg(d) AS mean, stddev_pop(d) AS std, quantile_cont(d, 0.01) AS p01, quantile_cont(d, 0.05) AS p05, quantile_cont(d, 0.1) AS p10, median(d) AS median FROM up), s AS (SELECT * FROM (UNPIVOT a ON {', '.join(_STATS)} INTO NAME name VALUE value)), r AS (SELECT *, row_number() OVER (ORDER BY d, query, candidate) AS rn, count(*) OVER () AS n FROM op) SELECT 'stats' AS part, name, NULL::BIGINT AS k, round(value, 6) AS value, round(avg((up.d <= round(value, 6))::INT), 6) AS share, NULL::BIGINT AS query, NULL::BIGINT AS candidate FROM s, up GROUP BY name, value UNION ALL SELECT 'error_pair', CASE WHEN rn = greatest(1, (1000 * n + 999999) // 1000000) THEN 'specified' ELSE 'curve' END, rn, round(d, 6), round(100 * d / (SELECT hi FROM a), 6), query, candidate FROM r WHERE list_contains([{', '.join(str(1 << i) for i in range(40))}], rn) OR rn = greatest(1, (1000 * n + 999999) // 1000000)",
)
def q4(spark, d):
    """An independence test over all identities: what distances are like, the shares that thresholds made of it accept, and the
    error pairs at ranks 1, 2, 4, .. and the specified one with their distances as they are and normalized to 100."""
    f, each, shares = T.feat(spark, d), pairs.distance_stats(T.feat(spark, d), "vec_id").first(), (0.01, 0.05, 0.1, 0.5)  # one row
    s = Spread(f, "vec_id", "v")
    unique, at = s.at(lambda n: sorted({1, n, *share_ranks(n, shares)}))
    if not unique:
        return spark.createDataFrame([], _REPORT)
    n, at = unique[None], at[None]
    mean = each.total / n
    values = dict(zip(_STATS, (at[1], at[n], mean, max(each.squares / n - mean * mean, 0.0) ** 0.5, *(percentile(at, n, p) for p in shares))))
    values = {k: rounded(x, 6) for k, x in values.items()}
    upto = {k: int(units(x, s.measure.digits)) + 1 for k, x in values.items()}
    e, below = tiles.placed(s, error_ranks, marks=list(upto.values()))
    stats = spark.createDataFrame([("stats", k, None, x, rounded(below[upto[k]] / n, 6), None, None) for k, x in values.items()], _REPORT)
    spec = F.col("k") == F.greatest(F.lit(1).cast("long"), F.expr("(1000 * n + 999999) div 1000000"))
    return stats.unionByName(e.select(F.lit("error_pair").alias("part"), F.when(spec, "specified").otherwise("curve").alias("name"), "k", F.round("d", 6).alias("value"), F.round(100 * F.col("d") / at[n], 6).alias("share"), "query", "candidate"))


@query(
    "q7_tar_far_report",
    f"""WITH {T.LARGE}{T.ROC}, r AS (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM s WHERE kind = 'impostor'), k AS (SELECT milli, n_imp, milli * n_imp // 100000 AS k FROM n, unnest([1058, 1000, 100, 10]) AS u(milli)),
    p AS (SELECT milli, CASE WHEN k >= 1 THEN (SELECT d FROM r WHERE rn = k) ELSE (SELECT min(d) FROM r) - 1e-9 END AS t FROM k), a AS (SELECT milli, round(p.t, 6) AS t, round(coalesce(max(roc.far), 0), 6) AS far, round(coalesce(max(roc.tar), 0), 6) AS tar FROM p LEFT JOIN roc ON roc.t <= p.t GROUP BY milli, p.t), e AS (SELECT (far + 100 - tar) / 2 AS eer FROM roc ORDER BY round(abs(far - (100 - tar)), 9), t LIMIT 1)
    SELECT '| ' || printf('%.3f', milli / 1000.0::DOUBLE) || ' | ' || printf('%.2f', t) || ' | ' || CASE WHEN far < 0.1 THEN printf('%.4f', far) || '% (' || printf('%.0f', far * 10000) || ' ppm)' ELSE printf('%.3f', far) || '%' END || ' | ' || printf('%.2f', tar) || ' |' AS line, round(eer, 6) AS eer FROM a, e""",
)
def q7(spark, d):
    """True accepts at given rates of false ones as the lines of a report, and the equal error rate."""
    s = T.scores_large(spark, d)
    c = curves.roc(s).withColumn("gap", F.round(F.abs(F.col("far") - F.col("frr")), 9))
    e = c.agg(F.min(F.struct("gap", "t", "far", "frr")).alias("m")).select(F.round((F.col("m.far") + F.col("m.frr")) / 2, 6).alias("eer"))
    rows = tar_at_far(s, (1058, 1000, 100, 10)).crossJoin(F.broadcast(e))
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.bround(c, n))
    return rows.select(sinks.markdown_row(fixed("target_far_percent", 3), fixed("threshold", 2), L.ppm_cell(F.col("actual_far_percent")), fixed("tar_percent", 2)).alias("line"), "eer")


@query("q18_gallery_consistency", f"WITH {T.FEAT} SELECT person, (count(*) FILTER (WHERE NOT probe)) > 0 AS in_gallery, (count(*) FILTER (WHERE probe)) > 0 AS in_probes FROM feat WHERE known OR probe GROUP BY person HAVING (count(*) FILTER (WHERE NOT probe AND known)) = 0")
def q18(spark, d):
    """Labels of probes that nobody enrolled."""
    enrolled = T.members(spark, d).select("person").distinct()
    left = T.feat(spark, d).where("known or probe").join(enrolled, "person", "left_anti")
    return left.groupBy("person").agg((F.count_if(~F.col("probe")) > 0).alias("in_gallery"), (F.count_if(F.col("probe")) > 0).alias("in_probes"))


@query(
    "q22_metrics_table",
    f"WITH {T.LARGE}, ar AS (SELECT bucket, round(100 * avg(m), 6) AS ar FROM (SELECT l_returnflag AS bucket, l_linenumber, avg((l_discount <= 0.05)::INT) AS m FROM lineitem GROUP BY ALL) GROUP BY bucket), q AS (SELECT bucket, d, kind, row_number() OVER (PARTITION BY bucket ORDER BY d) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM s WHERE kind = 'impostor'), th AS (SELECT bucket, d AS t FROM q WHERE rn = greatest(1, n // 10)), g AS (SELECT s.bucket, count(*) FILTER (WHERE kind = 'genuine') AS genuine, count(*) FILTER (WHERE kind = 'genuine' AND s.d <= th.t) AS accepted, count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*) AS rank1 FROM s JOIN th USING (bucket) GROUP BY s.bucket) SELECT bucket, genuine, accepted, ar, 'TAR(rank-1) ' || CASE WHEN rank1 >= 90 THEN 'PASS' ELSE 'below 90%' END || '; feature ' || CASE bucket WHEN 'A' THEN 'FAIL >=1KB' ELSE 'PASS <1KB' END || '; fps n/a' AS verdict FROM g JOIN ar USING (bucket)",
)
def q22(spark, d):
    """For each bucket: genuines accepted at the threshold of ten percent impostors, the mean ratio over levels, and the verdict."""
    s = T.scores_large(spark, d)
    imp = s.where("kind = 'impostor'").select("bucket", "d")
    want = imp.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.expr("greatest(1, n div 10)").alias("k"))
    th = ranks.at_ranks(imp, "d", want, ["bucket"]).select("bucket", F.col("value").alias("t"))
    genuine = F.col("kind") == "genuine"
    g = s.join(F.broadcast(th), "bucket").groupBy("bucket").agg(F.count_if(genuine).alias("genuine"), F.count_if(genuine & (F.col("d") <= F.col("t"))).alias("accepted"), (F.count_if("ok") * 100.0 / F.count("*")).alias("rank1"))
    li = T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("bucket"), "l_linenumber").agg(F.avg((F.col("l_discount") <= 0.05).cast("int")).alias("m"))
    ar = li.groupBy("bucket").agg(F.round(100 * F.avg("m"), 6).alias("ar"))
    size = F.when(F.col("bucket") == "A", 65536).otherwise(960)
    return g.join(ar, "bucket").select("bucket", "genuine", "accepted", "ar", L.verdict(F.col("rank1"), size, F.lit(None).cast("double")).alias("verdict"))
