"""Predicates P1-P9, P17, P18; joins J3-J6, J10, J12-J15; windows W7, W8, W10-W12; sets U1-U5; centroids A7, A8."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import boxes as B
from matchloom.functions import vectors as V
from matchloom.operators import matching as M
from matchloom.operators import pairs, tiles
from matchloom.plans import tables as T
from matchloom.plans.registry import query

_ROUNDED = "list_transform(centroid, lambda x: round(x, 6))"


@query("a7_weighted_centroid", f"WITH {T.GALLERY} SELECT person, sample_count, {_ROUNDED} AS centroid FROM gallery")
def a7(spark, d):
    return T.gallery(spark, d).withColumn("centroid", F.transform("centroid", lambda x: V.decimals(x, 6)))


@query("a8_mean_gallery", f"WITH {T.FEAT} SELECT person, count(*) // 64 AS sample_count, list(m ORDER BY pos) AS centroid FROM (SELECT person, u.i AS pos, round(avg(v[u.i]), 6) AS m, sum(count(*)) OVER (PARTITION BY person) AS k FROM feat, unnest(range(1, 65)) AS u(i) WHERE NOT probe AND known GROUP BY 1, 2), unnest(range(k::BIGINT // 64)) GROUP BY person".replace("count(*) // 64 AS sample_count, list(m ORDER BY pos) AS centroid", "max(k)::BIGINT // 64 AS sample_count, list(m ORDER BY pos) AS centroid").replace(", unnest(range(k::BIGINT // 64)) GROUP BY person", " GROUP BY person"))
def a8(spark, d):
    """The plain mean, not scaled to length one."""
    return M.mean_vector(T.members(spark, d), "person").withColumn("centroid", F.transform("centroid", lambda x: V.decimals(x, 6)))


@query("s20_features_to_mean", f"WITH {T.FEAT} SELECT person, round(avg(v[1]), 6) AS first, round(avg(v[64]), 6) AS last FROM feat GROUP BY person")
def s20(spark, d):
    m = M.mean_vector(T.feat(spark, d), "person")
    return m.select("person", V.decimals(F.col("centroid")[0], 6).alias("first"), V.decimals(F.col("centroid")[63], 6).alias("last"))


@query("j3_arg_max", f"WITH {T.MATCHES} SELECT vec_id, best_person, round(score, 6) AS score FROM matches")
def j3(spark, d):
    return T.matches(spark, d).select("vec_id", "best_person", V.decimals(F.col("score"), 6).alias("score"))


_NEAR = f""", far AS (SELECT p.vec_id, p.person AS truth, p.known, t.person AS name, t.vec_id AS template, round(sqrt(list_sum(list_transform(list_zip(p.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance
  FROM feat p, feat t WHERE p.probe AND NOT t.probe AND t.known),
own AS (SELECT vec_id, truth, known, name, min(distance) AS distance FROM far GROUP BY ALL)"""


def _distances(spark, d):
    """Each probe with each identity, at the distance of its nearest template: vec_id, truth, known, name, distance."""
    p = T.probes(spark, d).select("vec_id", F.col("person").alias("truth"), "known", "v")
    t = T.members(spark, d).select(F.col("person").alias("name"), F.col("vec_id").alias("template"), F.col("v").alias("u"))
    near = tiles.nearest(p, "vec_id", "v", t, "template", "u", "name").groupBy("vec_id", "name").agg(F.round(F.min("distance"), 9).alias("distance"))
    return p.select("vec_id", "truth", "known").join(near, "vec_id").select("vec_id", "truth", "known", "name", "distance")


@query("j4_arg_min_template", f"WITH {T.FEAT}{_NEAR} SELECT vec_id, template, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, template) AS rn FROM far) WHERE rn = 1")
def j4(spark, d):
    p = T.probes(spark, d).select("vec_id", "v")
    t = T.members(spark, d).select(F.col("vec_id").alias("template"), F.col("v").alias("u"))
    near = tiles.nearest(p, "vec_id", "v", t, "template", "u").withColumn("distance", F.round("distance", 9))
    return pairs.best(near, ["vec_id"], [F.col("distance"), F.col("template")], ["template", "distance"])


@query("j5_identity_top_two", f"WITH {T.FEAT}{_NEAR}, r AS (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS d2 FROM own WINDOW w AS (PARTITION BY vec_id ORDER BY distance, name)) SELECT vec_id, name AS best, distance AS d1, d2, round((d2 - distance) / greatest(distance, 1e-6), 6) AS margin FROM r WHERE rn = 1")
def j5(spark, d):
    return M.top_two(_distances(spark, d), "vec_id", "name").withColumn("margin", F.round("margin", 6))


@query("w7_relative_margin", f"WITH {T.FEAT}{_NEAR}, r AS (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS nxt FROM own WINDOW w AS (PARTITION BY vec_id ORDER BY distance, name)) SELECT vec_id, round(coalesce(nxt, distance + 999), 6) AS d2, round((coalesce(nxt, distance + 999) - distance) / greatest(distance, 1e-6), 6) AS margin FROM r WHERE rn = 1")
def w7(spark, d):
    """Where there is one identity only, its distance plus 999 is the second."""
    return M.top_two(_distances(spark, d), "vec_id", "name").select("vec_id", F.round("d2", 6).alias("d2"), F.round("margin", 6).alias("margin"))


@query("w8_absolute_margin", f"WITH {T.MATCHES}, r AS (SELECT vec_id, score AS c1, row_number() OVER w AS rn, lead(score) OVER w AS c2 FROM scored WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, other)) SELECT vec_id, round(c1 - coalesce(c2, -1), 6) AS margin FROM r WHERE rn = 1")
def w8(spark, d):
    g = T.gallery(spark, d).withColumnRenamed("person", "other")
    s = pairs.each_with_each(T.probes(spark, d).select("vec_id", "v"), g).withColumn("c1", V.dot(F.col("v"), F.col("centroid")))
    w = Window.partitionBy("vec_id").orderBy(F.desc("c1"), "other")
    r = s.withColumn("rn", F.row_number().over(w)).withColumn("c2", F.lead("c1").over(w)).where("rn = 1")
    return r.select("vec_id", F.round(F.col("c1") - F.coalesce("c2", F.lit(-1.0)), 6).alias("margin"))


@query("j6_own_and_best_other", f"WITH {T.MATCHES} SELECT vec_id, round(max(score) FILTER (WHERE other = person), 6) AS own, round(max(score) FILTER (WHERE other <> person), 6) AS best_other FROM scored GROUP BY vec_id")
def j6(spark, d):
    g = T.gallery(spark, d).withColumnRenamed("person", "other")
    s = pairs.each_with_each(T.probes(spark, d).select("vec_id", "person", "v"), g).withColumn("score", V.dot(F.col("v"), F.col("centroid")))
    own = F.max(F.when(F.col("other") == F.col("person"), F.col("score")))
    return s.groupBy("vec_id").agg(V.decimals(own, 6).alias("own"), V.decimals(F.max(F.when(F.col("other") != F.col("person"), F.col("score"))), 6).alias("best_other"))


@query("p1_distance_accept", f"WITH {T.FEAT}{_NEAR}, b AS (SELECT vec_id, first(name ORDER BY distance, name) AS name, min(distance) AS distance FROM own GROUP BY vec_id) SELECT vec_id, CASE WHEN distance <= 1.15 AND name <> 'Unknown' THEN name ELSE 'Unknown' END AS predicted FROM b")
def p1(spark, d):
    b = pairs.best(_distances(spark, d), ["vec_id"], [F.col("distance"), F.col("name")], ["name", "distance"])
    return b.select("vec_id", M.accepted_by_distance(F.col("name"), F.col("distance"), 1.15).alias("predicted"))


@query("p2_cosine_accept", f"WITH {T.MATCHES} SELECT vec_id, CASE WHEN score >= 0.25 THEN best_person ELSE 'Unknown' END AS predicted FROM matches")
def p2(spark, d):
    return T.matches(spark, d).select("vec_id", M.accepted_by_cosine(F.col("best_person"), F.col("score"), 0.25).alias("predicted"))


@query("p3_dual_rule", f"WITH {T.MATCHES} SELECT vec_id, other AS person, score >= 0.363 AND sqrt(greatest(0, 2 - 2 * score)) <= 1.128 AS accepted FROM scored")
def p3(spark, d):
    g = T.gallery(spark, d)
    s = pairs.each_with_each(T.probes(spark, d).select("vec_id", "v"), g).withColumn("c", V.dot(F.col("v"), F.col("centroid")))
    return s.select("vec_id", "person", M.accepted_by_both(F.col("c"), V.l2_from_cosine(F.col("c"))).alias("accepted"))


@query("p4_open_set_correct", f"WITH {T.MATCHES}, e AS (SELECT *, CASE WHEN score >= 0.2 THEN best_person ELSE 'Unknown' END AS predicted FROM matches) SELECT vec_id, CASE WHEN known THEN predicted = person ELSE predicted = 'Unknown' END AS ok FROM e")
def p4(spark, d):
    e = T.matches(spark, d).withColumn("predicted", M.accepted_by_cosine(F.col("best_person"), F.col("score"), 0.2))
    return e.select("vec_id", M.correct(F.col("person"), F.col("predicted"), F.col("known")).alias("ok"))


@query("p5_closed_set_skip", f"WITH {T.FEAT} SELECT vec_id, person FROM feat WHERE probe AND person IN (SELECT person FROM feat WHERE NOT probe AND known)")
def p5(spark, d):
    return T.probes(spark, d).join(T.members(spark, d).select("person").distinct(), "person", "left_semi").select("vec_id", "person")


@query("p6_skip_status", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'unreadable' WHEN quality IS NULL THEN 'unseen' ELSE 'ok' END AS unreadable_first, CASE WHEN quality IS NULL THEN 'unseen' WHEN n_chars < 300 THEN 'unreadable' ELSE 'ok' END AS unseen_first FROM documents LEFT JOIN labels USING (doc_id)")
def p6(spark, d):
    """The order of the two reasons to skip differs between evaluators."""
    r = T.read(spark, d, "documents").join(T.read(spark, d, "labels"), "doc_id", "left")
    unreadable, unseen = F.col("n_chars") < 300, F.col("quality").isNull()
    return r.select("doc_id", F.when(unreadable, "unreadable").when(unseen, "unseen").otherwise("ok").alias("unreadable_first"), F.when(unseen, "unseen").when(unreadable, "unreadable").otherwise("ok").alias("unseen_first"))


@query("p7_size_filter", "SELECT p_partkey, CASE WHEN p_size < 20 OR p_size + p_partkey % 30 < 30 THEN 'image_too_small' END AS reason FROM part")
def p7(spark, d):
    return T.read(spark, d, "part").select("p_partkey", F.when((F.col("p_size") < 20) | (F.col("p_size") + F.col("p_partkey") % 30 < 30), "image_too_small").alias("reason"))


_BOX = "b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 140 - 20)::BIGINT AS x, (l_suppkey % 120 - 10)::BIGINT AS y, (l_quantity * 2)::BIGINT AS w, (l_quantity + 10)::BIGINT AS h FROM lineitem)"


def _boxes(spark, d):
    li = T.read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 140 - 20).alias("x"), (F.col("l_suppkey") % 120 - 10).alias("y"), (F.col("l_quantity") * 2).cast("long").alias("w"), (F.col("l_quantity") + 10).cast("long").alias("h"))


@query("p8_box_clamp", f"WITH {_BOX}, c AS (SELECT *, greatest(0, least(99, x)) AS cx, greatest(0, least(99, y)) AS cy FROM b) SELECT l_orderkey, l_linenumber, cx AS x, cy AS y, greatest(1, least(100 - cx, w)) AS w, greatest(1, least(100 - cy, h)) AS h FROM c")
def p8(spark, d):
    return _boxes(spark, d).select("l_orderkey", "l_linenumber", B.clamp(*map(F.col, "xywh"), 100, 100).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("p9_face_pick", f"WITH {_BOX} SELECT l_orderkey, first(l_linenumber ORDER BY w * h DESC, l_linenumber) AS by_area, first(l_linenumber ORDER BY w DESC, l_linenumber) AS by_score FROM b GROUP BY l_orderkey")
def p9(spark, d):
    """The largest face, or the one with the best score (here: width)."""
    b = _boxes(spark, d)
    pick = lambda c: F.max_by("l_linenumber", F.struct(c, -F.col("l_linenumber")))
    return b.groupBy("l_orderkey").agg(pick(F.col("w") * F.col("h")).alias("by_area"), pick(F.col("w")).alias("by_score"))


@query("f10_iou", f"WITH {_BOX}, n AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(w) OVER o AS w2, lead(h) OVER o AS h2 FROM b WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, w, h)), a AS (SELECT *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS i FROM n WHERE x2 IS NOT NULL) SELECT l_orderkey, l_linenumber, round(i::DOUBLE / (w * h + w2 * h2 - i), 6) AS iou FROM a")
def f10(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "box")
    b = _boxes(spark, d).select("l_orderkey", "l_linenumber", F.struct("x", "y", "w", "h").alias("box")).withColumn("nxt", F.lead("box").over(w)).where("nxt is not null")
    return b.select("l_orderkey", "l_linenumber", F.round(B.iou(F.col("box"), F.col("nxt")), 6).alias("iou"))


@query("f11_points_to_box", f"WITH {T.FEAT}, p AS (SELECT vec_id, v[1:8] AS xs, v[9:16] AS ys FROM feat) SELECT vec_id, round(list_min(xs), 6) AS x, round(list_min(ys), 6) AS y, round(list_max(xs) - list_min(xs), 6) AS w, round(list_max(ys) - list_min(ys), 6) AS h FROM p")
def f11(spark, d):
    box = B.around(F.slice("v", 1, 8), F.slice("v", 9, 8))
    return T.feat(spark, d).select("vec_id", box.alias("b")).select("vec_id", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in "xywh"])


@query("f12_pose_angle", f"WITH {T.FEAT}, p AS (SELECT vec_id, v[3] - v[1] AS dx, v[4] - v[2] AS dy, v[5] AS nx, (v[1] + v[3]) / 2 AS mx FROM feat), r AS (SELECT *, abs(degrees(atan2(dy, dx))) AS a, sqrt(dx * dx + dy * dy) AS gap FROM p), f AS (SELECT *, CASE WHEN a > 90 THEN 180 - a ELSE a END AS roll FROM r) SELECT vec_id, round(CASE WHEN gap < 1e-3 THEN roll ELSE greatest(roll, least(90, 90 * abs(nx - mx) / gap)) END, 5) AS pose FROM f")
def f12(spark, d):
    pt = lambda i: F.struct(F.col("v")[i].alias("x"), F.col("v")[i + 1].alias("y"))
    return T.feat(spark, d).select("vec_id", F.round(B.pose_angle(pt(0), pt(2), pt(4)), 5).alias("pose"))


@query("p17_impostors", f"WITH {T.FEAT} SELECT vec_id, person FROM feat WHERE person NOT IN (SELECT person FROM feat WHERE NOT probe AND known)")
def p17(spark, d):
    return T.feat(spark, d).join(T.members(spark, d).select("person").distinct(), "person", "left_anti").select("vec_id", "person")


@query("p18_tolerance_gate", f"WITH {T.LARGE} SELECT bucket, round(avg(d), 4) AS mean, abs(avg(d) - a) <= 500 AS passes FROM s, (SELECT avg(d) AS a FROM s) GROUP BY bucket, a")
def p18(spark, d):
    s = T.scores_large(spark, d)
    return s.groupBy("bucket").agg(F.avg("d").alias("m")).crossJoin(F.broadcast(s.agg(F.avg("d").alias("a")))).select("bucket", F.round("m", 4).alias("mean"), (F.abs(F.col("m") - F.col("a")) <= 500).alias("passes"))


@query("j10_nearest_key", "WITH p AS (SELECT unnest([0.01, 0.1, 1.058, 5.0, 10.0]::DOUBLE[]) AS target), x AS (SELECT s_suppkey, round(s_acctbal / 1000, 4) AS v FROM supplier) SELECT target, first(s_suppkey ORDER BY abs(target - v), s_suppkey) AS s_suppkey FROM p, x GROUP BY target")
def j10(spark, d):
    """The row nearest to each target, the first on ties."""
    x = T.read(spark, d, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 1000, 4).alias("v")).withColumn("target", F.explode(F.array(*map(F.lit, (0.01, 0.1, 1.058, 5.0, 10.0)))))
    return x.groupBy("target").agg(F.min(F.struct(F.abs(F.col("target") - F.col("v")).alias("gap"), "s_suppkey")).alias("m")).select("target", "m.s_suppkey")


@query("j12_is_known", f"WITH {T.FEAT} SELECT vec_id, person IN (SELECT person FROM feat WHERE NOT probe AND known) AS is_known FROM feat WHERE probe")
def j12(spark, d):
    names = T.members(spark, d).select("person").distinct().withColumn("hit", F.lit(True))
    return T.probes(spark, d).join(names, "person", "left").select("vec_id", F.coalesce("hit", F.lit(False)).alias("is_known"))


@query("j13_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j13(spark, d):
    done = T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.read(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("j14_zip", f"WITH {T.FEAT}{_NEAR}, r AS (SELECT vec_id, list(name ORDER BY distance, name) AS names, list(distance ORDER BY distance, name) AS ds FROM own GROUP BY vec_id) SELECT vec_id, names[u.i] AS name, ds[u.i] AS distance FROM r, unnest(range(1, 4)) AS u(i)")
def j14(spark, d):
    """Two ordered lists put together by position."""
    packed = _distances(spark, d).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("distance", "name"))).alias("s"))
    lists = packed.select("vec_id", F.transform("s", lambda x: x["name"]).alias("names"), F.transform("s", lambda x: x["distance"]).alias("ds"))
    return lists.select("vec_id", F.explode(F.slice(F.arrays_zip("names", "ds"), 1, 3)).alias("z")).select("vec_id", F.col("z.names").alias("name"), F.col("z.ds").alias("distance"))


@query("u1_union_buckets", f"WITH {T.FEAT} SELECT vec_id, bucket FROM feat WHERE bucket = 'b0' UNION ALL SELECT vec_id, bucket FROM feat WHERE bucket = 'b2'")
def u1(spark, d):
    f = T.feat(spark, d).select("vec_id", "bucket")
    return f.where("bucket = 'b0'").unionByName(f.where("bucket = 'b2'"))


@query("u2_distinct_thresholds", f"WITH {T.SMALL} SELECT d FROM s WHERE kind = 'genuine' UNION SELECT d FROM s WHERE kind = 'impostor'")
def u2(spark, d):
    s = T.scores_small(spark, d)
    return s.where("kind = 'genuine'").select("d").union(s.where("kind = 'impostor'").select("d")).distinct()


@query("u3_label_difference", "SELECT coalesce(a.k, b.k) AS nation, a.k IS NULL AS missing_left, b.k IS NULL AS missing_right FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u3(spark, d):
    a = T.read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).distinct().withColumn("l", F.lit(1))
    b = T.read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).distinct().withColumn("r", F.lit(1))
    return a.join(b, "nation", "full").where("l is null or r is null").select("nation", F.col("l").isNull().alias("missing_left"), F.col("r").isNull().alias("missing_right"))


@query("u4_key_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u4(spark, d):
    return T.read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(T.read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u5_distinct_severities", "SELECT DISTINCT round(l_discount, 2) AS severity FROM lineitem")
def u5(spark, d):
    return T.read(spark, d, "lineitem").select(F.round("l_discount", 2).alias("severity")).distinct()
