"""Reports: A20-A23, A33-A35, A38, J7-J9, J11, J16, J17, P13, P14, P16, W10-W12, F14-F21, F23-F26, sinks K1-K6, K11."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from matchloom.functions import labels as L
from matchloom.operators import ranks
from matchloom.plans import tables as T
from matchloom.plans.registry import query
from matchloom.plans.scans import _REPORTS, reports
from matchloom.sources import sinks


@query("j7_bucket_delta", "WITH a AS (SELECT l_shipdate::DATE AS k, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_shipdate::DATE AS k, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1) SELECT strftime(coalesce(a.k, b.k), '%Y-%m-%d') AS bucket, round(coalesce(a.m, 0), 6) + 0.0 AS left_rate, round(coalesce(b.m, 0), 6) + 0.0 AS right_rate, round(coalesce(b.m, 0) - coalesce(a.m, 0), 6) + 0.0 AS delta FROM a FULL JOIN b ON a.k = b.k")
def j7(spark, d):
    """Buckets of either side; a missing one counts 0."""
    li = T.read(spark, d, "lineitem").withColumn("bucket", F.date_format("l_shipdate", "yyyy-MM-dd"))
    a = li.where("l_returnflag = 'A'").groupBy("bucket").agg(F.avg("l_discount").alias("a"))
    b = li.where("l_returnflag = 'R' and l_linestatus = 'F'").groupBy("bucket").agg(F.avg("l_discount").alias("b"))
    left, right = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return a.join(b, "bucket", "full").select("bucket", (F.round(left, 6) + 0.0).alias("left_rate"), (F.round(right, 6) + 0.0).alias("right_rate"), (F.round(right - left, 6) + 0.0).alias("delta"))


_FPS = "fps AS (SELECT CASE user_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'delta' END AS family, value FROM events)"


def fps_runs(spark, d):
    u = F.col("user_id")
    return T.read(spark, d, "events").select(F.when(u % 5 == 0, "alpha").when(u % 5 == 1, "beta").when(u % 5 == 2, "delta").alias("family"), "value", "ts", "user_id")


@query("j8_fps_lookup", f"WITH {_REPORTS}, {_FPS}, m AS (SELECT family, round(avg(value), 6) AS fps FROM fps WHERE family IS NOT NULL GROUP BY family) SELECT r.id, m.fps FROM r LEFT JOIN m ON r.family = m.family")
def j8(spark, d):
    m = fps_runs(spark, d).where("family is not null").groupBy("family").agg(F.round(F.avg("value"), 6).alias("fps"))
    return reports(spark, d).join(m, "family", "left").select("id", "fps")


@query("j9_two_lookups", f"WITH {_REPORTS}, a AS (SELECT family, round(max(hit_rate), 6) AS tar FROM r GROUP BY family), b AS (SELECT family, count(*) AS n FROM r WHERE rank1 > 0.5 GROUP BY family) SELECT r.id, a.tar, b.n FROM r LEFT JOIN a ON a.family = r.family LEFT JOIN b ON b.family = r.family")
def j9(spark, d):
    r = reports(spark, d)
    a = r.where("family is not null").groupBy("family").agg(F.round(F.max("hit_rate"), 6).alias("tar"))
    b = r.where("rank1 > 0.5 and family is not null").groupBy("family").agg(F.count("*").alias("n"))
    return r.join(a, "family", "left").join(b, "family", "left").select("id", "tar", "n")


@query("j11_matrix_assembly", f"WITH {_REPORTS} SELECT label, round(avg(rank1) FILTER (WHERE family = 'alpha'), 6) AS alpha, round(avg(rank1) FILTER (WHERE family = 'beta'), 6) AS beta, round(avg(rank1) FILTER (WHERE family = 'gamma'), 6) AS gamma FROM r GROUP BY label")
def j11(spark, d):
    p = reports(spark, d).groupBy("label").pivot("family", ["alpha", "beta", "gamma"]).agg(F.avg("rank1"))
    return p.select("label", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "gamma")])


@query("j16_artifact_pairing", "SELECT p.p_partkey AS model, s.s_suppkey AS labels FROM part p JOIN supplier s ON lpad((p.p_partkey % 1000)::VARCHAR, 9, '0') = regexp_extract(s.s_name, '(\\d+)$', 1)")
def j16(spark, d):
    """Models and label files whose names end alike."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("model"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 9, "0").alias("suffix"))
    s = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("labels"), F.regexp_extract("s_name", r"(\d+)$", 1).alias("suffix"))
    return p.join(s, "suffix").select("model", "labels")


@query("j17_existing_report", f"WITH {_REPORTS} SELECT id FROM r WHERE family = 'alpha' AND label IN (SELECT label FROM r WHERE family = 'beta' AND rank1 > 0.95)")
def j17(spark, d):
    r = reports(spark, d)
    return r.where("family = 'alpha'").join(r.where("family = 'beta' and rank1 > 0.95").select("label"), "label", "left_semi").select("id")


@query("a20_accuracy_ratio", "WITH l AS (SELECT l_linestatus AS family, l_returnflag AS modification, l_linenumber AS level, avg((l_discount <= 0.05)::INT) AS k FROM lineitem GROUP BY ALL), m AS (SELECT family, modification, avg(k) AS ar FROM l GROUP BY ALL) SELECT family, round(100 * avg(ar), 6) AS overall FROM m GROUP BY family")
def a20(spark, d):
    """Matches over levels, then the mean of levels, then the plain mean of modifications."""
    li = T.read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("family"), F.col("l_returnflag").alias("modification"), "l_linenumber").agg(F.avg((F.col("l_discount") <= 0.05).cast("int")).alias("k"))
    return li.groupBy("family", "modification").agg(F.avg("k").alias("ar")).groupBy("family").agg(F.round(100 * F.avg("ar"), 6).alias("overall"))


@query("a21_severity_tiers", "WITH s AS (SELECT DISTINCT round(l_discount, 2) AS severity FROM lineitem), r AS (SELECT severity, row_number() OVER (ORDER BY severity) AS rank, count(*) OVER () AS m FROM s) SELECT severity, round_even(2.0::DOUBLE * (rank - 1) / (m - 1), 0)::BIGINT AS tier FROM r WHERE m > 1")
def a21(spark, d):
    s = T.read(spark, d, "lineitem").select(F.round("l_discount", 2).alias("severity")).distinct()
    n = s.agg(F.count("*").alias("m"))
    r = s.withColumn("rank", F.dense_rank().over(Window.orderBy("severity"))).crossJoin(F.broadcast(n)).where("m > 1")
    return r.select("severity", F.rint(2.0 * (F.col("rank") - 1) / (F.col("m") - 1)).cast("long").alias("tier"))


@query("a22_entity_latest", f"WITH {_REPORTS}, k AS (SELECT *, coalesce(family || '::' || label, 'none::' || label) AS entity_key FROM r) SELECT entity_key, count(*) AS runs, first(id ORDER BY mtime DESC, id DESC) AS latest, round(first(rank1 ORDER BY mtime DESC, id DESC), 6) AS rank1 FROM k GROUP BY entity_key")
def a22(spark, d):
    k = reports(spark, d).withColumn("entity_key", F.concat_ws("::", F.coalesce("family", F.lit("none")), "label"))
    newest = F.max(F.struct("mtime", "id", "rank1"))
    return k.groupBy("entity_key").agg(F.count("*").alias("runs"), newest.alias("x")).select("entity_key", "runs", F.col("x.id").alias("latest"), F.round("x.rank1", 6).alias("rank1"))


@query("a23_weighted_fps", "WITH r AS (SELECT user_id, count(*) AS frames, epoch(max(ts)) - epoch(min(ts)) AS seconds, avg(value) AS average_fps FROM events GROUP BY user_id) SELECT user_id % 5 AS algorithm, count(*) AS runs, round(CASE WHEN sum(seconds) > 0 THEN sum(frames)::DOUBLE / sum(seconds) ELSE avg(average_fps) END, 8) AS weighted_fps FROM r GROUP BY 1")
def a23(spark, d):
    """All frames over all seconds; the mean of runs where there are no seconds."""
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    r = T.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("frames"), (micros / 1e6).alias("seconds"), F.avg("value").alias("average_fps"))
    return r.groupBy((F.col("user_id") % 5).alias("algorithm")).agg(F.count("*").alias("runs"), F.round(F.when(F.sum("seconds") > 0, F.sum("frames") / F.sum("seconds")).otherwise(F.avg("average_fps")), 8).alias("weighted_fps"))


@query("a33_failure_means", "SELECT l_returnflag AS algorithm, l_linenumber % 10 AS run_group, round(avg(l_quantity), 6) AS quantity, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY ALL")
def a33(spark, d):
    return T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("algorithm"), (F.col("l_linenumber") % 10).alias("run_group")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_tax"), 6).alias("tax"))


_BLOCKED = "m AS (SELECT l_returnflag AS algorithm, l_linenumber AS region, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), b AS (SELECT algorithm, v AS base FROM m WHERE region = 1)"


@query("a34_occlusion_impact", f"WITH {_BLOCKED} SELECT algorithm, first(region ORDER BY base - v DESC, region) AS region, round(max(base - v), 4) AS impact FROM m JOIN b USING (algorithm) WHERE region <> 1 GROUP BY algorithm")
def a34(spark, d):
    m = T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("algorithm"), F.col("l_linenumber").alias("region")).agg(F.avg("l_extendedprice").alias("v"))
    j = m.where("region <> 1").join(m.where("region = 1").select("algorithm", F.col("v").alias("base")), "algorithm").withColumn("impact", F.col("base") - F.col("v"))
    return j.groupBy("algorithm").agg(F.max_by("region", F.struct("impact", -F.col("region"))).alias("region"), F.round(F.max("impact"), 4).alias("impact"))


@query("a35_relative", "WITH m AS (SELECT l_returnflag AS algorithm, l_linenumber AS stage, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT algorithm, stage, round(100 * v / max(v) OVER (PARTITION BY algorithm), 6) AS relative FROM m")
def a35(spark, d):
    m = T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("algorithm"), F.col("l_linenumber").alias("stage")).agg(F.avg("l_extendedprice").alias("v"))
    return m.select("algorithm", "stage", F.round(100 * F.col("v") / F.max("v").over(Window.partitionBy("algorithm")), 6).alias("relative"))


@query("a38_worst_three", "WITH m AS (SELECT l_linestatus AS family, l_linenumber AS modification, round(avg((l_discount <= 0.05)::INT), 9) AS ar FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ar, modification) AS rn FROM m) SELECT family, string_agg(modification, ',' ORDER BY rn) AS worst FROM r WHERE rn <= 3 GROUP BY family")
def a38(spark, d):
    m = T.read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("family"), F.col("l_linenumber").alias("modification")).agg(F.round(F.avg((F.col("l_discount") <= 0.05).cast("int")), 9).alias("ar"))
    r = m.withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy("ar", "modification"))).where("rn <= 3")
    return r.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "modification"))), lambda x: x["modification"].cast("string")), ",").alias("worst"))


@query("p13_metric_fallback", f"WITH {_REPORTS} SELECT id, coalesce(rank1, hit_rate, round((id % 100) / 100.0::DOUBLE, 6)) AS metric, CASE WHEN rank1 IS NOT NULL THEN 'rank1' WHEN hit_rate IS NOT NULL THEN 'hit_rate' ELSE 'counts' END AS origin FROM r")
def p13(spark, d):
    return reports(spark, d).select("id", F.coalesce("rank1", "hit_rate", F.round(F.col("id") % 100 / 100.0, 6)).alias("metric"), F.when(F.col("rank1").isNotNull(), "rank1").when(F.col("hit_rate").isNotNull(), "hit_rate").otherwise("counts").alias("origin"))


@query("p14_verdict", "SELECT o_orderkey, 'TAR(rank-1) ' || CASE WHEN r >= 90 THEN 'PASS' ELSE 'below 90%' END || '; feature ' || CASE WHEN b > 0 AND b < 1024 THEN 'PASS <1KB' ELSE 'FAIL >=1KB' END || '; ' || CASE WHEN fps IS NULL THEN 'fps n/a' WHEN fps >= 30 THEN '>=30fps PASS' ELSE '<30fps' END AS verdict FROM (SELECT o_orderkey, o_totalprice / 4000 AS r, o_custkey % 5 * 256 AS b, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 60 END AS fps FROM orders)")
def p14(spark, d):
    runs = T.read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 4000).alias("rank1"), (F.col("o_custkey") % 5 * 256).alias("bytes"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 60).alias("fps"))
    return runs.select("o_orderkey", L.verdict(F.col("rank1"), F.col("bytes"), F.col("fps")).alias("verdict"))


_TAGGED = "t AS (SELECT p_partkey, ['arcface_buffalo_s', 'arcface_buffalo_s_int8', 'arcface_mobilenet_int8', 'lbph', ' Hybrid ', 'other'][p_size % 6 + 1] AS family, CASE WHEN p_partkey % 3 = 0 THEN 'w600k_INT8' ELSE 'w600k' END AS variant FROM part)"


def _tagged(spark, d):
    tags = F.array(*map(F.lit, ("arcface_buffalo_s", "arcface_buffalo_s_int8", "arcface_mobilenet_int8", "lbph", " Hybrid ", "other")))
    return T.read(spark, d, "part").select("p_partkey", F.get(tags, F.col("p_size") % 6).alias("family"), F.when(F.col("p_partkey") % 3 == 0, "w600k_INT8").otherwise("w600k").alias("variant"))


@query("p16_family_alias", f"WITH {_TAGGED}, c AS (SELECT p_partkey, lower(trim(family)) AS f, contains(lower(variant), 'int8') OR lower(trim(family)) LIKE '%\\_int8' ESCAPE '\\' AS quantized FROM t) SELECT p_partkey, f = 'arcface_buffalo_s' AND NOT quantized AS plain, f IN ('arcface_mobilenet_int8', 'arcface_buffalo_s_int8') AND quantized AS small, f = 'hybrid' AS hybrid FROM c")
def p16(spark, d):
    own = lambda m: L.of_model(m, F.col("family"), F.col("variant"))
    return _tagged(spark, d).select("p_partkey", own("ArcFace").alias("plain"), own("ArcFace MobileNet INT8").alias("small"), own("Hybrid").alias("hybrid"))


@query("w10_latest_per_key", f"WITH {_REPORTS} SELECT label, first(id ORDER BY mtime DESC, id) AS id FROM r GROUP BY label")
def w10(spark, d):
    """The newest; of equally new ones the first stays."""
    return reports(spark, d).groupBy("label").agg(F.max_by("id", F.struct("mtime", -F.col("id"))).alias("id"))


@query("w11_sorted_rows", f"WITH {_REPORTS} SELECT id, row_number() OVER (ORDER BY hit_rate DESC NULLS LAST, rank1 DESC NULLS LAST, family DESC NULLS LAST, id) AS place FROM r")
def w11(spark, d):
    """Every row with its place in the order of several keys."""
    keys = (F.col("hit_rate").desc_nulls_last(), F.col("rank1").desc_nulls_last(), F.col("family").desc_nulls_last(), F.col("id"))
    return ranks.numbered(reports(spark, d).select("id", "hit_rate", "rank1", "family"), keys).select("id", F.col("place").cast("long").alias("place"))


@query("w12_unedited_first", f"WITH {_REPORTS} SELECT id, row_number() OVER (ORDER BY family IS NOT NULL, -coalesce(rank1, 0), id) AS place FROM r")
def w12(spark, d):
    """Every row with its place, rows without a family first."""
    keys = (F.col("family").isNotNull(), -F.coalesce("rank1", F.lit(0.0)), F.col("id"))
    return ranks.numbered(reports(spark, d).select("id", "rank1", "family"), keys).select("id", F.col("place").cast("long").alias("place"))


_JSON = "'{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}'"


@query("f14_slug", f"SELECT p_partkey, 'ds_' || sha1({_JSON})[1:12] AS slug FROM part")
def f14(spark, d):
    """Keys of the compact JSON are in order."""
    return T.read(spark, d, "part").select("p_partkey", L.slug(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))), "ds").alias("slug"))


@query("f15_token_clean", "SELECT c_custkey, CASE WHEN t <> '' THEN t ELSE 'default' END AS token FROM (SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(CASE WHEN c_custkey % 7 = 0 THEN ' !? ' ELSE '#' || c_name || ' / ' || c_mktsegment || '!' END, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM customer)")
def f15(spark, d):
    name = F.when(F.col("c_custkey") % 7 == 0, " !? ").otherwise(F.concat(F.lit("#"), "c_name", F.lit(" / "), "c_mktsegment", F.lit("!")))
    return T.read(spark, d, "customer").select("c_custkey", L.clean_token(name).alias("token"))


@query("f16_relative_path", "SELECT p_partkey, replace('reports\\' || p_type || '\\' || p_partkey || '.json', '\\', '/') AS path FROM part")
def f16(spark, d):
    return T.read(spark, d, "part").select("p_partkey", L.relative(F.concat(F.lit("base\\reports\\"), "p_type", F.lit("\\"), F.col("p_partkey").cast("string"), F.lit(".json")), "base").alias("path"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace({}, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    "f17_variant",
    f"WITH x AS (SELECT p_partkey, p_name, list_filter([CASE WHEN p_size % 5 <> 0 THEN p_type || ' v1.' || p_size END, CASE WHEN p_size % 3 = 1 THEN '' WHEN p_size % 3 = 2 THEN 'labels (' || p_brand || ')' END], lambda v: v <> '') AS stems FROM part) SELECT p_partkey, CASE WHEN len(stems) > 0 THEN array_to_string(list_transform(stems, lambda v: {_CLEAN.format('v')}), '__') ELSE {_CLEAN.format("'(' || p_name || ')'")} END AS variant FROM x",
)
def f17(spark, d):
    """The cleaned stems of the model's files, missing ones left out; a fallback where there is none."""
    size = F.col("p_size").cast("string")
    model = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("m/"), "p_type", F.lit(" v1."), size, F.lit(".yml")))
    marks = F.when(F.col("p_size") % 3 == 1, "").when(F.col("p_size") % 3 == 2, F.concat(F.lit("m/labels ("), "p_brand", F.lit(").json")))
    return T.read(spark, d, "part").select("p_partkey", L.model_variant([model, marks], F.concat(F.lit("("), "p_name", F.lit(")"))).alias("variant"))


@query("f18_dataset_label", "WITH x AS (SELECT p_partkey, list_filter(['raw=' || CASE WHEN p_size % 2 = 0 THEN p_brand END, 'processed=' || CASE WHEN p_size % 5 < 2 THEN p_name END, 'aug=' || CASE WHEN p_size % 3 = 0 THEN p_type END || '[' || CASE WHEN p_size % 4 = 0 THEN 'light,medium' ELSE 'all' END || ']', 'split=' || CASE WHEN p_size % 7 = 0 THEN 'test' END], lambda v: v IS NOT NULL) AS parts FROM part) SELECT p_partkey, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' | ') ELSE 'no_dataset_selected' END AS label FROM x")
def f18(spark, d):
    size = F.col("p_size")
    where = lambda c, x: F.when(c, F.col(x))
    label = L.dataset_label(where(size % 2 == 0, "p_brand"), where(size % 5 < 2, "p_name"), where(size % 3 == 0, "p_type"), F.when(size % 4 == 0, " Medium,,light ,light"), F.when(size % 7 == 0, "test"))
    return T.read(spark, d, "part").select("p_partkey", label.alias("label"))


@query("f19_rng_key", None)
def f19(spark, d):
    """Seeds of random modifications: the run's seed and the CRC-32 of person, file, modification and level."""
    return T.read(spark, d, "part").select("p_partkey", L.rng_seed(42, "p_brand", "p_name", "p_type", "p_size").alias("seed"))


_UNITS = "[' B', ' KB', ' MB', ' GB', ' TB']"


@query("f20_formats", f"WITH x AS (SELECT o_orderkey, (o_orderkey * pow(o_custkey, o_orderkey % 5))::DOUBLE AS n, o_custkey * 7 - 30 AS s FROM orders), k AS (SELECT *, least(4, CASE WHEN n < 1024 THEN 0 ELSE floor(log2(n) / 10) END)::INT AS k FROM x) SELECT o_orderkey, printf('%.2f', n / pow(1024, k)) || ({_UNITS})[k + 1] AS size, CASE WHEN s >= 3600 THEN printf('%02d:', s // 3600) ELSE '' END || printf('%02d:%02d', greatest(s, 0) % 3600 // 60, greatest(s, 0) % 60) AS duration FROM k")
def f20(spark, d):
    def power(c: pd.Series, k: pd.Series) -> pd.Series:  # that of C: Java's goes another way where an odd power is halfway between two doubles
        return pd.Series([math.pow(x, y) for x, y in zip(c.tolist(), k.tolist())], dtype="float64")

    n = F.col("o_orderkey") * F.pandas_udf(power, "double")(F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 5).cast("double"))
    return T.read(spark, d, "orders").select("o_orderkey", L.byte_size(n).alias("size"), L.duration(F.col("o_custkey") * 7 - 30).alias("duration"))


@query("f21_ppm_cell", "SELECT p_partkey, CASE WHEN p < 0.1 THEN printf('%.4f', p) || '% (' || printf('%.0f', p * 10000) || ' ppm)' ELSE printf('%.3f', p) || '%' END AS cell FROM (SELECT p_partkey, p_size * p_partkey / 16384.0::DOUBLE AS p FROM part)")
def f21(spark, d):
    return T.read(spark, d, "part").select("p_partkey", L.ppm_cell(F.col("p_size") * F.col("p_partkey") / 16384.0).alias("cell"))


_FILES = "['lbph_evaluation.json', 'LBPH_Trainer_' || p_size || '_eval.json', 'lbph_' || p_size || '_report.json', 'other_' || p_size || '_report_eval.json', 'lbph__.json', 'lbphx.json'][p_partkey % 6 + 1]"


@query("f23_variant_inference", f"WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(lower({_FILES}), '\\.json$', ''), '_(evaluation|eval|report)$', '') AS n FROM part), c AS (SELECT p_partkey, CASE WHEN n = 'lbph' THEN '' WHEN starts_with(n, 'lbph_') THEN trim(n[6:], '_') ELSE n END AS v FROM n) SELECT p_partkey, CASE WHEN v = '' THEN 'default' ELSE v END AS variant FROM c")
def f23(spark, d):
    size = F.col("p_size").cast("string")
    named = lambda *x: F.concat(F.lit("reports/"), *[y if isinstance(y, Column) else F.lit(y) for y in x])
    files = F.array(named("lbph_evaluation.json"), named("LBPH_Trainer_", size, "_eval.json"), named("lbph_", size, "_report.json"), named("other_", size, "_report_eval.json"), named("lbph__.json"), named("lbphx.json"))
    return T.read(spark, d, "part").select("p_partkey", L.report_variant(F.get(files, (F.col("p_partkey") % 6).cast("int")), "LBPH").alias("variant"))


@query("f24_compact_tag", "WITH v AS (SELECT p_partkey, lower(trim(['trainer_lasalle-r' || p_size || '_labels_x', 'enrollment_Processed', 'trainer_raw', 'lfw-', p_type || '__' || p_brand, ' ', 'hybrid-raw-' || p_size || '_'][p_partkey % 7 + 1])) AS v FROM part), a AS (SELECT p_partkey, regexp_replace(regexp_replace(CASE WHEN starts_with(v, 'trainer_') THEN regexp_replace(v, '_labels_.*', '') ELSE v END, '^trainer_', ''), '^enrollment_', '') AS v FROM v), b AS (SELECT p_partkey, trim(regexp_replace(v, '^(processed-|raw-|hybrid-|lasalle-|lfw-)', ''), '_-') AS v FROM a), c AS (SELECT p_partkey, v, trim(regexp_replace(v, '[^a-z0-9]+', '-', 'g'), '-') AS t FROM b) SELECT p_partkey, CASE v WHEN 'processed' THEN 'p' WHEN 'raw' THEN 'r' ELSE CASE WHEN t = '' THEN 'default' ELSE t END END AS tag FROM c")
def f24(spark, d):
    size = F.col("p_size").cast("string")
    names = F.array(F.concat(F.lit("trainer_lasalle-r"), size, F.lit("_labels_x")), F.lit("enrollment_Processed"), F.lit("trainer_raw"), F.lit("lfw-"), F.concat("p_type", F.lit("__"), "p_brand"), F.lit(" "), F.concat(F.lit("hybrid-raw-"), size, F.lit("_")))
    return T.read(spark, d, "part").select("p_partkey", L.compact_tag(F.get(names, (F.col("p_partkey") % 7).cast("int"))).alias("tag"))


_COMBOS = "x AS (SELECT p_partkey, ['lasalle_db1', 'camera', '__disabled__', 'split_lasalle/train'][p_size % 4 + 1] AS raw, ['lfw_funneled', 'faces'][p_size % 2 + 1] AS proc, ['light, Medium', 'medium', '__disabled__'][p_size % 3 + 1] AS aug, p_partkey % 2 = 0 AS with_raw, p_partkey % 3 = 0 AS with_proc, p_partkey % 5 > 1 AS with_aug FROM part)"


@query("f25_combo_slug", f"WITH {_COMBOS}, y AS (SELECT * REPLACE (with_raw AND raw <> '__disabled__' AS with_raw, with_aug AND aug <> '__disabled__' AS with_aug) FROM x), f AS (SELECT *, CASE WHEN raw LIKE 'split%' THEN 'lasalleclean' WHEN with_raw AND raw LIKE 'lasalle%' THEN 'lasalle' WHEN with_proc AND proc LIKE 'lfw%' THEN 'lfw' WHEN with_raw AND with_proc THEN 'hybrid' WHEN with_raw THEN 'raw' WHEN with_proc THEN 'processed' ELSE 'dataset' END AS f FROM y), l AS (SELECT p_partkey, f, CASE WHEN with_raw AND f IN ('lfw', 'raw') THEN 'r' ELSE '' END || CASE WHEN with_proc AND f IN ('lasalleclean', 'lasalle', 'processed') THEN 'p' ELSE '' END || CASE WHEN with_aug AND aug LIKE 'light%' THEN 'lm' WHEN with_aug THEN 'm' ELSE '' END AS l FROM f) SELECT p_partkey, f || CASE WHEN l = '' THEN '' ELSE '-' || l END AS slug FROM l")
def f25(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    one = lambda *x: F.get(F.array(*map(F.lit, x)), (size % len(x)).cast("int"))
    raw, processed, splits = one("lasalle_db1", "camera", L.DISABLED, "split_lasalle/train"), one("lfw_funneled", "faces"), one("light, Medium", "medium", L.DISABLED)
    return T.read(spark, d, "part").select("p_partkey", L.combo_slug(raw, processed, splits, F.lit("data"), key % 2 == 0, key % 3 == 0, key % 5 > 1).alias("slug"))


@query("f26_csv_list", "SELECT c_custkey, list_filter(list_transform(string_split(' ' || c_mktsegment || ', ,' || c_name || ' ,', ','), lambda x: lower(trim(x))), lambda x: x <> '') AS items FROM customer")
def f26(spark, d):
    return T.read(spark, d, "customer").select("c_custkey", L.csv_list(F.concat(F.lit(" "), "c_mktsegment", F.lit(", ,"), "c_name", F.lit(" ,"))).alias("items"))


@query("k1_pair_rows", f"WITH {T.SMALL} SELECT doc_id, printf('%.6f', d / 7) AS raw_distance, printf('%.4f', d / 7) AS short FROM s")
def k1(spark, d):
    return T.scores_small(spark, d).select("doc_id", sinks.fixed(F.col("d") / 7, 6).alias("raw_distance"), sinks.fixed(F.col("d") / 7, 4).alias("short"))


@query("k4_summary_json", f"WITH {T.LARGE} SELECT bucket, '{{\"bucket\":\"' || bucket || '\",\"comparisons\":' || count(*) || ',\"hits\":' || count(*) FILTER (WHERE ok) || '}}' AS json FROM s GROUP BY bucket")
def k4(spark, d):
    g = T.scores_large(spark, d).groupBy("bucket").agg(F.count("*").alias("comparisons"), F.count_if("ok").alias("hits"))
    return g.select("bucket", F.to_json(F.struct("bucket", "comparisons", "hits")).alias("json"))


@query("k6_markdown_rows", f"WITH {T.LARGE}, g AS (SELECT bucket, count(*) AS n, avg(d) AS m FROM s GROUP BY bucket) SELECT '| ' || bucket || ' | ' || n || ' | ' || printf('%.2f', m) || ' |' AS line FROM g")
def k6(spark, d):
    g = T.scores_large(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("d").alias("m"))
    return g.select(sinks.markdown_row("bucket", F.col("n").cast("string"), sinks.fixed(F.col("m"), 2)).alias("line"))


@query("q9_spec_comparison", f"WITH {_REPORTS}, {_FPS}, l AS (SELECT family, first(id ORDER BY mtime DESC, id DESC) AS id, first(rank1 ORDER BY mtime DESC, id DESC) AS rank1 FROM r WHERE rank1 IS NOT NULL AND family IS NOT NULL GROUP BY family), m AS (SELECT family, round(avg(value), 6) AS fps FROM fps WHERE family IS NOT NULL GROUP BY family), j AS (SELECT l.family, l.id, l.rank1, m.fps, CASE l.family WHEN 'alpha' THEN 65536 WHEN 'beta' THEN 960 ELSE 108 END AS b FROM l LEFT JOIN m ON l.family = m.family) SELECT *, 'TAR(rank-1) ' || CASE WHEN 100 * rank1 >= 90 THEN 'PASS' ELSE 'below 90%' END || CASE WHEN b < 1024 THEN '; feature PASS <1KB' ELSE '; feature FAIL >=1KB' END || CASE WHEN fps IS NULL THEN '; fps n/a' WHEN fps >= 30 THEN '; >=30fps PASS' ELSE '; <30fps' END AS verdict, row_number() OVER (ORDER BY rank1 DESC, family) AS place FROM j")
def q9(spark, d):
    """The newest run of each family with its speed, its feature's size and the verdict, best first."""
    newest = reports(spark, d).where("rank1 is not null and family is not null").groupBy("family").agg(F.max(F.struct("mtime", "id", "rank1")).alias("x"))
    m = fps_runs(spark, d).where("family is not null").groupBy("family").agg(F.round(F.avg("value"), 6).alias("fps"))
    j = newest.select("family", "x.id", "x.rank1").join(m, "family", "left")
    j = j.withColumn("b", F.when(F.col("family") == "alpha", 65536).when(F.col("family") == "beta", 960).otherwise(108))
    # one row a family, so the window is small
    return j.withColumn("verdict", L.verdict(100 * F.col("rank1"), F.col("b"), F.col("fps"))).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank1"), "family")).cast("long"))
