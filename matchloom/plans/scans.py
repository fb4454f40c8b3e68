"""Scans S1-S13, S15-S18, S21, S22, S24 on file paths and report rows made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.plans import tables as T
from matchloom.plans.registry import query
from matchloom.sources import images, sinks
from matchloom.sources import reports as files
from matchloom.sources.shared import shared_dir, written

_PATHS = """f AS (SELECT p_partkey, 'data/' || CASE WHEN p_partkey % 3 = 0 THEN 'raw' WHEN p_partkey % 3 = 1 THEN 'processed' ELSE 'augmented/light/' || CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'test' END END || '/id_' || lpad((p_size % 20)::VARCHAR, 2, '0') || '/' || CASE WHEN p_partkey % 4 = 0 THEN 'dark_' ELSE 'light_' END || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.txt' WHEN 4 THEN '.webp' ELSE '.bmp' END AS path FROM part),
i AS (SELECT p_partkey, path, CASE WHEN path LIKE '%/augmented/%' THEN regexp_extract(path, '(augmented/[^/]+/(train|test))', 1) ELSE regexp_extract(path, 'data/([^/]+)/', 1) END AS bucket, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS person FROM f WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|bmp|webp)$'))"""


def paths(spark, d):
    k = F.col("p_partkey")
    split = F.when(k % 3 == 0, "raw").when(k % 3 == 1, "processed").otherwise(F.concat(F.lit("augmented/light/"), F.when(k % 2 == 0, "train").otherwise("test")))
    ending = F.element_at(F.array(*map(F.lit, (".PNG", ".jpg", ".jpeg", ".txt", ".webp", ".bmp"))), (k % 6).cast("int") + 1)
    path = F.concat(F.lit("data/"), split, F.lit("/id_"), F.lpad((F.col("p_size") % 20).cast("string"), 2, "0"), F.lit("/"), F.when(k % 4 == 0, "dark_").otherwise("light_"), k.cast("string"), ending)
    return T.read(spark, d, "part").select("p_partkey", path.alias("path"))


def listed(spark, d):
    return images.entries(paths(spark, d))


@query("s1_image_tree", f"WITH {_PATHS} SELECT bucket, person, count(*) AS files FROM i GROUP BY bucket, person")
def s1(spark, d):
    return listed(spark, d).groupBy("bucket", "person").agg(F.count("*").alias("files"))


@query("s2_union_scan", f"WITH {_PATHS} SELECT p_partkey, bucket FROM i WHERE bucket = 'raw' OR bucket LIKE 'augmented/%'")
def s2(spark, d):
    return images.by_sources(listed(spark, d), raw=True, processed=False, augmented=True).select("p_partkey", "bucket")


@query("s3_extension_filter", f"WITH {_PATHS} SELECT p_partkey, path FROM i")
def s3(spark, d):
    return listed(spark, d).select("p_partkey", "path")


@query("s4_augmented_nested", f"WITH {_PATHS} SELECT p_partkey, person FROM i WHERE bucket LIKE 'augmented/%/test'")
def s4(spark, d):
    """The target split if it is there, else all nested splits, else the flat layout."""
    return images.augmented(listed(spark, d), "test").select("p_partkey", "person")


@query("s5_split_inference", f"WITH {_PATHS}, b AS (SELECT p_partkey, regexp_extract(bucket, '([^/]+)$', 1) AS base FROM i) SELECT p_partkey, CASE WHEN base IN ('train', 'test') THEN base END AS split FROM b")
def s5(spark, d):
    return listed(spark, d).select("p_partkey", images.split_of(F.col("bucket")).alias("split"))


_KEY = "md5('42:' || bucket || ':' || person || ':' || path)"


@query("s6_seeded_cap", f"WITH {_PATHS} SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY {_KEY}) AS rn FROM i) WHERE rn <= 5")
def s6(spark, d):
    return images.seeded_cap(listed(spark, d), 5, ["person"], 42).select("p_partkey")


@query("s7_cap_grain", f"WITH {_PATHS} SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY bucket, person ORDER BY {_KEY}) AS rn FROM i) WHERE rn <= 2")
def s7(spark, d):
    return images.seeded_cap(listed(spark, d), 2, ["bucket", "person"], 42).select("p_partkey")


@query("s8_first_n", f"WITH {_PATHS} SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY bucket, person ORDER BY path) AS rn FROM i) WHERE rn <= 3")
def s8(spark, d):
    w = Window.partitionBy("bucket", "person").orderBy("path")
    return listed(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_partkey")


@query("s9_one_per_identity", f"WITH {_PATHS} SELECT person, first(path ORDER BY {_KEY}) AS path FROM i GROUP BY person")
def s9(spark, d):
    return images.seeded_cap(listed(spark, d), 1, ["person"], 42).select("person", "path")


@query("s10_probe_and_training", f"WITH {_PATHS} SELECT person, path, rn = 1 AS probe FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY {_KEY}) AS rn FROM i) WHERE rn <= 4")
def s10(spark, d):
    w = Window.partitionBy("person").orderBy(images.seeded(42))
    return listed(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("person", "path", (F.col("rn") == 1).alias("probe"))


@query("s11_named_or_first", f"WITH {_PATHS} SELECT person, coalesce(min(path) FILTER (WHERE path LIKE '%/dark_%'), min(path)) AS path FROM i GROUP BY person")
def s11(spark, d):
    """The image by name, here the first dark one, else the first."""
    return listed(spark, d).groupBy("person").agg(F.coalesce(F.min(F.when(F.contains("path", F.lit("/dark_")), F.col("path"))), F.min("path")).alias("path"))


@query("s12_probe_and_extras", f"WITH {_PATHS} SELECT person, list(path ORDER BY path)[1] AS probe, list(path ORDER BY path)[2:6] AS extras FROM i GROUP BY person")
def s12(spark, d):
    w = Window.partitionBy("person").orderBy("path")
    r = listed(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 6")
    return r.groupBy("person").agg(F.min("path").alias("probe"), F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.col("path")))).alias("extras"))


@query("s13_global_sample", f"WITH {_PATHS} SELECT path FROM i ORDER BY {_KEY} LIMIT 40")
def s13(spark, d):
    return listed(spark, d).orderBy(images.seeded(42)).limit(40).select("path")


_REPORTS = "r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' END AS family, o_orderpriority AS label, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 700003, 6) END AS rank1, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 600011, 6) END AS hit_rate, o_orderdate AS mtime FROM orders)"


def reports(spark, d):
    k = F.col("o_orderkey")
    return T.read(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, "alpha").when(k % 4 == 1, "beta").when(k % 4 == 2, "gamma").alias("family"), F.col("o_orderpriority").alias("label"), F.when(k % 7 != 0, F.round(F.col("o_totalprice") / 700003, 6)).alias("rank1"), F.when(k % 3 == 0, F.round(F.col("o_totalprice") / 600011, 6)).alias("hit_rate"), F.col("o_orderdate").alias("mtime"))


@query("s15_json_reports", "SELECT event_id, json_extract_string(props, '$.' || k[1]) AS first_value, len(k) AS n_keys FROM (SELECT *, json_keys(props) AS k FROM events)")
def s15(spark, d):
    """JSON texts read tolerantly: what does not parse is null and skipped by callers."""
    e = T.read(spark, d, "events").withColumn("k", F.json_object_keys("props")).withColumn("m", F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"}))
    return e.select("event_id", F.element_at("m", F.col("k")[0]).alias("first_value"), F.size("k").cast("long").alias("n_keys"))


@query("s16_schema_guard", f"WITH {_REPORTS} SELECT id FROM r WHERE rank1 IS NOT NULL AND family IN ('alpha', 'beta') AND contains(label, 'URGENT')")
def s16(spark, d):
    return reports(spark, d).where(F.col("rank1").isNotNull() & F.col("family").isin("alpha", "beta") & F.contains("label", F.lit("URGENT"))).select("id")


@query("s17_enrollment_export", f"WITH {T.GALLERY} SELECT person, sample_count, round(centroid[1], 6) AS first FROM gallery")
def s17(spark, d):
    """Enrolment packed as one map per shard of names, written as JSON, parsed and taken apart again."""
    g = T.gallery(spark, d).withColumn("shard", F.pmod(F.xxhash64("person"), F.lit(8)))
    packed = g.groupBy("shard").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("person", F.struct("sample_count", "centroid"))))).alias("people"))
    back = packed.select(F.explode(F.from_json("people", "map<string, struct<sample_count: long, centroid: array<double>>>")).alias("person", "x"))
    return back.select("person", "x.sample_count", F.round(F.col("x.centroid")[0], 6).alias("first"))


@query("s18_label_map", "SELECT n_name AS name, n_nationkey AS id FROM nation")
def s18(spark, d):
    n = T.read(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return n.select(F.explode("m").alias("name", "id"))


@query("s21_csv_distances", f"WITH {T.SMALL} SELECT doc_id, printf('%.6f', d / 1000) AS distance_normalized, round(d / 1000, 6) AS back FROM s")
def s21(spark, d):
    """Six decimals to text and back under a fixed schema."""
    t = T.scores_small(spark, d).select("doc_id", F.format_string("%.6f", F.col("d") / 1000).alias("distance_normalized"))
    return t.select("doc_id", "distance_normalized", F.from_csv("distance_normalized", "x double")["x"].alias("back"))


@query("s22_run_summaries", "SELECT user_id AS run_id, count(*) AS frames, round(avg(value), 6) AS average_fps FROM events GROUP BY user_id")
def s22(spark, d):
    return T.read(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("frames"), F.round(F.avg("value"), 6).alias("average_fps"))


@query("s24_fallback_chain", f"WITH {_REPORTS}, a AS (SELECT family, max(hit_rate) AS v FROM r WHERE label = '1-URGENT' AND family <> 'beta' GROUP BY family), b AS (SELECT family, round(avg(rank1), 6) AS v FROM r GROUP BY family) SELECT b.family, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'aggregate' ELSE 'runs' END AS origin FROM b LEFT JOIN a ON a.family = b.family WHERE b.family IS NOT NULL")
def s24(spark, d):
    r = reports(spark, d).where("family is not null")
    a = r.where("label = '1-URGENT' and family <> 'beta'").groupBy("family").agg(F.max("hit_rate").alias("a"))
    b = r.groupBy("family").agg(F.round(F.avg("rank1"), 6).alias("b"))
    return b.join(a, "family", "left").select("family", F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "aggregate").otherwise("runs").alias("origin"))


_UNITS = "u AS (SELECT o_orderpriority || '::' || year(o_orderdate) AS entity, year(o_orderdate) AS y, CASE WHEN substring(o_orderpriority, 1, 1)::INT > 2 THEN 'alpha' ELSE 'beta' END AS family, count(*) AS evaluated, round(avg(o_totalprice), 4) AS first_rate, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS second_rate FROM orders GROUP BY ALL)"


def landed_reports(spark, d) -> str:
    """A folder of report files on orders by priority and year: one each, a newer one for even years, one cut off in the middle for every third
    year, and one without a family."""
    o = T.read(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    u = o.groupBy(F.concat_ws("::", "o_orderpriority", "y").alias("entity"), "y", F.when(F.substring("o_orderpriority", 1, 1).cast("int") > 2, "alpha").otherwise("beta").alias("family"))
    u = u.agg(F.count("*").alias("evaluated"), F.round(F.avg("o_totalprice"), 4).alias("first_rate"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 4).alias("second_rate"))
    u = written(u.withColumn("unit", F.xxhash64("entity").cast("string")))
    at = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    text = lambda rate, family="family": F.to_json(F.struct(F.col("entity").alias("entity_key"), F.col(family).alias("model_family"), F.struct(F.col(rate).alias("hit_rate"), "evaluated").alias("overall")), {"pretty": "true"})
    files.write_documents(u, at, "unit", text("first_rate"))
    files.write_documents(u.where("y % 2 = 0"), at, "unit", text("second_rate"))
    files.write_documents(u.where("y % 3 = 0"), at, "unit", F.substring(text("first_rate"), 1, 60))
    files.write_documents(u.where("y % 5 = 0").withColumn("none", F.lit("")), at, "unit", text("first_rate", "none"))
    return at


@query("s15_report_files", f"WITH {_UNITS} SELECT entity AS entity_key, family AS model_family, CASE WHEN y % 2 = 0 THEN second_rate ELSE first_rate END AS hit_rate, evaluated, 1 + (y % 2 = 0)::BIGINT AS runs FROM u")
def s15_files(spark, d):
    """Report files read back: broken ones and ones without a family skipped, the newest by the time of its file, and how many there are."""
    found = files.usable(files.scan(spark, landed_reports(spark, d), "entity_key string, model_family string, overall struct<hit_rate: double, evaluated: long>"), "model_family")
    return files.latest(found, "entity_key").select("entity_key", "model_family", "overall.hit_rate", "overall.evaluated", "runs")


@query("s21_csv_files", f"WITH {T.SMALL} SELECT doc_id, printf('%.6f', d / 1000)::DOUBLE AS distance_normalized FROM s")
def s21_files(spark, d):
    """Distances written to CSV files with a header and read back under a schema."""
    at = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    sinks.pairs_csv(T.scores_small(spark, d).select("doc_id", (F.col("d") / 1000).alias("distance_normalized")), at)
    return sinks.read_csv(spark, at, "doc_id long, distance_normalized double")


@query("s22_run_files", "WITH r AS (SELECT user_id, event_type AS algorithm, count(*) AS frames, round(sum(value), 4) AS duration_seconds FROM events GROUP BY ALL) SELECT algorithm, count(*) AS runs, sum(frames)::BIGINT AS frames, round(sum(duration_seconds), 2) AS duration_seconds, round(sum(frames) / sum(duration_seconds), 6) AS weighted_fps FROM r GROUP BY algorithm")
def s22_files(spark, d):
    """A summary of each run written as JSON, read back and added up by algorithm: frames over duration, not a mean of rates."""
    at = f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}"
    runs = T.read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("algorithm")).agg(F.count("*").alias("frames"), F.round(F.sum("value"), 4).alias("duration_seconds"))
    sinks.report_json(runs, at)
    back = files.usable(spark.read.schema(f"algorithm string, frames long, duration_seconds double, {files.BROKEN} string").json(at), "algorithm")
    frames, seconds = F.sum("frames"), F.sum("duration_seconds")
    return back.groupBy("algorithm").agg(F.count("*").alias("runs"), frames.alias("frames"), F.round(seconds, 2).alias("duration_seconds"), F.round(frames / seconds, 6).alias("weighted_fps"))
