"""Sinks K2, K3, K5, K8-K11, K13 and the model source S19: each query writes what it is about and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.functions import grids as G
from matchloom.functions import vectors as V
from matchloom.kernels import faces
from matchloom.operators import ranks
from matchloom.operators import tiles as pair_tiles
from matchloom.plans import tables as T
from matchloom.plans.kernels import tiles
from matchloom.plans.registry import query
from matchloom.plans.scans import _REPORTS, reports
from matchloom.sources import sinks
from matchloom.sources.shared import shared_dir


def _place(spark) -> str:
    return f"{shared_dir(spark)}/outputs/{uuid.uuid4().hex}"


@query("k2_sweep_csv", f"WITH {T.LARGE}, w AS (SELECT t, count(*) FILTER (WHERE d <= t) AS hits, count(*) AS n FROM s, unnest([10000.0, 20000.0, 40000.0, 80000.0]::DOUBLE[]) AS u(t) GROUP BY t) SELECT printf('%.6f', t) AS threshold, hits::VARCHAR AS hits, printf('%.4f', 100.0::DOUBLE * hits / n) AS percent FROM w")
def k2(spark, d):
    """A sweep as CSV text: thresholds with six decimals, rates with four."""
    s = T.scores_large(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, (10000.0, 20000.0, 40000.0, 80000.0)))))
    w = s.groupBy("t").agg(F.count_if(F.col("d") <= F.col("t")).alias("hits"), F.count("*").alias("n"))
    at = _place(spark)
    sinks.pairs_csv(w.select(sinks.fixed(F.col("t"), 6).alias("threshold"), "hits", sinks.fixed(100.0 * F.col("hits") / F.col("n"), 4).alias("percent")), at)
    return sinks.read_csv(spark, at, "threshold string, hits string, percent string")


@query("k3_lowest_pairs_csv", f"WITH {T.FEAT}, up AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM feat a JOIN feat b ON a.vec_id < b.vec_id) SELECT query, candidate, printf('%.6f', d) AS d FROM up ORDER BY up.d, query, candidate LIMIT 20")
def k3(spark, d):
    """The twenty closest pairs as CSV text."""
    at = _place(spark)
    sinks.pairs_csv(pair_tiles.lowest(T.feat(spark, d), "vec_id", "v", 20).orderBy("d", "query", "candidate"), at)
    return sinks.read_csv(spark, at, "query long, candidate long, d string")


@query("k5_report_json", f"WITH {_REPORTS} SELECT family, label, count(*) AS runs, round(max(rank1), 6) AS best FROM r WHERE family IS NOT NULL GROUP BY family, label")
def k5(spark, d):
    """Reports as nested JSON: a family with its overall figures and its labels."""
    g = reports(spark, d).where("family is not null").groupBy("family", "label").agg(F.count("*").alias("runs"), F.round(F.max("rank1"), 6).alias("best"))
    nested = g.groupBy("family").agg(F.struct(F.sum("runs").alias("runs"), F.max("best").alias("best")).alias("overall"), F.array_sort(F.collect_list(F.struct("label", "runs", "best"))).alias("by_label"))
    at = _place(spark)
    sinks.report_json(nested, at)
    back = spark.read.schema("family string, overall struct<runs: long, best: double>, by_label array<struct<label: string, runs: long, best: double>>").json(at)
    return back.select("family", F.explode("by_label").alias("x")).select("family", "x.*")


@query("k8_model_and_labels", f"WITH {T.GALLERY}, g AS (SELECT *, row_number() OVER (ORDER BY person) - 1 AS label FROM gallery) SELECT label, person, sample_count, round(centroid[1], 6) AS first FROM g")
def k8(spark, d):
    """S19, too: a model and its label map are two tables, saved, loaded and joined again."""
    g = T.gallery(spark, d)
    labels = ranks.numbered(g.select("person"), ["person"], "label").withColumn("label", F.col("label") - 1)  # a label for each enrolled identity
    at = _place(spark)
    sinks.model(g, f"{at}/model")
    sinks.model(labels, f"{at}/labels")
    return spark.read.parquet(f"{at}/labels").join(spark.read.parquet(f"{at}/model"), "person").select("label", "person", "sample_count", F.round(F.col("centroid")[0], 6).alias("first"))


@query("k9_enrollment_json", f"WITH {T.GALLERY} SELECT person, sample_count, len(centroid) AS dim, round({T.norm_sql('centroid')}, 6) AS length, 0.2 AS threshold FROM gallery")
def k9(spark, d):
    """Enrolment as JSON, a line for each identity: samples, centroid and the threshold it was calibrated for."""
    at = _place(spark)
    sinks.report_json(T.gallery(spark, d).withColumn("threshold", F.lit(0.2)), at)
    back = spark.read.schema("person string, sample_count long, centroid array<double>, threshold double").json(at)
    return back.select("person", "sample_count", F.size("centroid").cast("long").alias("dim"), F.round(V.norm(F.col("centroid")), 6).alias("length"), "threshold")


@query("k10_gallery_and_labels", f"WITH {T.FEAT} SELECT vec_id, person, round(v[64], 6) AS last FROM feat WHERE known AND NOT probe")
def k10(spark, d):
    """All templates and their labels, row by row."""
    at = _place(spark)
    sinks.model(T.members(spark, d).select("vec_id", "v"), f"{at}/vectors")
    sinks.model(T.members(spark, d).select("vec_id", "person"), f"{at}/labels")
    return spark.read.parquet(f"{at}/vectors").join(spark.read.parquet(f"{at}/labels"), "vec_id").select("vec_id", "person", F.round(F.col("v")[63], 6).alias("last"))


@query("k11_resumed_units", f"WITH {_REPORTS} SELECT family, label, count(*) AS n, CASE WHEN label < '3' THEN 'first' ELSE 'second' END AS run FROM r WHERE family IS NOT NULL GROUP BY family, label")
def k11(spark, d):
    """Units of work, of which a first run does some; a second one does what is missing and leaves the rest alone."""
    units, schema, at = reports(spark, d).where("family is not null"), "n long, run string, family string, label string", _place(spark)
    work = lambda name: lambda u: u.groupBy("family", "label").agg(F.count("*").alias("n")).withColumn("run", F.lit(name))
    sinks.write_units(work("first")(units.where("label < '3'")), at, ["family", "label"])
    return sinks.resumed(units, at, ["family", "label"], schema, work("second"))


@query("k13_augmented_write", f"WITH {T.FEAT} SELECT 'img/' || vec_id || '.png' AS path, CASE WHEN vec_id % 2 = 0 THEN 'first' ELSE 'second' END AS run, 64 AS pixels FROM feat")
def k13(spark, d):
    """Variants of images as rows of a table; a second run makes only those that are missing."""
    t, at = tiles(spark, d).select("vec_id", F.concat(F.lit("img/"), "vec_id", F.lit(".png")).alias("path"), "tile"), _place(spark)
    none = spark.createDataFrame([], "path string")
    faces.augment_missing(t.where("vec_id % 2 = 0"), none, "light").withColumn("run", F.lit("first")).write.parquet(at)
    done = spark.read.parquet(at)
    faces.augment_missing(t, done, "light").withColumn("run", F.lit("second")).write.mode("append").parquet(at)
    return spark.read.parquet(at).where(G.mean(F.col("tile")).between(0, 255)).select("path", "run", F.size("tile").alias("pixels"))
