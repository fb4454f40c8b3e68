"""The tables as the matching queries see them, and the same in SQL.

Identities are labels of embeddings: below 8 enrolled, others impostors. Every fifth vector is a probe. Scores come
from documents with labels (small) or lineitem (large), frames from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import matching as M


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person(label):
    return F.format_string("id_%02d", label)


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, person, v, bucket, w, known, probe."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label", person(F.col("label")).alias("person"), V.doubles(F.col("embedding")).alias("v"), F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("bucket"),
        F.when(F.col("vec_id") % 3 == 0, 1.5).otherwise(1.0).alias("w"), (F.col("label") < 8).alias("known"), (F.col("vec_id") % 5 == 0).alias("probe"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat(spark, sf_dir).where("probe")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that are enrolled."""
    return feat(spark, sf_dir).where("not probe and known")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.enroll(members(spark, sf_dir), "person", weight=F.col("w"))


def scores_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("d"), F.when(F.col("quality") == 1, "genuine").otherwise("impostor").alias("kind"), (F.col("toxic") == 0).alias("ok"))


def scores_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("d"), F.when(F.col("l_linestatus") == "O", "genuine").otherwise("impostor").alias("kind"), (F.col("l_returnflag") != "A").alias("ok"), F.col("l_returnflag").alias("bucket"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe with its best identity: vec_id, bucket, person, known, best_person, score."""
    enrolled = gallery(spark, sf_dir).withColumnRenamed("person", "other")
    return M.arg_max(probes(spark, sf_dir), enrolled, ["vec_id", "bucket", "person", "known"], person="other")


FEAT = """feat AS (SELECT vec_id, label, printf('id_%02d', label) AS person, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'b' || (vec_id % 3) AS bucket,
  CASE WHEN vec_id % 3 = 0 THEN 1.5 ELSE 1.0 END AS w, label < 8 AS known, vec_id % 5 = 0 AS probe FROM embeddings)"""


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def norm_sql(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


GALLERY = (
    FEAT
    + f""", parts AS (SELECT person, u.i AS pos, sum(w * v[u.i]) / sum(w) AS m, count(*) AS n FROM feat, unnest(range(1, 65)) AS u(i) WHERE NOT probe AND known GROUP BY 1, 2),
means AS (SELECT person, max(n) AS sample_count, list(m ORDER BY pos) AS c FROM parts GROUP BY 1),
gallery AS (SELECT person, sample_count, CASE WHEN {norm_sql("c")} > 1e-12 THEN list_transform(c, lambda x: x / {norm_sql("c")}) ELSE c END AS centroid FROM means)"""
)
MATCHES = (
    GALLERY
    + f""", scored AS (SELECT p.vec_id, p.bucket, p.person, p.known, g.person AS other, {dot_sql("p.v", "g.centroid")} AS score FROM feat p, gallery g WHERE p.probe),
matches AS (SELECT vec_id, bucket, person, known, other AS best_person, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rn FROM scored) WHERE rn = 1)"""
)
SMALL = "s AS (SELECT doc_id, n_chars::DOUBLE AS d, CASE WHEN quality = 1 THEN 'genuine' ELSE 'impostor' END AS kind, toxic = 0 AS ok FROM documents JOIN labels USING (doc_id))"
LARGE = "s AS (SELECT l_extendedprice AS d, CASE WHEN l_linestatus = 'O' THEN 'genuine' ELSE 'impostor' END AS kind, l_returnflag <> 'A' AS ok, l_returnflag AS bucket FROM lineitem)"
ROC = """, base AS (SELECT d, count(*) FILTER (WHERE kind = 'impostor') AS imp, count(*) FILTER (WHERE kind = 'genuine' AND ok) AS hits FROM s GROUP BY d),
n AS (SELECT count(*) FILTER (WHERE kind = 'impostor') AS n_imp, count(*) FILTER (WHERE kind = 'genuine') AS n_gen FROM s),
roc AS (SELECT d AS t, CASE WHEN n_imp > 0 THEN 100.0::DOUBLE * ci / n_imp ELSE 0 END AS far, CASE WHEN n_gen > 0 THEN 100.0::DOUBLE * ch / n_gen ELSE 0 END AS tar
  FROM (SELECT d, sum(imp) OVER (ORDER BY d) AS ci, sum(hits) OVER (ORDER BY d) AS ch FROM base), n)"""
