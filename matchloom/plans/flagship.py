"""Slice 0: enrolment, matching, open-set decisions and per-bucket counters with an overall row."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import matching as M
from matchloom.plans import tables as T
from matchloom.plans.registry import query

_THRESHOLD = 0.2


@query(
    "slice0",
    f"""WITH {T.MATCHES}, e AS (SELECT bucket, known, CASE WHEN score >= {_THRESHOLD} THEN best_person ELSE 'Unknown' END AS predicted, person, best_person FROM matches),
o AS (SELECT *, CASE WHEN known THEN predicted = person ELSE predicted = 'Unknown' END AS ok FROM e)
SELECT coalesce(bucket, 'overall') AS bucket, count(*) AS evaluated, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE known) AS known_total, count(*) FILTER (WHERE known AND ok) AS known_correct,
  count(*) FILTER (WHERE NOT known) AS unknown_total, count(*) FILTER (WHERE NOT known AND ok) AS unknown_correct, round(count(*) FILTER (WHERE known AND best_person = person)::DOUBLE / nullif(count(*) FILTER (WHERE known), 0), 6) AS rank1
FROM o GROUP BY GROUPING SETS ((bucket), ())""",
)
def slice0(spark, d):
    e = T.matches(spark, d).withColumn("predicted", M.accepted_by_cosine(F.col("best_person"), F.col("score"), _THRESHOLD))
    e = e.withColumn("ok", M.correct(F.col("person"), F.col("predicted"), F.col("known")))
    known, ok = F.col("known"), F.col("ok")
    out = e.rollup("bucket").agg(
        F.count("*").alias("evaluated"), F.count_if(ok).alias("correct"), F.count_if(known).alias("known_total"), F.count_if(known & ok).alias("known_correct"), F.count_if(~known).alias("unknown_total"),
        F.count_if(~known & ok).alias("unknown_correct"), F.round(F.count_if(known & (F.col("best_person") == F.col("person"))) / F.nullif(F.count_if(known), F.lit(0)), 6).alias("rank1"),
    )
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("overall")))
