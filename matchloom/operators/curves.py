"""Error rates over thresholds. Scores are aggregated by distinct value first; running sums over those are made bucket by
bucket (ranks.running)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import ranks


def by_score(scores: DataFrame, kind: str, d: str, ok: str, by: list[str] | None = None) -> DataFrame:
    """by.., d, imp, gen, hits: impostors, genuines and genuines that are right, at each distinct distance."""
    impostor, genuine = F.col(kind) == "impostor", F.col(kind) == "genuine"
    return scores.groupBy(*(by or []), F.col(d).alias("d")).agg(F.count_if(impostor).alias("imp"), F.count_if(genuine).alias("gen"), F.count_if(genuine & F.col(ok)).alias("hits"))


def roc(scores: DataFrame, kind: str = "kind", d: str = "d", ok: str = "ok", by: list[str] | None = None) -> DataFrame:
    """by.., t, far, tar, frr in percent at each distinct distance; a rate over nothing is 0."""
    by = by or []
    base = by_score(scores, kind, d, ok, by)
    totals = F.broadcast(base.groupBy(*by).agg(F.sum("imp").alias("n_imp"), F.sum("gen").alias("n_gen")))
    rates = ranks.running(base, "d", {"ci": "imp", "ch": "hits"}, by).select(*by, "d", "ci", "ch")
    rates = rates.join(totals, by) if by else rates.crossJoin(totals)
    far = F.when(F.col("n_imp") > 0, 100.0 * F.col("ci") / F.col("n_imp")).otherwise(0.0)
    tar = F.when(F.col("n_gen") > 0, 100.0 * F.col("ch") / F.col("n_gen")).otherwise(0.0)
    return rates.select(*by, F.col("d").alias("t"), far.alias("far"), tar.alias("tar"), (100.0 - tar).alias("frr"))


def eer(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first threshold at which FAR and FRR are nearest, and half their sum."""
    by = by or []
    x = curve.groupBy(*by).agg(F.min(F.struct(F.round(F.abs(F.col("far") - F.col("frr")), 9).alias("gap"), "t", "far", "frr")).alias("m"))
    return x.where("m is not null").select(*by, F.col("m.t").alias("t"), ((F.col("m.far") + F.col("m.frr")) / 2).alias("eer"))
