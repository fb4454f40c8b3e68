"""Enrolment and matching: centroids, nearest identities, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import pairs

UNKNOWN = "Unknown"
#: Intervals of a cell of a range join, about.
PER_CELL = 8


def mean_vector(df: DataFrame, group: str, v: str = "v", weight: Column | None = None) -> DataFrame:
    """group, sample_count, centroid: (weighted) mean by component. Partial sums are made before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    each = df.select(group, w.alias("w"), F.posexplode(v).alias("pos", "x"))
    sums = each.groupBy(group, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.count("*").alias("sample_count"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return sums.groupBy(group).agg(F.max("sample_count").alias("sample_count"), packed.alias("centroid"))


def enroll(df: DataFrame, group: str, v: str = "v", weight: Column | None = None) -> DataFrame:
    """Weighted centroids of length one."""
    return mean_vector(df, group, v, weight).withColumn("centroid", V.unit(F.col("centroid")))


def arg_max(probes: DataFrame, gallery: DataFrame, keep: list[str], v: str = "v", person: str = "person") -> DataFrame:
    """keep, best_person, score: the enrolled identity with the largest product, the smaller name on ties."""
    scored = pairs.each_with_each(probes, gallery).withColumn("score", V.dot(F.col(v), F.col("centroid")))
    out = pairs.best(scored, keep, [-F.col("score"), F.col(person)], [person, "score"])
    return out.withColumnRenamed(person, "best_person")


def arg_min(probes: DataFrame, templates: DataFrame, keep: list[str], distance: Column, name: str) -> DataFrame:
    """keep, name, distance: the nearest template, the smaller name on ties."""
    scored = pairs.each_with_each(probes, templates).withColumn("distance", distance)
    return pairs.best(scored, keep, [F.col("distance"), F.col(name)], [name, "distance"])


def top_two(distances: DataFrame, group: str, name: str, d: str = "distance", lone: float = 999.0) -> DataFrame:
    """group, best, d1, d2, margin of the two nearest identities; margin (d2 - d1) / max(d1, 1e-6), d2 = d1 + lone if there is one."""
    w = Window.partitionBy(group).orderBy(d, name)
    r = distances.withColumn("rn", F.row_number().over(w)).withColumn("d2", F.lead(d).over(w)).where("rn = 1")
    d2 = F.coalesce(F.col("d2"), F.col(d) + lone)
    return r.select(group, F.col(name).alias("best"), F.col(d).alias("d1"), d2.alias("d2"), ((d2 - F.col(d)) / F.greatest(F.col(d), F.lit(1e-6))).alias("margin"))


def accepted_by_distance(name: Column, d: Column, t: float) -> Column:
    return F.when((d <= t) & (name != UNKNOWN), name).otherwise(F.lit(UNKNOWN))


def accepted_by_cosine(name: Column, c: Column, t: float) -> Column:
    return F.when(c >= t, name).otherwise(F.lit(UNKNOWN))


def accepted_by_both(c: Column, l2: Column, least_cosine: float = 0.363, most_l2: float = 1.128) -> Column:
    return (c >= least_cosine) & (l2 <= most_l2)


def correct(truth: Column, predicted: Column, known: Column) -> Column:
    """Known truths have to be named, others to be unknown."""
    return F.when(known, predicted == truth).otherwise(predicted == UNKNOWN)


def gate(flags: Column, d: Column, margin: Column, accept: float = 73.04, reject: float = 76.85, least_margin: float = 0.05) -> Column:
    """Struct escalate, reason. flags: array of the names of active quality flags, in their order."""
    case = lambda e, r: F.struct(F.lit(e).alias("escalate"), r.alias("reason"))
    return (
        F.when(F.size(flags) > 0, case(True, F.concat(F.lit("quality:"), F.array_join(flags, ","))))
        .when((d > accept) & (d < reject), case(True, F.lit("ambiguous_band")))
        .when(margin < least_margin, case(True, F.lit("low_margin")))
        .when(d <= accept, case(False, F.lit("confident_accept")))
        .otherwise(case(False, F.lit("confident_reject")))
    )


def quality_flags(blur: Column, luma: Column, noise: Column, pose: Column, px: Column, least_blur: float, low: float, high: float, most_noise: float, most_pose: float, least_px: float) -> Column:
    """Names of active flags, in the order blur, low_light, noise, off_pose, small_face; all bounds are strict."""
    named = ((blur < least_blur, "blur"), ((luma < low) | (luma > high), "low_light"), (noise > most_noise, "noise"), (pose > most_pose, "off_pose"), (px < least_px, "small_face"))
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in named]), lambda x: x.isNotNull())


def intervals(anchors: DataFrame, d: str, f: str) -> DataFrame:
    """d0, f0, d1, f1: each anchor with the next one. Anchors may be many: places come from a distributed sort."""
    from matchloom.operators import ranks

    placed = ranks.numbered(anchors.where(F.col(d).isNotNull()).select(F.col(d).cast("double").alias("d"), F.col(f).cast("double").alias("f")), ["d", "f"])
    return placed.select("place", F.col("d").alias("d0"), F.col("f").alias("f0")).join(placed.select((F.col("place") - 1).alias("place"), F.col("d").alias("d1"), F.col("f").alias("f1")), "place").drop("place")


def interpolated(rows: DataFrame, x: str, anchors: DataFrame, d: str, f: str, name: str, least: float = 1e-9) -> DataFrame:
    """rows with f between the anchors around x, linear in its logarithm (floored at `least`); the first or last anchor's f beyond them,
    the first interval's where two meet; null where x is null or there is no anchor.

    A range join by cells: percentiles of the anchors cut the line, each part is cut evenly into as many cells as make some PER_CELL
    intervals each. An interval is in every cell that it reaches into, a row in one."""
    from matchloom.operators import ranks
    from matchloom.sources.shared import written

    table = written(intervals(anchors, d, f))
    cuts, anchor = ranks.bounds(table, "d0"), F.struct(F.col(d).cast("double").alias("d"), F.col(f).cast("double").alias("f"))
    ends = anchors.where(F.col(d).isNotNull()).agg(F.min(anchor).alias("__low"), F.max(anchor).alias("__high"), F.count("*").alias("n")).first()  # one row
    (low_d, low_f), (high_d, high_f) = ends[0] or (None, None), ends[1] or (None, None)
    parts = max(1, -(-ends.n // (PER_CELL * (len(cuts) + 1))))
    edges = F.array(*[F.lit(x).cast("double") for x in (low_d, *cuts, high_d)])

    def cell(x: Column) -> Column:
        part = ranks.bucket(x, cuts)
        lo, hi = F.get(edges, part), F.get(edges, part + 1)
        return (part * parts + F.when(hi > lo, F.least(F.lit(parts - 1), F.floor((x - lo) / (hi - lo) * parts))).otherwise(0)).cast("long")

    v = F.col(x).cast("double")
    reached = table.withColumn("__cell", F.explode(F.sequence(cell(F.col("d0")), cell(F.col("d1")))))
    keyed = written(rows.withColumn("__row", F.monotonically_increasing_id())).withColumn("__x", F.when((v > F.lit(low_d)) & (v < F.lit(high_d)), v)).withColumn("__cell", cell(F.col("__x")))
    share = F.when(F.col("d1") > F.col("d0"), (F.col("__x") - F.col("d0")) / (F.col("d1") - F.col("d0"))).otherwise(1.0)
    low, high = F.greatest(F.col("f0"), F.lit(least)), F.greatest(F.col("f1"), F.lit(least))
    inside = keyed.where("__x is not null").join(reached, "__cell").where("__x >= d0 and __x <= d1")
    first = inside.groupBy("__row").agg(F.min(F.struct("d0", "d1", F.when(F.col("d1") > F.col("d0"), F.exp(F.log(low) + share * (F.log(high) - F.log(low)))).otherwise(F.col("f1")).alias("f"))).alias("__first"))
    out = F.when(v <= F.lit(low_d), F.lit(low_f)).when(v >= F.lit(high_d), F.lit(high_f)).otherwise(F.col("__first.f"))
    return keyed.join(first, "__row", "left").select(*[F.col(f"`{c}`") for c in rows.columns], out.alias(name))
