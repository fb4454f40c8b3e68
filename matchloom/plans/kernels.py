"""Pixel kernels I3, I6-I15 on 8 x 8 images made of the embeddings, as column expressions; those that would take
thousands of expressions for an image work on batches in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from matchloom.functions import align
from matchloom.functions import augment as A
from matchloom.functions import grids as G
from matchloom.functions import pixels as P
from matchloom.functions import vectors as V
from matchloom.operators import subspace
from matchloom.plans import tables as T
from matchloom.plans.registry import query

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

SIDE = 8


def tiles(spark, d):
    return T.feat(spark, d).select("vec_id", V.to_uint8(F.col("v"), 127.5, 1.0).alias("tile"))


_TILES = f"WITH {T.FEAT}, t AS (SELECT vec_id, list_transform(v, lambda x: greatest(0, least(255, round_even((x + 1) * 127.5, 0)))::INT) AS tile FROM feat)"
_PIXELS = _TILES + ", px AS (SELECT vec_id, u.i // 8 AS y, u.i % 8 AS x, tile[u.i + 1] AS v FROM t, unnest(range(0, 64)) AS u(i))"


def _sums(spark, d, kernel):
    """Mean and largest value of what a kernel makes of each tile."""
    made = tiles(spark, d).select("vec_id", kernel(F.col("tile")).alias("made"))
    return made.select("vec_id", F.round(G.mean("made"), 6).alias("mean"), F.array_max("made").cast("long").alias("largest"))


@query("i3_downscale", _PIXELS + ", m AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, round_even(avg(v), 0) AS v FROM px GROUP BY ALL) SELECT vec_id, round(avg(v), 6) AS mean, max(v)::BIGINT AS largest FROM m GROUP BY vec_id")
def i3(spark, d):
    return _sums(spark, d, lambda t: G.shrunk(t, SIDE, 4))


_EQ = ", p AS (SELECT vec_id, u.x AS x FROM t, unnest(tile) AS u(x)), c AS (SELECT vec_id, x, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id ORDER BY x) AS cum FROM p GROUP BY vec_id, x), e AS (SELECT vec_id, n, first_value(cum) OVER (PARTITION BY vec_id ORDER BY x) AS lo, cum FROM c), q AS (SELECT vec_id, n, round_even((cum - lo) * 255.0::DOUBLE / (64 - lo), 0) AS y FROM e)"


@query("i6_equalize", _TILES + _EQ + " SELECT vec_id, round(sum(n * y) / 64, 6) AS mean, max(y)::BIGINT AS largest FROM q GROUP BY vec_id")
def i6(spark, d):
    return _sums(spark, d, G.equalized)


@query(
    "i6_clahe",
    _PIXELS + ", c AS (SELECT a.vec_id, a.y, a.x, sum(CASE WHEN b.v <= a.v THEN 1 ELSE 0 END) AS below FROM px a, (VALUES (-1), (0)) AS dy(k), (VALUES (-1), (0)) AS dx(k), px b WHERE b.vec_id = a.vec_id AND b.y = greatest(0, a.y + dy.k) AND b.x = greatest(0, a.x + dx.k) GROUP BY a.vec_id, a.y, a.x) SELECT vec_id, round(avg(round_even(below * 255.0::DOUBLE / 4, 0)), 6) AS mean, max(round_even(below * 255.0::DOUBLE / 4, 0))::BIGINT AS largest FROM c GROUP BY vec_id",
)
def i6_clahe(spark, d):
    """A grid of 8 x 8 cells; on these tiles a cell is a pixel, so a pixel's rank among the four cells around it counts."""
    return _sums(spark, d, lambda t: G.clahe(t, SIDE))


@query("i6_tan_triggs")
def i6_tan_triggs(spark, d):
    return _sums(spark, d, lambda t: G.tan_triggs(t, SIDE))


@query("i8_gamma", _TILES + " SELECT vec_id, list_transform(tile, lambda x: floor(pow(x / 255.0::DOUBLE, 0.5) * 255)::INT) AS tile FROM t")
def i8(spark, d):
    """The gamma table as an expression, without Python."""
    return tiles(spark, d).select("vec_id", F.transform("tile", lambda x: F.floor(F.pow(x / 255.0, F.lit(0.5)) * 255).cast("int")).alias("tile"))


@query("i9_blob_normalize", _TILES + " SELECT vec_id, list_transform(tile, lambda x: round((x - 127.5::DOUBLE) / 128, 6)) AS blob FROM t")
def i9(spark, d):
    return tiles(spark, d).select("vec_id", F.transform("tile", lambda x: F.round((x - 127.5) / 128, 6)).alias("blob"))


def pattern_lists(spark, d):
    """vec_id, person, known, probe, bins, shares: filled bins of the histograms of 8 x 8 cells, cell * 256 + code, in order; images are drawn out
    to 18 pixels a side, so that cells have 2 x 2 codes. The feature has 8 * 8 * 256 bins, of which the lists hold those that aren't zero."""
    t = T.feat(spark, d).select("vec_id", "person", "known", "probe", V.to_uint8(F.col("v"), 127.5, 1.0).alias("tile"))
    keep = ["vec_id", "person", "known", "probe"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, P.AT_ONCE):
                one = b.slice(at, P.AT_ONCE)
                there = np.flatnonzero(one["tile"].is_valid())
                row, cell, code, n = P.cell_codes(P.binary_patterns(P.scaled(P.pixels(one["tile"].drop_null(), SIDE * SIDE), SIDE, 18), 18), 16, 8)
                ends = pa.array(np.append(0, np.bincount(there[row], minlength=one.num_rows).cumsum()), pa.int32())
                made = [pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((cell * 256 + code, pa.int32()), (n / 4.0, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[one[c] for c in keep], *made], names=[*keep, "bins", "shares"])

    return t.mapInArrow(lists, "vec_id long, person string, known boolean, probe boolean, bins array<int>, shares array<double>")


def local_patterns(spark, d):
    """vec_id, cell, code, share: a row for each filled bin."""
    each = pattern_lists(spark, d).select("vec_id", F.explode(F.arrays_zip("bins", "shares")).alias("x"))
    return each.select("vec_id", F.shiftright("x.bins", 8).cast("long").alias("cell"), (F.col("x.bins") % 256).alias("code"), F.col("x.shares").alias("share"))


@query("i10_lbph_histogram")
def i10(spark, d):
    return local_patterns(spark, d).groupBy("vec_id").agg(F.count("*").alias("bins"), F.max("share").alias("largest"), F.sum("share").alias("total"))


@query("i11_projection")
def i11(spark, d):
    """(x - mean) times the axes fitted to the members, four of them; signs of axes are arbitrary, so squares are shown."""
    return subspace.projected(T.feat(spark, d), subspace.pca(T.members(spark, d), 4)).select("vec_id", F.transform("p", lambda x: F.round(x * x, 6)).alias("squares"))


def modified(spark, d):
    """vec_id, tile, kind, level, made: every tile in all variants."""
    t = tiles(spark, d)
    return t.select("vec_id", "tile", F.explode(A.suite(F.col("tile"), SIDE, F.col("vec_id"))).alias("m")).select("vec_id", "tile", "m.*")


@query("i12_modification_suite")
def i12(spark, d):
    """Mean absolute change of each tile by kind and level."""
    change = G.mean(F.zip_with("made", "tile", lambda a, b: F.abs(a - b)))
    return modified(spark, d).select("vec_id", "kind", "level", F.round(change, 6).alias("change"))


_POINT = ", m AS (SELECT * FROM (VALUES ('brightness_up', 15.0), ('brightness_down', -60.0), ('contrast_up', 1.30), ('contrast_down', 0.55), ('gamma_up', 1.6), ('gamma_down', 0.5)) AS m(kind, level)), a AS (SELECT vec_id, kind, level::DOUBLE AS level, tile, list_transform(tile, lambda x: floor(greatest(0, least(255, CASE WHEN kind LIKE 'b%' THEN x + level::DOUBLE WHEN kind LIKE 'c%' THEN (x - 128.0::DOUBLE) * level::DOUBLE + 128 ELSE pow(x / 255.0::DOUBLE, 1 / level::DOUBLE) * 255 END)))::INT) AS made FROM t, m)"


@query("i12_point_operations", _TILES + _POINT + " SELECT vec_id, kind, level, list_sum(made)::BIGINT AS total FROM a")
def i12_points(spark, d):
    """Some variants of the suite whose pixels change one by one."""
    asked = (("brightness_up", 15.0), ("brightness_down", -60.0), ("contrast_up", 1.30), ("contrast_down", 0.55), ("gamma_up", 1.6), ("gamma_down", 0.5))
    on = {"b": G.brighter, "c": G.contrasted, "g": G.gamma}
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("level"), on[k[0]](F.col("tile"), F.lit(v)).alias("made")) for k, v in asked])
    return tiles(spark, d).select("vec_id", F.explode(made).alias("m")).select("vec_id", "m.kind", "m.level", F.aggregate("m.made", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("i13_augmentation")
def i13(spark, d):
    made = F.array(*[F.struct(F.lit(s).alias("strength"), A.augmented(F.col("tile"), SIDE, F.col("vec_id"), s).alias("made")) for s in ("light", "medium")])
    return tiles(spark, d).select("vec_id", F.explode(made).alias("m")).select("vec_id", "m.strength", F.round(G.mean(F.col("m.made")), 6).alias("mean"))


@query("i14_quality_probes", _TILES + " SELECT vec_id, round(list_avg(tile), 6) AS luma FROM t")
def i14(spark, d):
    return tiles(spark, d).select("vec_id", F.round(G.mean(F.col("tile")), 6).alias("luma"))


_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_AROUND = _PIXELS + f", n AS (SELECT a.vec_id, a.y, a.x, sum(k.l * b.v) AS l, sum(k.n * b.v) AS n FROM px a, (VALUES (-1, -1, 0, 1), (-1, 0, 1, -2), (-1, 1, 0, 1), (0, -1, 1, -2), (0, 0, -4, 4), (0, 1, 1, -2), (1, -1, 0, 1), (1, 0, 1, -2), (1, 1, 0, 1)) AS k(dy, dx, l, n), px b WHERE b.vec_id = a.vec_id AND b.y = {_MIRROR.format('(a.y + k.dy)')} AND b.x = {_MIRROR.format('(a.x + k.dx)')} GROUP BY a.vec_id, a.y, a.x)"


@query("i14_blur_and_noise", _AROUND + " SELECT vec_id, round(var_pop(l), 6) AS blur, round(sum(abs(n)) * sqrt(0.5 * pi()) / 216, 6) AS noise FROM n GROUP BY vec_id")
def i14_blur(spark, d):
    return tiles(spark, d).select("vec_id", F.round(G.laplacian_variance(F.col("tile"), SIDE), 6).alias("blur"), F.round(G.noise_sigma(F.col("tile"), SIDE), 6).alias("noise"))


#: Regions of a face as left, top, width, height in percent of the image.
REGIONS = {"full_face": (0, 0, 100, 100), "eyes": (15, 20, 70, 30), "nose": (35, 45, 30, 30), "mouth": (25, 70, 50, 25)}


def region(name: str, i):
    """Whether pixel i lies in a region: its middle does."""
    left, top, width, height = REGIONS[name]
    at = lambda p, low, n: ((p + 0.5) * 100 / SIDE >= low) & ((p + 0.5) * 100 / SIDE < low + n)
    return at(F.floor(i / SIDE), top, height) & at(i % SIDE, left, width)


_REGION = ", r(name, l, t, w, h) AS (VALUES " + ", ".join(f"('{n}', {left}, {top}, {w}, {h})" for n, (left, top, w, h) in REGIONS.items()) + ")"
_IN = "(y + 0.5) * 12.5 >= t AND (y + 0.5) * 12.5 < t + h AND (x + 0.5) * 12.5 >= l AND (x + 0.5) * 12.5 < l + w"


@query("i15_region_blackout", _PIXELS + _REGION + f" SELECT vec_id, name AS region, coalesce(sum(v) FILTER (WHERE {_IN}), 0)::BIGINT AS cropped, coalesce(sum(v) FILTER (WHERE NOT ({_IN})), 0)::BIGINT AS blacked_out FROM px, r GROUP BY ALL")
def i15(spark, d):
    """Sums of the pixels that a region's crop keeps, and of those that stay when it is blacked out."""
    total = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x)
    cut = lambda n, keep: total(F.transform("tile", lambda x, i: F.when(region(n, i) == F.lit(keep), x).otherwise(0)))
    both = F.array(*[F.struct(F.lit(n).alias("region"), cut(n, True).alias("cropped"), cut(n, False).alias("blacked_out")) for n in REGIONS])
    return tiles(spark, d).select("vec_id", F.explode(both).alias("r")).select("vec_id", "r.*")


def landmarks(spark, d):
    """l_orderkey, l_linenumber, points: the template of landmarks turned, scaled and moved as a line says, one of them wrong on every other line."""
    turn, zoom = F.col("l_discount").cast("double") * 8, 0.5 + F.col("l_tax").cast("double") * 10
    dx, dy = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 3.0
    points = []
    for i, (u, v) in enumerate(align.TEMPLATE):
        wrong = F.when((F.col("l_orderkey") % 2 == 0) & (F.col("l_linenumber") % 5 == i), 60.0).otherwise(0.0)
        points.append(F.struct((zoom * (F.cos(turn) * u - F.sin(turn) * v) + dx + wrong).alias("x"), (zoom * (F.sin(turn) * u + F.cos(turn) * v) + dy - wrong).alias("y")))
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*points).alias("points"))


@query(
    "i5_landmark_align",
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE * 8 AS turn, 0.5 + l_tax::DOUBLE * 10 AS zoom, l_quantity::DOUBLE AS dx, l_linenumber * 3.0::DOUBLE AS dy FROM lineitem), m AS (SELECT *, cos(turn) / zoom AS a, -sin(turn) / zoom AS b FROM x) SELECT l_orderkey, l_linenumber, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(-(a * dx - b * dy), 4) + 0.0 AS tx, round(-(b * dx + a * dy), 4) + 0.0 AS ty, CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 5 END AS inliers FROM m",
)
def i5(spark, d):
    """The similarity back to the template, by the least median of squares over pairs of landmarks: a wrong landmark doesn't move it."""
    m = landmarks(spark, d).withColumn("m", align.least_median(F.col("points")))
    return m.select("l_orderkey", "l_linenumber", *[(F.round(f"m.{c}", n) + 0.0).alias(c) for c, n in (("a", 6), ("b", 6), ("tx", 4), ("ty", 4))], "m.inliers")


@query("i8_enhance")
def i8_enhance(spark, d):
    """Raw colour images enhanced: equalization by cells of the luma alone, then the gamma table on every channel."""
    t = tiles(spark, d).select("vec_id", F.transform("tile", lambda x, i: F.struct(x.alias("b"), F.get(F.col("tile"), 63 - i).alias("g"), F.get(F.col("tile"), (i + 9) % 64).alias("r"))).alias("image"))
    return t.select("vec_id", G.enhanced(F.col("image"), SIDE, 2.0).alias("image"))
