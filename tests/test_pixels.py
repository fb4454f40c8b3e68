"""Batches of images in numpy against the column expressions."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchloom.functions import augment
from matchloom.functions import grids as G
from matchloom.functions import pixels as P
from matchloom.plans import registry


@pytest.fixture(scope="module")
def images(spark):
    """Random images, flat ones, extremes, one that ends early and one with pixels beyond its end."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 256, 64).tolist() for _ in range(20)] + [[7] * 64, [0, 255] * 32, list(range(64)), rng.integers(90, 93, 64).tolist(), [9] * 50, [3] * 70]
    return rows, spark.createDataFrame(list(enumerate(rows)), "k long, t array<int>")


def test_binary_patterns(images):
    rows, df = images
    want = [r.x for r in df.orderBy("k").select(G.binary_patterns(G.scaled(F.col("t"), 8, 18), 18).alias("x")).collect()]
    got = P.binary_patterns(P.scaled(P.pixels(pa.array(rows), 64), 8, 18), 18)
    assert got.tolist() == want
    row, cell, code, n = P.cell_codes(got, 16, 8)
    counts = {}
    for r, codes in enumerate(want):
        for i, c in enumerate(codes):
            key = (r, i // 16 // 2 * 8 + i % 16 // 2, c)
            counts[key] = counts.get(key, 0) + 1
    assert dict(zip(zip(row.tolist(), cell.tolist(), code.tolist()), n.tolist())) == counts


def test_local_patterns_take_no_expressions_by_pixel(spark, sf_dir):
    plan = registry.queries()["i10_lbph_histogram"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and len(plan) < 20_000


def test_changes_that_differ_by_image(images):
    rows, df = images
    rng, n = np.random.default_rng(6), len(rows)
    angle, zoom, dx, dy, keep = (rng.uniform(low, high, n) for low, high in ((-10, 10), (0.9, 1.1), (-10, 10), (-10, 10), (0.45, 0.7)))
    size, (top, left) = rng.integers(4, 9, n), rng.integers(0, 4, (2, n))
    at = lambda a: F.get(F.array(*[F.lit(x) for x in a.tolist()]), F.col("k").cast("int"))
    t, c = P.pixels(pa.array(rows), 64), F.col("t")
    whole = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(c, i))  # a short image ends in nulls, which filters bring to 255
    turned = df.orderBy("k").select(F.cos(F.radians(at(angle))).alias("c"), F.sin(F.radians(at(angle))).alias("s")).toPandas()
    both = (
        (G.warped(c, 8, at(angle), at(zoom), at(dx), at(dy)), P.warped(t, 8, turned.c.to_numpy(), turned.s.to_numpy(), zoom, dx, dy)),
        (G.resized(c, 8, at(top), at(left), at(size), at(size)), P.resized(t, 8, top, left, size, size)),
        *((G.blurred(c, 8, k), P.blurred(t, 8, k)) for k in (3, 5, 7)),
        *((G.motion_blurred(c, 8, k), P.motion_blurred(t, 8, k)) for k in (3, 5)),
        (G.veiled(G.rounded(whole.cast("array<double>")), 8, at(top), at(left), at(size), at(size), at(keep)), P.veiled(P.held(t), 8, top, left, size, size, keep)),
    )
    for want, got in both:
        assert got.tolist() == [r.x for r in df.orderBy("k").select(want.alias("x")).collect()]


def test_augmented_images_are_those_of_the_expressions(spark, images):
    """Checksums of what the column expressions, which went pixel by pixel, made of the same images."""
    want = {("light", True): 2301912750, ("light", False): 1842941537, ("medium", True): 3618372510, ("medium", False): 3352979386}
    for (strength, flips), crc in want.items():
        got = images[1].repartition(3).select("k", augment.augmented(F.col("t"), 8, F.col("k"), strength, flips).alias("x")).orderBy("k").collect()
        assert zlib.crc32(json.dumps([r.x for r in got]).encode()) == crc
    odd = spark.createDataFrame([(1, None), (1, []), (1, [None] * 64), (2, [])], "k long, t array<int>")
    for strength in ("light", "medium"):
        null, empty, nulls, other = (r.x for r in odd.coalesce(1).select(augment.augmented(F.col("t"), 8, F.col("k"), strength).alias("x")).collect())
        assert null == empty and len(null) == len(nulls) == 64 and null != other
        assert images[1].where("k < 0").select(augment.augmented(F.col("t"), 8, F.col("k"), strength)).collect() == []


def test_augmentation_takes_no_expressions_by_pixel(spark, sf_dir):
    plan = registry.queries()["i13_augmentation"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and len(plan) < 20_000


def test_suite_is_that_of_the_expressions(spark, sf_dir, images):
    c, df = F.col("t"), images[1]
    want = {("rotation", -10.0): G.warped(c, 8, F.lit(-10.0), F.lit(1.0)), ("zoom", 0.95): G.warped(c, 8, F.lit(0.0), F.lit(0.95)), ("gaussian_blur", 7.0): G.blurred(c, 8, 7), ("motion_blur", 5.0): G.motion_blurred(c, 8, 5)}
    rows = df.select(augment.suite(c, 8, F.col("k")).alias("all"), *[x.alias(k) for (k, _), x in want.items()]).collect()
    for r in rows:
        made = {(m.kind, m.level): m.made for m in r["all"]}
        assert len(made) == 41 and all(made[key] == r[key[0]] for key in want)
    assert "ArrowEvalPython" in registry.queries()["i12_modification_suite"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
