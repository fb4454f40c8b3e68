"""Variants of images: the suite of modifications and random augmentation."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import grids as G
from matchloom.functions import pixels as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Kinds of the modification suite and their levels, 41 in all.
SUITE = {
    "brightness_up": (15, 30, 45, 60), "brightness_down": (-15, -30, -45, -60), "contrast_up": (1.15, 1.30, 1.45), "contrast_down": (0.85, 0.70, 0.55), "gamma_up": (1.2, 1.4, 1.6), "gamma_down": (0.8, 0.65, 0.5),
    "gaussian_noise": (5, 10, 15, 20), "gaussian_blur": (3, 5, 7), "motion_blur": (3, 5, 7), "rotation": (-10, -5, 5, 10), "zoom": (0.90, 0.95, 1.05, 1.10), "occlusion": (0.075, 0.125, 0.175),
}
#: Ranges of the random parameters.
RANGES = {
    "light": {"bright": (0.8, 1.2), "contrast": (0.9, 1.1), "angle": (-5.0, 5.0), "move": (-5.0, 5.0), "zoom": (0.95, 1.05), "noise": (5.0, 10.0)},
    "medium": {"bright": (0.6, 1.4), "contrast": (0.7, 1.3), "angle": (-10.0, 10.0), "move": (-10.0, 10.0), "zoom": (0.9, 1.1), "noise": (10.0, 20.0), "gamma": (0.7, 1.5), "crop": (0.90, 0.97), "area": (0.05, 0.10), "keep": (0.45, 0.70)},
}


def suite(tile: Column, side: int, key: Column) -> Column:
    """The 41 variants of an image, an array of structs kind, level, made. Those that need pixels around work on batches of images in numpy."""
    change = {"brightness": G.brighter, "contrast": G.contrasted, "gamma": G.gamma, "gaussian_noise": lambda t, s: G.noisy(t, s, key, "noise")}
    near = [(kind, level) for kind in ("gaussian_blur", "motion_blur", "rotation", "zoom") for level in SUITE[kind]]

    def changed(t: np.ndarray, kind: str, level: float, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
        if kind.endswith("blur"):
            return (P.blurred if kind == "gaussian_blur" else P.motion_blurred)(t, side, level)
        still = np.zeros(len(t))
        return P.warped(t, side, cos, sin, still + (level if kind == "zoom" else 1.0), still, still)

    @F.arrow_udf("array<array<int>>")
    def made(tiles: pa.Array, turns: pa.Array) -> pa.Array:
        n, out = side * side, np.empty((len(tiles), len(near), side * side), np.int32)
        for at in range(0, len(tiles), P.AT_ONCE):
            one = slice(at, at + P.AT_ONCE)
            t, p = P.pixels(tiles[one], n), P.pixels(turns[one], 2 * len(near))
            for k, (kind, level) in enumerate(near):
                out[one, k] = changed(t, kind, level, p[:, 2 * k], p[:, 2 * k + 1])
        lists = pa.ListArray.from_arrays(np.arange(len(tiles) * len(near) + 1, dtype=np.int32) * n, out.ravel())
        return pa.ListArray.from_arrays(np.arange(len(tiles) + 1, dtype=np.int32) * len(near), lists)

    angles = [F.radians(F.lit(float(level) if kind == "rotation" else 0.0)) for kind, level in near]
    around = made(F.coalesce(tile, F.array().cast("array<int>")), F.array(*[f(a) for a in angles for f in (F.cos, F.sin)]))
    out = []
    for kind, levels in SUITE.items():
        stem = kind.removesuffix("_up").removesuffix("_down")
        for level in levels:
            if (kind, level) in near:
                one = F.get(around, near.index((kind, level)))
            else:
                one = G.occluded(tile, side, level, key, f"occlusion {level}") if kind == "occlusion" else change[stem](tile, F.lit(float(level)))
            out.append(F.struct(F.lit(kind).alias("kind"), F.lit(float(level)).alias("level"), one.alias("made")))
    return F.array(*out)


def augmented(tile: Column, side: int, key: Column, strength: str, flips: bool = True) -> Column:
    """A random change of an image, the same for the same key. Light: brightness and contrast, a small warp, a blur, noise.
    Medium: wider ranges, and gamma, a crop, motion blur half of the time, and a veiled patch. Either is mirrored half of the time.

    Random numbers and what is done to each pixel by itself are expressions; what needs pixels around works on batches of images in numpy."""
    ranges, medium = RANGES[strength], strength == "medium"
    draw = lambda name, of=None: ranges[of or name][0] + G.uniform(key, strength, name) * (ranges[of or name][1] - ranges[of or name][0])
    whole = lambda name, low, high: low + F.floor(G.uniform(key, strength, name) * F.greatest(F.lit(1), high - low + 1)).cast("int")
    out = F.transform(tile, lambda x: G.held(x * draw("contrast") + (draw("bright") - 1) * 128.0))
    if medium:
        out = G.then(out, lambda t: G.gamma(t, draw("gamma")))
    angle = F.radians(draw("angle"))
    drawn = {"cos": F.cos(angle), "sin": F.sin(angle), "zoom": draw("zoom"), "dx": draw("dx", "move"), "dy": draw("dy", "move"), "noise": draw("noise")}
    if medium:
        size = F.greatest(F.lit(8), F.rint(side * draw("crop")).cast("int"))
        drawn |= {"size": size, "top": whole("top", F.lit(0), side - size), "left": whole("left", F.lit(0), side - size)}
        drawn["motion"] = F.when(G.uniform(key, "motion") < 0.5, 0).when(G.uniform(key, "length") < 1 / 3, 3).otherwise(5)
        height = F.least(F.lit(side), F.greatest(F.lit(4), F.rint(F.sqrt(draw("area") * side * side)).cast("int")))
        width = F.least(F.lit(side), F.greatest(F.lit(4), F.rint(draw("area") * side * side / height).cast("int")))
        low = int(side * 0.58)
        forehead = whole("y", F.lit(0), F.greatest(F.lit(0), int(side * 0.30) - height))
        cheek = F.least(F.greatest(F.lit(0), side - height), whole("y", F.lit(low), F.greatest(F.lit(low), F.least(side - height, F.lit(int(side * 0.82))))))
        edge = int(side * 0.10)
        drawn |= {"y": F.when(G.uniform(key, "part") < 0.5, forehead).otherwise(cheek), "height": height, "width": width, "keep": draw("keep")}
        drawn["x"] = F.least(F.greatest(F.lit(0), side - width), whole("x", F.lit(edge), F.greatest(F.lit(edge), side - width - edge)))
    if flips:
        drawn["flip"] = (G.uniform(key, strength, "flip") < 0.5).cast("int")
    normals = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: G.normal(key, strength, i))

    def changed(t: np.ndarray, p: dict[str, np.ndarray], normals: np.ndarray) -> np.ndarray:
        t = P.warped(t, side, p["cos"], p["sin"], p["zoom"], p["dx"], p["dy"])
        if medium:
            t = P.resized(t, side, p["top"], p["left"], p["size"], p["size"])
        t = P.blurred(t, side, 5 if medium else 3)
        if medium:
            for k in (3, 5):
                t[p["motion"] == k] = P.motion_blurred(t[p["motion"] == k], side, k)
        t = P.held(t + p["noise"][:, None] * normals)
        if medium:
            t = P.veiled(t, side, p["y"], p["x"], p["height"], p["width"], p["keep"])
        return np.where(p["flip"][:, None] == 1, P.flipped(t, side), t) if flips else t

    @F.arrow_udf("array<int>")
    def made(tiles: pa.Array, drawn: pa.Array, normals: pa.Array) -> pa.Array:
        n, out = side * side, np.empty((len(tiles), side * side), np.int32)
        for at in range(0, len(tiles), P.AT_ONCE):
            one = slice(at, at + P.AT_ONCE)
            p = {f.name: drawn[one].field(f.name).to_numpy(zero_copy_only=False) for f in drawn.type}
            out[one] = changed(P.pixels(tiles[one], n), p, P.pixels(normals[one], n))
        return pa.ListArray.from_arrays(np.arange(len(tiles) + 1, dtype=np.int32) * n, out.ravel())

    # all pixels of a null image are missing
    return made(F.coalesce(out, F.array().cast("array<int>")), F.struct(*[c.alias(name) for name, c in drawn.items()]), normals)
