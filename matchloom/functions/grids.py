"""Gray images as arrays of side * side pixels, row by row: kernels as column expressions, without Python.

Pixels outside are the ones mirrored at the border pixel. Results of filters are rounded, of point operations cut to
whole numbers, both held to 0..255. No parity with any imaging library is claimed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the smallest Gaussian kernels.
GAUSSIAN = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}
LAPLACIAN = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}
IMMERKAER = {(a, b): float((1, -2, 1)[a + 1] * (1, -2, 1)[b + 1]) for a in (-1, 0, 1) for b in (-1, 0, 1)}


def held(x: Column) -> Column:
    """Held to 0..255 and cut to whole numbers."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("int")


def _mirrored(p: Column, side: int) -> Column:
    """The place within 0..side-1 that p outside stands for, however far."""
    if side == 1:
        return F.lit(0)
    period = 2 * (side - 1)
    q = F.pmod(p, F.lit(period))
    return F.least(q, period - q)


def then(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, where f uses it inside of lambdas."""
    return F.get(F.transform(F.array(x), f), 0)


def _each(side: int, value: Callable[[Column, Column], Column]) -> Column:
    """An array with value(y, x) for each pixel."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: value(F.floor(i / side).cast("int"), (i % side).cast("int")))


def _at(tile: Column, side: int, y: Column, x: Column) -> Column:
    return F.get(tile, _mirrored(y, side) * side + _mirrored(x, side)).cast("double")


def convolved(tile: Column, side: int, weights: dict[tuple[int, int], float]) -> Column:
    """Sums of neighbours (dy, dx) by weight."""
    return then(tile, lambda t: _each(side, lambda y, x: sum((w * _at(t, side, y + dy, x + dx) for (dy, dx), w in weights.items()), F.lit(0.0))))


def rounded(values: Column) -> Column:
    return F.transform(values, lambda v: held(F.rint(v)))


def smoothed(tile: Column, side: int, weights: tuple[float, ...]) -> Column:
    """Along rows, then along columns, by the same weights."""
    r = len(weights) // 2
    return then(convolved(tile, side, {(0, k - r): w for k, w in enumerate(weights)}), lambda t: convolved(t, side, {(k - r, 0): w for k, w in enumerate(weights)}))


def gaussian(sigma: float) -> tuple[float, ...]:
    """Weights of a kernel of four deviations to either side."""
    r = int(round(sigma * 8 + 1) | 1) // 2
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return tuple(x / sum(w) for x in w)


def blurred(tile: Column, side: int, size: int) -> Column:
    return rounded(smoothed(tile, side, GAUSSIAN[size | 1]))


def motion_blurred(tile: Column, side: int, size: int) -> Column:
    k = max(3, size | 1)
    return rounded(convolved(tile, side, {(0, d - k // 2): 1.0 / k for d in range(k)}))


def between(tile: Column, side: int, to: int, place: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An image of `to` pixels a side; each from between the four that surround place(y, x)."""

    def value(t: Column, y: Column, x: Column) -> Column:
        v, u = place(y.cast("double"), x.cast("double"))

        def mixed(p: Column) -> Column:
            v0, u0 = F.floor(p["v"]).cast("int"), F.floor(p["u"]).cast("int")
            fv, fu = p["v"] - v0, p["u"] - u0
            row = lambda k: _at(t, side, v0 + k, u0) * (1 - fu) + _at(t, side, v0 + k, u0 + 1) * fu
            return held(F.rint(row(0) * (1 - fv) + row(1) * fv))

        return then(F.struct(v.alias("v"), u.alias("u")), mixed)

    return then(tile, lambda t: _each(to, lambda y, x: value(t, y, x)))


def sampled(tile: Column, side: int, place: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Each pixel from between the four that surround place(y, x)."""

    return between(tile, side, side, place)


def warped(tile: Column, side: int, degrees: Column, zoom: Column, dx: Column | None = None, dy: Column | None = None) -> Column:
    """Turned counter-clockwise and zoomed about the middle, then moved."""
    dx, dy = F.lit(0.0) if dx is None else dx, F.lit(0.0) if dy is None else dy
    c, cos, sin = (side - 1) / 2, F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def place(y: Column, x: Column) -> tuple[Column, Column]:
        b, a = y - dy - c, x - dx - c
        return c + (a * sin + b * cos) / zoom, c + (a * cos - b * sin) / zoom

    return sampled(tile, side, place)


def resized(tile: Column, side: int, top: Column, left: Column, height: Column, width: Column) -> Column:
    """A part of the image, drawn out to the whole; pixels at the part's edge go on outside."""
    within = lambda p, low, n: F.greatest(low, F.least(low + n - 1, p))
    return sampled(tile, side, lambda y, x: (within(top + (y + 0.5) * height / side - 0.5, top, height), within(left + (x + 0.5) * width / side - 0.5, left, width)))


def scaled(tile: Column, side: int, to: int) -> Column:
    """The image with `to` pixels a side, from between the nearest ones."""
    at = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(side - 1.0), (p + 0.5) * (side / to) - 0.5))
    return between(tile, side, to, lambda y, x: (at(y), at(x)))


def brighter(tile: Column, offset: Column) -> Column:
    return F.transform(tile, lambda x: held(x + offset))


def contrasted(tile: Column, factor: Column) -> Column:
    return F.transform(tile, lambda x: held((x - 128.0) * factor + 128.0))


def gamma(tile: Column, by: Column) -> Column:
    """255 * (x / 255) ^ (1 / by)."""
    return F.transform(tile, lambda x: held(F.pow(x / 255.0, 1 / F.greatest(by, F.lit(1e-6))) * 255.0))


def uniform(key: Column, *salt) -> Column:
    """A number from 0 to 1 that depends on the key and the salt only."""
    return (F.pmod(F.xxhash64(key, *[s if isinstance(s, Column) else F.lit(s) for s in salt]), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(key: Column, salt: str, i: Column) -> Column:
    """A normally distributed number for pixel i, by a pair of uniform ones."""
    return F.sqrt(-2 * F.log(uniform(key, salt, "r", i))) * F.cos(2 * math.pi * uniform(key, salt, "a", i))


def noisy(tile: Column, sigma: Column, key: Column, salt: str) -> Column:
    """Normal noise."""
    return F.transform(tile, lambda x, i: held(x + sigma * normal(key, salt, i)))


def median(values: Column) -> Column:
    """The middle one, or the mean of the two in the middle."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def veiled(tile: Column, side: int, top: Column, left: Column, height: Column, width: Column, keep: Column) -> Column:
    """A rectangle mixed with its own median: `keep` of each pixel stays."""
    inside = lambda i: (F.floor(i / side) >= top) & (F.floor(i / side) < top + height) & (i % side >= left) & (i % side < left + width)
    both = F.struct(tile.alias("t"), F.floor(median(F.filter(tile, lambda x, i: inside(i)))).alias("fill"))
    return then(both, lambda b: F.transform(b["t"], lambda x, i: F.when(inside(i), held(keep * x + (1 - keep) * b["fill"])).otherwise(x)))


def occluded(tile: Column, side: int, share: float, key: Column, salt: str) -> Column:
    """A square of the given share of the image, anywhere, mixed 0.55 to 0.45 with its median."""
    area = max(1.0, share * side * side)
    height = min(side, int(max(4, round(math.sqrt(area)))))
    width = min(side, int(max(4, round(area / max(4, round(math.sqrt(area)))))))
    place = lambda n, axis: F.floor(uniform(key, salt, axis) * max(1, side - n + 1)).cast("int")
    return veiled(tile, side, place(height, "y"), place(width, "x"), F.lit(height), F.lit(width), F.lit(0.55))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def variance(values: Column) -> Column:
    return then(values, lambda v: mean(F.transform(v, lambda x: x.cast("double") * x)) - F.pow(mean(v), F.lit(2.0)))


def laplacian_variance(tile: Column, side: int) -> Column:
    return variance(convolved(tile, side, LAPLACIAN))


def noise_sigma(tile: Column, side: int) -> Column:
    """Immerkaer's estimate of the noise's standard deviation; 0 for images of under three pixels a side."""
    if side < 3:
        return F.lit(0.0)
    total = F.aggregate(convolved(tile, side, IMMERKAER), F.lit(0.0), lambda s, x: s + F.abs(x))
    return total * math.sqrt(0.5 * math.pi) / (6.0 * (side - 2) * (side - 2))


def equalized(tile: Column) -> Column:
    """Gray values by the share of pixels up to them, the smallest at 0; images of one value stay."""
    low = F.struct(tile.alias("t"), F.array_min(tile).alias("low"))
    upto = lambda t, v: F.size(F.filter(t, lambda x: x <= v))
    counted = then(low, lambda s: F.struct(s["t"].alias("t"), F.size(s["t"]).alias("n"), upto(s["t"], s["low"]).alias("first")))
    return then(counted, lambda s: F.when(s["n"] == s["first"], s["t"]).otherwise(F.transform(s["t"], lambda v: held(F.rint((upto(s["t"], v) - s["first"]) * 255.0 / (s["n"] - s["first"]))))))


def enhanced(image: Column, side: int, by: float, cells: bool = True) -> Column:
    """A colour image (array of struct b, g, r) with its luma equalized by cells and each channel by the gamma table; chroma is kept."""
    level = lambda x: F.floor(F.pow(x / 255.0, F.lit(1 / by)) * 255).cast("int")
    table = lambda p: F.struct(*[level(p[c]).alias(c) if abs(by - 1) > 1e-6 and by > 0 else p[c].alias(c) for c in "bgr"])

    def chroma(p: Column) -> Column:
        y = held(F.rint(0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]))
        return then(y, lambda y: F.struct(y.alias("y"), held(F.rint((p["r"] - y) * 0.713 + 128)).alias("cr"), held(F.rint((p["b"] - y) * 0.564 + 128)).alias("cb")))

    def colour(y: Column, c: Column) -> Column:
        cr, cb = c["cr"] - 128, c["cb"] - 128
        return F.struct(held(F.rint(y + 1.773 * cb)).alias("b"), held(F.rint(y - 0.714 * cr - 0.344 * cb)).alias("g"), held(F.rint(y + 1.403 * cr)).alias("r"))

    def whole(c: Column) -> Column:
        return F.zip_with(clahe(F.transform(c, lambda p: p["y"]), side), c, colour)

    made = then(F.transform(image, chroma), whole) if cells else image
    return F.transform(made, table)


def clahe(tile: Column, side: int, grid: int = 8, clip: float = 2.0) -> Column:
    """Equalization in cells of a grid with clipped histograms, from between the four cells around a pixel. side must be a
    multiple of grid."""
    size = side // grid
    most = max(1, int(clip * size * size / 256))
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(grid - 1), c))

    def cell(t: Column, cy: Column, cx: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.get(t, (cy * size + F.floor(k / size)).cast("int") * side + (cx * size + k % size).cast("int")))

    def mapped(values: Column, v: Column) -> Column:
        # clipped counts up to v, and the part up to v of what was clipped off, which is dealt out evenly
        counts = F.transform(F.array_distinct(values), lambda u: F.struct(u.alias("u"), F.size(F.filter(values, lambda x: x == u)).alias("n")))

        def level(c: Column) -> Column:
            below = F.aggregate(F.filter(c, lambda e: e["u"] <= v), F.lit(0), lambda s, e: s + F.least(e["n"], F.lit(most)))
            over = F.aggregate(c, F.lit(0), lambda s, e: s + F.greatest(e["n"] - most, F.lit(0)))
            return F.least(F.lit(255.0), F.rint((below + over * (v + 1) / 256.0) * 255.0 / (size * size)))

        return then(counts, level)

    def value(t: Column, y: Column, x: Column) -> Column:
        fy, fx = y / size - 0.5, x / size - 0.5
        where = F.struct(F.get(t, y * side + x).alias("v"), F.floor(fy).cast("int").alias("y"), F.floor(fx).cast("int").alias("x"), (fy - F.floor(fy)).alias("ay"), (fx - F.floor(fx)).alias("ax"))

        def mixed(p: Column) -> Column:
            at = lambda a, b: then(cell(t, inside(p["y"] + a), inside(p["x"] + b)), lambda c: mapped(c, p["v"]))
            return held(F.rint((at(0, 0) * (1 - p["ax"]) + at(0, 1) * p["ax"]) * (1 - p["ay"]) + (at(1, 0) * (1 - p["ax"]) + at(1, 1) * p["ax"]) * p["ay"]))

        return then(where, mixed)

    return then(tile, lambda t: _each(side, lambda y, x: value(t, y, x)))


def tan_triggs(tile: Column, side: int, by: float = 0.2, inner: float = 1.0, outer: float = 2.0, tau: float = 10.0, alpha: float = 0.1) -> Column:
    """Gamma, difference of Gaussians and contrast equalization in two steps (Tan and Triggs 2010); -tau..tau becomes 0..255
    for every image alike."""
    x = F.transform(tile, lambda v: F.pow(F.greatest(v / 255.0, F.lit(1e-6)), F.lit(by)))
    x = then(x, lambda t: F.zip_with(smoothed(t, side, gaussian(inner)), smoothed(t, side, gaussian(outer)), lambda a, b: a - b))
    scale = lambda v, most: F.pow(mean(F.transform(v, lambda u: F.pow(F.least(F.abs(u), F.lit(most)), F.lit(alpha)))) + 1e-10, F.lit(1 / alpha))
    divided = lambda v, most: then(F.struct(v.alias("v"), scale(v, most).alias("by")), lambda s: F.transform(s["v"], lambda e: e / s["by"]))
    x = then(then(x, lambda v: divided(v, float("inf"))), lambda v: divided(v, tau))
    return F.transform(x, lambda v: held((tau * F.tanh(v / tau) + tau) * (255.0 / (2 * tau))))


def shrunk(tile: Column, side: int, longest: int) -> Column:
    """Means of areas, so that a side has `longest` pixels; smaller images stay. side must be a multiple of it."""
    if side <= longest:
        return tile
    n = side // longest
    pixel = lambda t, y, x: F.rint(sum((F.get(t, ((y * n + a) * side + x * n + b).cast("int")).cast("double") for a in range(n) for b in range(n)), F.lit(0.0)) / (n * n)).cast("int")
    return then(tile, lambda t: _each(longest, lambda y, x: pixel(t, y, x)))


def binary_patterns(tile: Column, side: int, neighbours: int = 8) -> Column:
    """Codes of the inner pixels, (side - 2) a row: bit k is set where the pixel at angle k on the circle of radius one is no
    darker (Ahonen et al. 2006); between pixels it is interpolated."""

    def code(t: Column, i: Column) -> Column:
        y, x = F.floor(i / (side - 2)).cast("int") + 1, (i % (side - 2)).cast("int") + 1
        own, out = _at(t, side, y, x), F.lit(0)
        for k in range(neighbours):
            dy, dx = round(-math.sin(2 * math.pi * k / neighbours), 12), round(math.cos(2 * math.pi * k / neighbours), 12)
            y0, x0 = math.floor(dy), math.floor(dx)
            fy, fx = dy - y0, dx - x0
            parts = {(y0, x0): (1 - fy) * (1 - fx), (y0, x0 + 1): (1 - fy) * fx, (y0 + 1, x0): fy * (1 - fx), (y0 + 1, x0 + 1): fy * fx}
            v = sum((w * _at(t, side, y + a, x + b) for (a, b), w in parts.items() if w), F.lit(0.0))
            out = out + F.when(v - own > -1e-7, 1 << k).otherwise(0)
        return out

    return then(tile, lambda t: F.transform(F.sequence(F.lit(0), F.lit((side - 2) ** 2 - 1)), lambda i: code(t, i)))
