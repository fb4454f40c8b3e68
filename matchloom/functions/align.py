"""Similarity transforms of landmarks to a template, robust to wrong landmarks, for batches of rows."""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Eyes, nose and corners of the mouth in a face image of 112 pixels.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
SIDE = 112
#: How many robust deviations an inlier may be off, and least.
DEVIATIONS, SPREAD, LEAST = 2.5, 1.4826, 0.001


def least_median(points: Column, side: float = SIDE) -> Column:
    """Struct a, b, tx, ty, inliers of the similarity (x, y) -> (a x - b y + tx, b x + a y + ty) that takes points (array of struct x, y, in
    the template's order) to the template for images of `side` pixels: of all pairs of points the one whose similarity has the least median of
    squared residuals, then least squares over its inliers. Null if points aren't as many as the template's or all pairs coincide."""
    to = [(x * side / SIDE, y * side / SIDE) for x, y in TEMPLATE]
    keys = ("a", "b", "tx", "ty")

    @F.arrow_udf("struct<a double, b double, tx double, ty double, inliers int>")
    def fit(rows: pa.Array) -> pa.Array:
        points, n = rows.filter(rows.is_valid()).flatten(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        both = [pc.fill_null(pc.cast(pc.struct_field(points, c), pa.float64()), pa.scalar(np.nan)).to_numpy(zero_copy_only=False) for c in ("x", "y")]
        missing = np.zeros(len(points), bool)
        for a in (points, *(pc.struct_field(points, c) for c in ("x", "y"))):
            missing |= a.is_null().to_numpy(zero_copy_only=False)
        whole = n == len(to)
        at = (np.cumsum(n) - n)[whole, None] + np.arange(len(to))
        some = np.zeros(0, bool) if not len(at) else ~missing[at].any(1)
        whole[whole], at = some, at[some]
        got, there = _similarities(both[0][at], both[1][at], to) if len(at) else (np.empty((5, 0)), np.empty(0, bool))
        whole[whole] = there
        out = np.zeros((5, len(rows)))
        out[:, whole] = got[:, there]
        columns = [pa.array(c) for c in out[:4]] + [pa.array(out[4].astype(np.int32))]
        return pa.StructArray.from_arrays(columns, names=[*keys, "inliers"], mask=pa.array(~whole))

    return fit(points)


def _similarities(x: np.ndarray, y: np.ndarray, to: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """a, b, tx, ty and inliers of each row of landmarks, and which rows have a pair of different ones."""
    n = len(to)

    def squares(m: tuple) -> np.ndarray:
        a, b, tx, ty = m
        out = np.empty((n, len(x)))
        for i, (u, v) in enumerate(to):
            du, dv = a * x[:, i] - b * y[:, i] + tx - u, b * x[:, i] + a * y[:, i] + ty - v
            out[i] = du * du + dv * dv
        return out

    found = []
    with np.errstate(all="ignore"):
        for i, j in combinations(range(n), 2):
            dx, dy = x[:, j] - x[:, i], y[:, j] - y[:, i]
            du, dv = to[j][0] - to[i][0], to[j][1] - to[i][1]
            length = dx * dx + dy * dy
            a, b = (dx * du + dy * dv) / length, (dx * dv - dy * du) / length
            m = (a, b, to[i][0] - a * x[:, i] + b * y[:, i], to[i][1] - b * x[:, i] - a * y[:, i])
            found.append((length == 0, np.sort(squares(m), 0)[n // 2], *m))
        none, *ordered = (np.stack(z) for z in zip(*found))
        first = np.lexsort((*ordered[::-1], none), axis=0)[0]
        median, *m = (z[first, np.arange(len(x))] for z in ordered)
        limit = np.maximum(LEAST, DEVIATIONS * SPREAD * (1 + 5.0 / (n - 2)) * np.sqrt(median))
        w = (squares(tuple(m)) <= limit * limit).astype(float)
        total = lambda f: sum((w[i] * f(i) for i in range(n)), np.zeros(len(x)))
        k = total(lambda i: 1.0)
        mx, my, mu, mv = total(lambda i: x[:, i]) / k, total(lambda i: y[:, i]) / k, total(lambda i: to[i][0]) / k, total(lambda i: to[i][1]) / k
        xs, ys, us, vs = ([c(i) - middle for i in range(n)] for c, middle in ((lambda i: x[:, i], mx), (lambda i: y[:, i], my), (lambda i: to[i][0], mu), (lambda i: to[i][1], mv)))
        q = total(lambda i: xs[i] * xs[i] + ys[i] * ys[i])
        a = total(lambda i: xs[i] * us[i] + ys[i] * vs[i]) / q
        b = total(lambda i: xs[i] * vs[i] - ys[i] * us[i]) / q
    return np.stack([a, b, mu - a * mx + b * my, mv - b * mx - a * my, k]), ~none.all(0)
