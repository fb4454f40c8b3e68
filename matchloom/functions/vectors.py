"""Dense vectors as arrays of doubles: distances, norms, quantization. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Stored floats in double precision, before any arithmetic."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def decimals(x: Column, n: int) -> Column:
    """x to n decimals as SQL rounds doubles: x * 10^n to the nearest whole number, halves away from zero. What comes to zero keeps its sign,
    which F.round() drops: -1e-9 becomes -0.0."""
    r = F.round(x * float(10**n), 0) / float(10**n)
    return F.when(r == 0, x * 0.0).otherwise(r)


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)^2 / (a + b + 1e-10)."""
    return 0.5 * _fold(a, b, lambda x, y: (x - y) * (x - y) / (x + y + F.lit(1e-10)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of any two vectors, with 1e-9 added to the norms."""
    return dot(a, b) / ((norm(a) + F.lit(1e-9)) * (norm(b) + F.lit(1e-9)))


def unit(v: Column) -> Column:
    """Scaled to length one; vectors no longer than 1e-12 stay as they are."""
    n = norm(v)
    return F.when(n > F.lit(1e-12), F.transform(v, lambda x: x / n)).otherwise(v)


def l2_from_cosine(c: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * c))


def l2_by_gram(a: Column, b: Column) -> Column:
    """From squared norms and the product; loses digits near zero."""
    return F.sqrt(F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b)))


def whiten(v: Column, scale: Column, drop_first: int) -> Column:
    """Without its first components, the rest divided by scale, then of length one."""
    return unit(F.slice(F.zip_with(v, scale, lambda x, s: x / s), drop_first + 1, F.size(v) - drop_first))


def to_uint8(v: Column, scale: float = 1.0, shift: float = 0.0) -> Column:
    """(x + shift) * scale rounded half to even, held to 0..255."""
    return F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((x + shift) * scale).cast("int"))))


def truncated_uint8(v: Column) -> Column:
    """Held to 0..255, then cut to whole numbers."""
    return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("int"))


#: First and last column kept, by row of the grid: eyes in rows 2 and 3, nose in 4 and 5, mouth in 6.
LANDMARK_COLUMNS, GRID = {2: (1, 6), 3: (1, 6), 4: (2, 5), 5: (2, 5), 6: (2, 5)}, 8


def landmark_cells(v: Column, bins: int = 1) -> Column:
    """Of a vector with `bins` values for each cell of the grid, row by row, those of the cells at landmarks."""
    runs = [F.slice(v, (row * GRID + first) * bins + 1, (last - first + 1) * bins) for row, (first, last) in LANDMARK_COLUMNS.items()]
    return F.concat(*runs)
