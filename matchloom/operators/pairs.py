"""Joins of everything with everything, by blocks.

Rows are dealt to blocks by hash; a pair of blocks is one key of an equality join. So the work is spread evenly over
tasks, no side is broadcast, and the number of copies of a row is the number of blocks, which is chosen by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most; blocks at least; rows and bytes that a broadcast side may have.
BLOCK_ROWS, LEAST_BLOCKS, BROADCAST_ROWS, BROADCAST_BYTES = 4096, 4, 50_000, 128 << 20
#: Rows of a tile done at once, few enough for a core's cache.
STRIP = 32


def blocks_for(rows: int) -> int:
    return max(LEAST_BLOCKS, -(-rows // BLOCK_ROWS))


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def unique_pairs(df: DataFrame, key: str, left: str = "a_", right: str = "b_", within: str | None = None) -> DataFrame:
    """Each pair of rows with different keys once, the smaller key on the left; only of rows that agree in `within`, if given."""
    n = blocks_for(df.count())
    own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = df.withColumn("__own", own)
    a = named(rows.withColumn("__i", F.col("__own")).withColumn("__j", F.explode(F.sequence(F.col("__own"), F.lit(n - 1)))), left)
    b = named(rows.withColumn("__j", F.col("__own")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__own")))), right)
    agree = F.col(left + within) == F.col(right + within) if within else F.lit(True)
    met = a.join(b, agree & (F.col(f"{left}__i") == F.col(f"{right}__i")) & (F.col(f"{left}__j") == F.col(f"{right}__j")) & ((F.col(f"{left}__i") < F.col(f"{left}__j")) & (F.col(left + key) != F.col(right + key)) | (F.col(left + key) < F.col(right + key))))
    right_way = F.col(left + key) < F.col(right + key)
    out = []
    for c in df.columns:
        x, y = F.col(f"`{left}{c}`"), F.col(f"`{right}{c}`")
        out += [F.when(right_way, x).otherwise(y).alias(left + c), F.when(right_way, y).otherwise(x).alias(right + c)]
    return met.select(*out)


def ordered_pairs(df: DataFrame, key: str, left: str = "a_", right: str = "b_") -> DataFrame:
    """Each pair of rows with different keys, in both orders."""
    p = unique_pairs(df, key, left, right)
    swapped = p.select(*[F.col(f"`{right}{c}`").alias(left + c) for c in df.columns], *[F.col(f"`{left}{c}`").alias(right + c) for c in df.columns])
    return p.unionByName(swapped)


def distance_stats(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    """pairs, total, squares, smallest, largest of the Euclidean distances of all unique pairs: matrix products per pair of
    blocks, of which a row each leaves the tasks. Squares near zero, where the short formula loses digits, are redone."""
    import numpy as np
    import pyarrow as pa

    n = blocks_for(df.count())
    own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(v).alias("v"), own.alias("own"))
    a = rows.select(F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(n - 1))).alias("j"), "id", "v")
    # columns of its own, or Spark takes both sides' for the same
    b = rows.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), (F.col("id") + 0).alias("jd"), F.transform("v", lambda z: z).alias("w"))

    def solve(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = [np.asarray(t.column(3).combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 0)) for t in (left, right)]
        ids, jds = left.column(2).to_numpy(), right.column(2).to_numpy()
        same = keys[0].as_py() == keys[1].as_py()
        count, total, squares, low, high = 0, 0.0, 0.0, np.inf, -np.inf
        yy, turned = (y * y).sum(1), np.ascontiguousarray(-2 * y.T)
        for k in range(0, len(x) if len(y) else 0, STRIP):
            q = x[k : k + STRIP]
            sq = q @ turned
            sq += (q * q).sum(1)[:, None]
            sq += yy
            r, c = np.nonzero(sq < 1e-4)
            sq[r, c] = ((q[r] - y[c]) ** 2).sum(1)  # of equal rows the product may come to less than zero
            sq = sq[ids[k : k + STRIP][:, None] < jds[None, :]] if same else sq
            if sq.size:
                d = np.sqrt(sq)
                count, total, squares, low, high = count + d.size, total + d.sum(), squares + sq.sum(), min(low, d.min()), max(high, d.max())
        return pa.table({"pairs": [count], "total": [total], "squares": [squares], "smallest": [low if count else None], "largest": [high if count else None]})

    part = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(solve, "pairs long, total double, squares double, smallest double, largest double")
    return part.agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def each_with_each(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of left with every row of right: a side of at most BROADCAST_ROWS rows and BROADCAST_BYTES is broadcast, else both are dealt to blocks."""
    wide = [8 * F.size(F.col(f"`{c}`")) if kind.startswith("array") else F.octet_length(F.col(f"`{c}`")) if kind in ("string", "binary") else F.lit(8) for c, kind in right.dtypes]
    rows, size = right.agg(F.count("*"), F.sum(sum((F.greatest(F.coalesce(w, F.lit(0)), F.lit(8)) for w in wide), F.lit(16)))).first()
    if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        return left.crossJoin(F.broadcast(right))
    n = max(blocks_for(rows), -(-(size or 0) // BROADCAST_BYTES))
    a = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return a.join(right.withColumn("__block", F.pmod(F.xxhash64(*right.columns), F.lit(n)).cast("int")), "__block").drop("__block")


def best(pairs: DataFrame, group: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """For each group the row that comes first, by one aggregation (no window): order and take are of sortable types."""
    packed = F.min(F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], *[F.col(c) for c in take])).alias("__best")
    return pairs.groupBy(*group).agg(packed).select(*group, *[F.col(f"__best.{c}").alias(c) for c in take])
