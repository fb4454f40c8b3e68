"""What the vector operators share: which vectors count, classes of equal vectors, rows of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import release


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and no component null, infinite or not a number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def doubles(v: Column) -> Column:
    """In double precision, with one kind of zero."""
    return F.transform(v.cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of doubles as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def per_group(rows: DataFrame, key: str, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """solve() for the rows of each value of key, a table at a time; groups must be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            release()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if held and keys[i] != at:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                at = keys[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from solve(pa.Table.from_batches(held))

    first = rows.select(key, *[c for c in rows.columns if c != key])
    return first.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
