"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.shared import scratch_dir

#: A word is a run of anything but ASCII white space (regular expression).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text, and rows, that a task holds as Python objects at a time; single texts may be longer.
MOST_BYTES, MOST_ROWS = 4 << 20, 500
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def written(df: DataFrame, *keys: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it: added once per context. Where the session
    doesn't bound Arrow batches by size, they get MOST_BYTES, as texts may be long."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(MOST_BYTES))
    root = Path(__file__).resolve().parents[2]
    if getattr(sc, "_matchloom_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="matchloom-")) / "matchloom_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "matchloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(os.fspath(out))
    sc._matchloom_shipped = True


def parallelism(spark: SparkSession) -> int:
    """Tasks that the session means to run at a time, or per shuffle."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = MOST_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches cut into ones of at most `rows` rows and, but for single rows, MOST_BYTES of text."""
    for b in batches:
        held = np.zeros(b.num_rows)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                held += np.asarray(pc.fill_null(pc.binary_length(c), 0))
        at = 0
        total = np.cumsum(held)
        while at < b.num_rows:
            before = total[at - 1] if at else 0
            n = max(1, min(rows, int(np.searchsorted(total, before + MOST_BYTES, "right")) - at))
            yield b.slice(at, n)
            at += n


def release() -> None:
    """Gives free memory of Arrow and of the C library back, as Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = MOST_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run() for mapInArrow on batches of bounded size; the worker is left without what it held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches, rows))
        finally:
            release()

    return wrapped
