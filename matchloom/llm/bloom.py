"""Blocked Bloom filters as tables: a row per block of 256 bits, so that a key is one equality join away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a block, hash functions, and keys per block: about one false positive in a thousand.
BLOCK_WORDS, HASHES, PER_BLOCK = 4, 6, 16


def bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and, for each 64-bit word of it, the mask of bits that the key sets."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    h = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * BLOCK_WORDS)) for i in range(1, HASHES + 1)]
    words = []
    for w in range(BLOCK_WORDS):
        mask = F.lit(0).cast("long")
        for x in h:
            mask = mask.bitwiseOR(F.when(F.floor(x / 64) == w, F.expr("1L")).otherwise(F.expr("0L")) * F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int")))
        words.append(mask)
    return block, words


def blocks_for(count: int) -> int:
    return max(1, -(-count // PER_BLOCK))


def size_of(blocks: int) -> int:
    """Bytes of a filter of so many blocks."""
    return blocks * (BLOCK_WORDS + 1) * 8


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block that holds anything: __block, __w0.. of keys[key]."""
    block, words = bits(F.col(key), blocks)
    return keys.select(block.alias("__block"), *[w.alias(f"__w{i}") for i, w in enumerate(words)]).groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(BLOCK_WORDS)])


def flagged(rows: DataFrame, key: str, filter_: DataFrame, blocks: int, flag: str) -> DataFrame:
    """rows with a column that tells whether the key may be in the filter. Null keys are hashed like others."""
    block, words = bits(F.col(key), blocks)
    out = rows.withColumn("__block", block).join(filter_, "__block", "left")
    maybe = F.col("__w0").isNotNull()
    for i, w in enumerate(words):
        maybe = maybe & (F.coalesce(F.col(f"__w{i}"), F.lit(0)).bitwiseAND(w) == w)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], maybe.alias(flag))


def passing(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter; columns as they are."""
    return flagged(rows, key, filter_, blocks, "__maybe").where("__maybe").drop("__maybe")
