"""Connected components of an edge table, as Spark jobs.

Tasks first reduce batches of edges to forests of depth one. Then large star and small star steps (Kiveris et al. 2014)
follow until the edges form stars. The least neighbour of a node is an aggregation, which combines before the shuffle, and
goes back to the edges by a join whose large partitions Spark can split: a node with very many edges is no group
of one task. Results of a round are written to the shared folder, which cuts lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import ship, tidied, written

#: Edges that a task reduces at a time.
LOCAL = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (label[x] != label[y]).any():
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def reduced(edges: DataFrame) -> DataFrame:
    """Fewer edges a > b that connect the same nodes, batch by batch."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= LOCAL:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    def joined(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], ["a", "b"])

    return edges.select("a", "b").mapInArrow(tidied(run, LOCAL), "a long, b long")


def are_stars(e: DataFrame) -> bool:
    """Whether no node of e(a, b) has both a smaller and a larger neighbour, and none has two smaller ones."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up + down > 1").take(1)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for each node of edges(a, b), loops aside. No edges: no rows."""
    e = written(reduced(edges.where("a <> b")).distinct())
    for _ in range(most_rounds):
        if are_stars(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # minima are written first: a join of two plain shuffles is one whose partitions can be split
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = large.join(written(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = written(reduced(small.where("a <> b")).distinct())
    raise RuntimeError(f"no stars after {most_rounds} rounds")
