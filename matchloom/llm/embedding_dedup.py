"""Near duplicates among embeddings: a navigable small-world graph per shard, every shard queried.

Equal vectors are one class with a weight. Classes are dealt to shards by hash, of at most SHARD classes; each shard
gets a graph and a beam, doubled until an audit (queries at exactly the threshold to known points) reaches RECALL. Every pair
of shards is one task, which searches each shard's graph with the other's vectors. A query whose beam is full of
links is searched again with a wider one, and by a scan beyond WIDEST, so no group is cut off. What is found from
either side counts, once cosine in double precision confirms it. Tasks return a number of links and a component root
per class, not pairs; roots are united by components().

Work grows with the number of shards times the number of vectors, as the method asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import hnsw
from matchloom.llm.common import ship, table, written
from matchloom.llm.components import components
from matchloom.llm.vectors import doubles, matrix, per_group, usable

SHARD, LEAST_SHARD, RECALL, WIDEST, SLACK, MOST_PAIRS = 10_000, 1500, 0.998, 1024, 1e-4, 8_000_000

_INDEX = "dim int, shard int, ids binary, weights binary, vectors binary, layers array<binary>, beam int"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that large and small components neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def index_shards(classes: DataFrame, similarity: float) -> DataFrame:
    """A row per shard of classes(grp, dim, shard, cls, weight, v): its vectors, its graph's links and its beam."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        v = matrix(t["v"])
        g = hnsw.build(unit(v).astype(np.float32))
        beam = hnsw.audited_beam(g, similarity, RECALL)
        one = lambda x, kind: pa.array([x], kind)
        yield pa.RecordBatch.from_arrays(
            [
                one(t["dim"][0].as_py(), pa.int32()), one(t["shard"][0].as_py(), pa.int32()), one(t["cls"].to_numpy().astype(np.int64).tobytes(), pa.binary()), one(t["weight"].to_numpy().astype(np.int64).tobytes(), pa.binary()),
                one(v.tobytes(), pa.binary()), one([x.tobytes() for x in g.layers], pa.list_(pa.binary())), one(beam, pa.int32()),
            ],
            ["dim", "shard", "ids", "weights", "vectors", "layers", "beam"],
        )

    return per_group(classes.select("grp", "dim", "shard", "cls", "weight", "v"), "grp", solve, _INDEX, "cls")


class Shard:
    def __init__(self, row: dict):
        self.ids, self.weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.unit = unit(np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1))
        x = self.unit.astype(np.float32)
        self.graph = hnsw.Graph(x, [np.frombuffer(b, np.int32).reshape(-1, hnsw.M0 if i == 0 else hnsw.M) for i, b in enumerate(row["layers"])])
        self.beam = row["beam"]


def candidates(s: Shard, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of q, points of s) that searches find at the similarity or above, chunk by chunk."""
    todo, beam = np.arange(len(q)), s.beam
    while len(todo) and 0 < beam <= min(WIDEST, len(s.ids) // 4):
        ids, sims = s.graph.near(q[todo], beam)
        full = sims[:, -1] >= least
        hit = (sims >= least) & ~full[:, None] & (ids >= 0)
        r, c = np.nonzero(hit)
        yield todo[r], ids[r, c]
        todo, beam = todo[full], beam * 2
    for i in range(0, len(todo), 512):
        r, c = np.nonzero(q[todo[i : i + 512]] @ s.graph.x.T >= least)
        yield todo[i : i + 512][r], c


class Links:
    """Links between points of a and of b: sorted pairs, or a table where there are more than MOST_PAIRS."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.pairs, self.count, self.full = shape, [], 0, None

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        if self.full is not None:
            self.full[r, c] = True
            return
        self.pairs.append(r.astype(np.int64) * self.shape[1] + c)
        self.count += len(r)
        if self.count > MOST_PAIRS:
            self.full = np.zeros(self.shape, bool)
            for p in self.pairs:
                self.full.ravel()[p] = True
            self.pairs = []

    def chunks(self, turned: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs once each, in order of the first of the two; b's points come first if turned."""
        if self.full is not None:
            t = self.full.T if turned else self.full
            for i in range(0, len(t), 512):
                r, c = np.nonzero(t[i : i + 512])
                yield r + i, c
            return
        codes = np.unique(np.concatenate(self.pairs)) if self.pairs else np.empty(0, np.int64)
        r, c = np.divmod(codes, self.shape[1])
        if turned:
            order = np.argsort(c, kind="stable")
            r, c = c[order], r[order]
        yield r, c


def links(a: Shard, b: Shard, similarity: float, same: bool) -> Links:
    """The confirmed links between the points of a and of b; both ways if they are the same shard."""
    found, out = Links((len(a.ids), len(b.ids))), Links((len(a.ids), len(b.ids)))
    for r, c in candidates(b, a.graph.x, similarity - SLACK):
        found.add(r, c)
        if same:
            found.add(c, r)
    if not same:
        for r, c in candidates(a, b.graph.x, similarity - SLACK):
            found.add(c, r)
    for rows, cols in found.chunks():
        for k in range(0, len(rows), 50_000):
            r, c = rows[k : k + 50_000], cols[k : k + 50_000]
            ok = np.einsum("nd,nd->n", a.unit[r], b.unit[c]) >= similarity
            if same:
                ok &= r != c
            out.add(r[ok], c[ok])
    return out


def roots(found: Links, a_ids: np.ndarray, b_ids: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable by the links from each point of either side."""
    la = a_ids.copy()
    lb = la if same else b_ids.copy()
    while True:
        before = la.copy(), lb.copy()
        for side, other, turned in ((la, lb, False), (lb, la, True)):
            for r, c in found.chunks(turned):
                if len(r):
                    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    side[r[starts]] = np.minimum(side[r[starts]], np.minimum.reduceat(other[c], starts))
        if (before[0] == la).all() and (before[1] == lb).all():
            return la, lb


def linked_classes(index: DataFrame, shards: int, similarity: float) -> DataFrame:
    """cls, links, root: a row per class and pair of shards in which it has links."""
    pairs = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = pairs.withColumn("pair", F.xxhash64("dim", F.least("shard", "other"), F.greatest("shard", "other"))).withColumn("same", F.col("shard") == F.col("other"))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = t.to_pylist()
        if len(rows) == 1 and not rows[0]["same"]:
            return  # the other shard has no vectors of this length
        a, same = Shard(rows[0]), rows[0]["same"]
        b = a if same else Shard(rows[1])
        found = links(a, b, similarity, same)
        la, lb = roots(found, a.ids, b.ids, same)
        for side, root, turned, other in ((a, la, False, b), (b, lb, True, a))[: 1 if same else 2]:
            n = np.zeros(len(side.ids), np.int64)
            for r, c in found.chunks(turned):
                n += np.bincount(r, other.weights[c], len(n)).astype(np.int64)
            has = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(side.ids[has]), pa.array(n[has]), pa.array(root[has])], ["cls", "links", "root"])

    return per_group(pairs.select("pair", "shard", "same", "ids", "weights", "vectors", "layers", "beam"), "pair", solve, "cls long, links long, root long", "shard")


def near_duplicates(vectors: DataFrame, similarity: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths; long vectors are compared whole. A pair at exactly the similarity is linked, and so are rows with
    equal vectors, among them repeated rows. component_id is the smallest vec_id reachable; rows without vec_id are linked
    like others and count, but a component has their null only if no member has an id. An empty table gives no rows.
    Other columns are not read."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", F.when(usable(F.col("embedding")), doubles(F.col("embedding"))).alias("v")).withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("cls", F.xxhash64("v")).withColumn("dim", F.size("v")))
    count = classes.count()
    shards = max(-(-count // SHARD), min(spark.sparkContext.defaultParallelism, -(-count // LEAST_SHARD)), 1)
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(shards)).cast("int")).withColumn("grp", F.xxhash64("dim", "shard"))
    index = written(index_shards(dealt, similarity))
    found = written(linked_classes(index, shards, similarity))
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    nodes = classes.select("cls", "rep", "weight").join(totals, "cls", "left").join(comps, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(least, "root").select("cls", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    known = rows.where("cls is not null").select("vec_id", "cls").join(nodes, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all vectors; see near_duplicates() for odd rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)
