"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

On a bounded sample (SAMPLE vectors, by hash) principal axes and rotations of them are learned so that signs lose
least (iterative quantization, Gong and Lazebnik 2011), several rotations making BITS bits. Every vector is encoded.
A code is split into SUBSTRINGS, each with an index from value to codes. Codes within radius r = a * SUBSTRINGS + b of a
query agree with one of its first b + 1 substrings up to a bits or with another up to a - 1 (pigeonhole), so probing those
values retrieves every code within r. Each query has a radius of its own: the one within which `share` of the
sample's codes lie, a share that holds RECALL of the true neighbours for queries from the sample. So neither a query in a
crowd nor one on its own gets more than its part to rank. What is retrieved is ranked by distance in double
precision. Queries that retrieve fewer than asked for are searched again at full radius.

Rows and queries meet in blocks of bounded size: each block of rows is searched by each block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import ship, table, tidied, written
from matchloom.llm.vectors import doubles, matrix, per_group, usable

SAMPLE, AXES, BITS, SUBSTRINGS, RECALL, ROUNDS = 20_000, 64, 512, 8, 0.985, 25
ROWS, QUERIES, LEAST_ROWS, SLACK = 16_384, 2048, 1500, 1e-6
#: Codes as whole numbers, one for each substring.
_WORD = {16: np.uint16, 32: np.uint32, 64: np.uint64}[BITS // SUBSTRINGS]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes, substring by substring along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class Codes:
    """Centre and projection of vectors of one length, the sample's codes, and the share of codes to retrieve."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 0):
        self.centre = sample.mean(0)
        x = sample - self.centre
        _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
        axes = axes[:, ::-1][:, :AXES]
        low, rng, parts = x @ axes, np.random.default_rng(seed), []
        while sum(p.shape[1] for p in parts) < BITS:
            r = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
            for _ in range(ROUNDS):
                u, _, vt = np.linalg.svd(np.where(low @ r >= 0, 1.0, -1.0).T @ low)
                r = (u @ vt).T
            parts.append(axes @ r)
        self.projection = np.concatenate(parts, 1)[:, :BITS]
        self.sample = self.encode(sample)
        self.share = self._share(sample, k)

    def _share(self, sample: np.ndarray, k: int) -> float:
        """Share of codes that lie as near as RECALL of the sample's nearest neighbours do (of at most 1000 queries)."""
        n = len(sample)
        if n < 4 * k:
            return 1.0
        asked, norms, shares = np.arange(0, n, max(1, n // 1000))[:1000], (sample**2).sum(1), []
        for i in range(0, len(asked), 100):
            at = asked[i : i + 100]
            far = norms[None, :] - 2 * sample[at] @ sample.T
            far[np.arange(len(at)), at] = np.inf
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            for q, own in zip(at, near):
                d = distances(self.sample, self.sample[q])
                shares.append(np.searchsorted(np.sort(d), d[own], "right") / n)
        return float(np.quantile(np.concatenate(shares), RECALL))

    def radii(self, code: np.ndarray) -> np.ndarray:
        """For each code the distance within which `share` of the sample's codes lie."""
        k = min(len(self.sample), int(np.ceil(self.share * len(self.sample)))) - 1
        return np.array([BITS if self.share >= 1 else np.partition(distances(self.sample, c), k)[k] for c in code], np.int32)

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.packbits((v - self.centre) @ self.projection >= 0, axis=1).view(_WORD)


def fit(vectors: DataFrame, k: int) -> dict[int, Codes]:
    """Codes by vector length, from the SAMPLE rows of vectors(vec_id, v) that come first by hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    lengths = np.diff(np.asarray(rows.offsets)) if len(rows) else np.empty(0, int)
    return {int(n): Codes(matrix(rows.filter(pa.array(lengths == n))), k) for n in np.unique(lengths)}


def encoded(vectors: DataFrame, model: dict[int, Codes]) -> DataFrame:
    """vectors(vec_id, v) with dim, code and radius; lengths that the sample lacks get codes of zeros, at distance 0 of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            lengths = np.diff(np.asarray(v.offsets))
            code, radius = np.zeros((len(v), SUBSTRINGS), _WORD), np.full(len(v), BITS, np.int32)
            for n in np.unique(lengths):
                if int(n) in model:
                    at = lengths == n
                    code[at] = model[int(n)].encode(matrix(v.filter(pa.array(at))))
                    asked = at & np.asarray(b.column(2))
                    radius[asked] = model[int(n)].radii(code[asked])
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(lengths, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(radius)], ["vec_id", "v", "dim", "code", "radius"])

    asks = F.col("asks") if "asks" in vectors.columns else F.lit(False)
    return vectors.select("vec_id", "v", asks.alias("asks")).mapInArrow(tidied(run, 4096), f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<double>, dim int, code binary, radius int")


class Index:
    """For each substring the codes in order of its value, and where each value starts."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order = np.argsort(code, axis=0, kind="stable").astype(np.int32)
        self.values = [np.unique(code[:, s], return_counts=True) for s in range(SUBSTRINGS)]
        self.probed = 0

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all codes at most `radius` from q."""
        hit = np.zeros(len(self.code), bool)
        most, first = divmod(radius, SUBSTRINGS)
        for s, (values, counts) in enumerate(self.values):
            near = np.bitwise_count(values ^ q[s]) <= most - (s > first)
            if near.any():
                hit[self.order[np.repeat(near, counts), s]] = True
        at = np.flatnonzero(hit)
        self.probed += len(at)
        return at[distances(self.code[at], q) <= radius]


def nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of v nearest to q, ties to smaller ids: positions and distances."""
    d = ((v - q) ** 2).sum(1) if len(v) <= 4 * k else (v**2).sum(1) - 2 * (v @ q) + (q**2).sum()
    if len(v) > 4 * k:  # the short formula only sorts out what is far
        edge = np.partition(d, k - 1)[k - 1]
        few = np.flatnonzero(d <= edge + SLACK * (abs(edge) + (q**2).sum() + 1e-300))
    else:
        few = np.arange(len(v))
    exact = np.sqrt(((v[few] - q) ** 2).sum(1))
    first = np.lexsort((ids[few], exact))[:k]
    return few[first], exact[first]


def in_blocks(rows: DataFrame, queries: DataFrame, k: int, full: bool = False) -> DataFrame:
    """query_id, vec_id, score: for each query the k nearest retrieved in each block of rows."""
    spark = rows.sparkSession
    n, m = rows.count(), queries.count()
    row_blocks = max(1, -(-n // ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    query_blocks = max(1, -(-m // QUERIES))
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")
    a = rows.withColumn("r", own(row_blocks)).withColumn("q", all_of(query_blocks)).withColumn("kind", F.lit(0))
    b = queries.withColumn("q", own(query_blocks)).withColumn("r", all_of(row_blocks)).withColumn("kind", F.lit(1))
    both = a.unionByName(b).withColumn("grp", F.xxhash64("dim", "r", "q")).select("grp", "kind", "vec_id", "v", "code", "radius")
    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = t["kind"].to_numpy()
        v, ids = matrix(t["v"]), t["vec_id"].to_numpy()
        code = np.frombuffer(b"".join(t["code"].to_pylist()), _WORD).reshape(-1, SUBSTRINGS)
        radius = t["radius"].to_numpy()
        q, v_rows, id_rows = np.flatnonzero(kind == 1), v[kind == 0], ids[kind == 0]
        if not len(q) or not len(v_rows):
            return
        index = Index(code[kind == 0])
        out: tuple[list, list, list] = ([], [], [])
        for i in q:
            at = index.within(code[i], BITS if full else int(radius[i]))
            at = at[id_rows[at] != ids[i]]
            first, d = nearest(v[i], v_rows[at], id_rows[at], k)
            for held, new in zip(out, (np.full(len(first), ids[i]), id_rows[at][first], d)):
                held.append(new)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return per_group(both, "grp", solve, "query_id long, vec_id long, score double", "kind")


def top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance for each row of queries(vec_id,
    embedding) among vectors(vec_id, embedding), nearest first, ties to smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no part;
    vectors of other lengths are no candidates. A row with the query's vec_id is its own. Rows that repeat another are
    candidates of their own, so a result may hold them several times; queries that repeat a vec_id count once. Long
    vectors are compared whole. No rows or no queries give no rows. Other columns are not read."""
    ship(vectors.sparkSession)
    clean = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), doubles(F.col("embedding")).alias("v"))
    rows = clean(vectors)
    model = fit(rows, k)
    rows = written(encoded(rows, model))
    asked = written(encoded(clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("asks", F.lit(True)), model))
    first = written(in_blocks(rows, asked, k))
    short = asked.join(first.groupBy("query_id").agg(F.count("*").alias("n")), F.col("query_id") == F.col("vec_id"), "left").where(f"coalesce(n, 0) < {k}").select(asked.columns)
    short = written(short)
    if short.take(1):
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(in_blocks(rows, short, k, full=True))
    return top(first, k)


def op9_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches all vectors for the 10 nearest of every hundredth; see search() for odd rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"), 10)
