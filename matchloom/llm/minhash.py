"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is SYMBOLS minima, each kept as b = 16 bits. Two signatures differ in d symbols; for sets of
Jaccard similarity t, d is binomial with mean (1 - t) * SYMBOLS, and `radius(t)` is the distance that fewer than one
pair in a million at t exceeds. Signatures are split into so many chunks that within the radius some chunk has at most
one wrong symbol (pigeonhole); every chunk is indexed once for each place at which it may be wrong, by its
remaining symbols. So all pairs within the radius share a key, whatever else is in the tables.

Documents with equal sets are one class. Classes that share a key are a bucket. Within it, classes whose signatures lie
within the radius are joined, and the components of those edges are candidate groups. In buckets of over BUCKET
classes all are compared with one class first, row by row; those that are far from it meet all others in blocks. A group is compared in blocks of bounded size: signatures first, then full sets,
skipping what is connected already. Groups of more than one block get hubs that
stand in all of their blocks; afterwards only blocks with different components meet. No pair leaves a task but the
edges of a forest. Nothing is capped: a pair within the radius is confirmed on its full sets or known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm import bloom
from matchloom.llm.common import ship, table, tidied, written
from matchloom.llm.components import components
from matchloom.llm.vectors import per_group

WORDS, SYMBOLS, MISSED = 5, 64, 1e-6
#: A block has at most so many classes and, but for single giants, shingles; hubs of a group of more blocks.
BLOCK, BLOCK_SHINGLES, HUBS, FILTER_BYTES, BUCKET = 1024, 4_000_000, 8, 24 << 20, 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(range(256)).lower()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread results (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE, _XOR, _TIMES, _WRONG = _numbers(WORDS, 1) | np.uint64(1), _numbers(SYMBOLS, 2), _numbers(SYMBOLS, 3) | np.uint64(1), _numbers(SYMBOLS, 4)
#: Bytes of a text that are hashed at a time, in whole words; only a longer word takes tables of its own.
PIECE = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ours = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, PIECE + 1) - 1, base, np.uint64)], dtype=np.uint64) for base in (_BASE, _INVERSE)]
    return ours[0], ours[1]


_KEPT = _powers(PIECE + 1)


def _word_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of these bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[b], [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _KEPT if len(b) < len(_KEPT[0]) else _powers(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def _pieces(b: bytes) -> Iterator[bytes]:
    """b cut before white space, after PIECE bytes where there is some."""
    at = 0
    while at < len(b):
        end = at + PIECE
        if end < len(b):
            back = np.flatnonzero(_SPACE[np.frombuffer(b, np.uint8, PIECE, at)])
            end = at + int(back[-1]) if len(back) and back[-1] else next((i for i in range(end, len(b)) if _SPACE[b[i]]), len(b))
        yield b[at:end]
        at = end


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words, A-Z lower-cased; of all words if there are fewer."""
    h = np.concatenate([np.empty(0, np.uint64), *(_word_hashes(np.frombuffer(x, np.uint8)) for x in _pieces((text or "").encode().translate(_LOWER)))])
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += _mix(h[k : len(h) - n + 1 + k] * _PLACE[k % WORDS] + np.uint64(k))
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The b-bit minima of a set that isn't empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024][None, :] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit digest of the set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


@lru_cache
def radius(percent: int) -> int:
    """Smallest distance that a pair of similarity percent/100 exceeds with a probability below MISSED."""
    p, tail = 1 - percent / 100, 0.0
    for d in range(SYMBOLS, -1, -1):
        tail += comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
        if tail > MISSED:
            return d
    return 0


def chunks(within: int) -> list[range]:
    """Contiguous chunks of which, for at most `within` wrong symbols, one has one or none."""
    n = min(SYMBOLS, within // 2 + 1)
    cuts = [SYMBOLS * i // n for i in range(n + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, sig, tie (a hash of the text) for each row of docs(doc_id, text); cls and sig are null for texts
    without words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, sig = [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t)
                n.append(len(h))
                cls.append(class_of(h) if len(h) else None)
                sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), b.column(2)], ["doc_id", "n", "cls", "sig", "tie"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, cls long, sig binary, tie long")


def keys(classes: DataFrame, percent: int) -> DataFrame:
    """key, cls: a row per class, chunk and place of the chunk that may be wrong."""
    parts = chunks(radius(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            cls = b.column(0).to_numpy()
            for part in parts:
                term = {s: _mix(sig[:, s] * _ODD + np.uint64(s + 1)) for s in part}
                total = sum(term.values())
                for wrong in part:
                    key = _mix(total - term[wrong] + _WRONG[wrong])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls)], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(tidied(run, 4096), "key long, cls long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(sigs: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, percent: int) -> np.ndarray:
    """Component numbers of a block's members after linking; members of one number to begin with are connected."""
    comp, within = comp.copy(), radius(percent)
    for i in range(len(comp) - 1):
        others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if not len(others):
            continue
        near = others[(sigs[others] != sigs[i]).sum(1) <= within]
        for j in near:
            if comp[j] != comp[i] and similar(sets[i], sets[j], percent):
                comp[comp == comp[j]] = comp[i]
    return comp


def by_block(rows: DataFrame, percent: int) -> DataFrame:
    """cls, root for each member of each block of rows(block, cls, comp, sig, text): its component within the block."""
    ship(rows.sparkSession)

    def solved(members: list[tuple]) -> Iterator[tuple[int, int]]:
        own: dict[int, tuple] = {}
        for cls, comp, sig, text in members:  # repeated document ids bring rows of other classes, which go here
            if cls not in own and class_of(h := shingles(text)) == cls:
                own[cls] = (comp, sig, h)
        ids = sorted(own)
        first = np.unique(np.array([own[c][0] for c in ids], np.int64), return_inverse=True)[1]
        sigs = np.frombuffer(b"".join(own[c][1] for c in ids), np.uint16).reshape(-1, SYMBOLS)
        comp = linked(sigs, [own[c][2] for c in ids], first, percent)
        least: dict[int, int] = {}
        for c, k in zip(ids, comp):
            least.setdefault(int(k), c)
        yield from ((c, least[int(k)]) for c, k in zip(ids, comp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []
        for b in batches:
            out = []
            for block, cls, comp, sig, text in zip(*(c.to_pylist() for c in b.columns)):
                if block != at:
                    out += solved(members) if members else []
                    at, members = block, []
                members.append((cls, comp, sig, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["cls", "root"])
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*solved(members))], ["cls", "root"])

    return rows.select("block", "cls", "comp", "sig", "text").repartition("block").sortWithinPartitions("block", "cls").mapInArrow(tidied(run), "cls long, root long")


def with_text(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members with the text of the document `rep`. A Bloom filter of the ids asked for keeps other texts out of the
    shuffle; it is left out where it would be over FILTER_BYTES (some 10 million documents with candidates)."""
    texts = docs.select(F.col("doc_id").alias("__id"), "text").where(F.col("text").isNotNull())
    ids = members.select("rep").distinct()
    blocks = bloom.blocks_for(ids.count())
    if bloom.size_of(blocks) <= FILTER_BYTES:
        texts = bloom.passing(texts, "__id", F.broadcast(bloom.bloom_filter(ids, "rep", blocks)), blocks)
    return members.join(texts, F.col("rep").eqNullSafe(F.col("__id"))).drop("__id")


def near(sigs: np.ndarray, within: int) -> np.ndarray:
    """Component numbers under distance `within`. All are compared with the first, then each of the rest with all: pairs
    that both lie near the first are connected already."""
    comp = np.arange(len(sigs))
    comp[(sigs != sigs[0]).sum(1) <= within] = 0
    for i in np.flatnonzero(comp):
        labels = np.unique(comp[(sigs != sigs[i]).sum(1) <= within])
        comp[np.isin(comp, labels)] = labels[0]
    return comp


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that connect all classes(cls, sig) that share a key and whose signatures are within the radius."""
    within, sigs = radius(percent), classes.select("cls", "sig")
    rows = keys(classes, percent)
    shared = rows.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("all")).where("size > 1")
    shared = shared.select("key", "hub", "size", F.xxhash64("hub", "size", "all").alias("bucket"))
    rows = written(rows.join(shared, "key").groupBy("bucket", "cls").agg(F.min("hub").alias("hub"), F.max("size").alias("size")))  # buckets of the same classes are one

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = t["cls"].to_numpy()
        comp = near(np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS), within)
        linked_ = comp != np.arange(len(comp))
        if linked_.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked_]), pa.array(ids[comp[linked_]])], ["a", "b"])

    small = rows.where(f"size <= {BUCKET}").select("bucket", "cls").join(sigs, "cls").select("bucket", "cls", "sig")
    found = per_group(small, "bucket", solve, "a long, b long", "cls")
    large = rows.where(f"size > {BUCKET}")
    return (found.unionByName(of_large_buckets(large, sigs, within)) if large.take(1) else found).distinct()


def of_large_buckets(rows: DataFrame, sigs: DataFrame, within: int) -> DataFrame:
    """a, b: edges as those of candidates(), for rows(bucket, cls, hub, size) of buckets of any size. Most classes lie near
    their bucket's hub, which a row tells alone, and once for all buckets with that hub; the rest meet all classes of the bucket, a
    block of each at a time."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x != y).sum(1) <= within)], ["cls", "hub", "near"])

    of_hub = sigs.select(F.col("cls").alias("hub"), F.col("sig").alias("hub_sig"))
    met = rows.select("cls", "hub").distinct().join(sigs, "cls").join(of_hub, "hub").select("cls", "hub", "sig", "hub_sig")
    met = written(met.mapInArrow(tidied(compared, 4096), "cls long, hub long, near boolean"))
    edges = met.where("near and cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    rest = rows.join(met.where("not near").select("cls", "hub"), ["cls", "hub"]).select("bucket", "cls", "size")
    counts = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("rest_blocks"), F.ceil(F.max("size") / BLOCK).alias("blocks"))
    nth = lambda n: F.pmod(F.xxhash64("cls", F.lit(11)), F.col(n))
    each = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    left = rest.join(counts, "bucket").select("bucket", "cls", F.lit(0).alias("side"), nth("rest_blocks").alias("i"), each("blocks").alias("j"))
    right = rows.select("bucket", "cls").join(counts, "bucket").select("bucket", "cls", F.lit(1).alias("side"), nth("blocks").alias("j"), each("rest_blocks").alias("i"))
    both = left.unionByName(right).join(sigs, "cls").select(F.xxhash64("bucket", "i", "j").alias("grp"), "cls", "sig", "side")

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, side = t["cls"].to_numpy(), t["side"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        comp = np.arange(len(ids))
        for i in np.flatnonzero(side == 0):  # a forest is enough: no pair leaves the task but its edges
            labels = np.unique(comp[((sig != sig[i]).sum(1) <= within) & ((side == 1) | (comp == comp[i]))])
            comp[np.isin(comp, labels)] = labels[0]
        linked_ = ids != ids[comp]
        if linked_.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked_]), pa.array(ids[comp[linked_]])], ["a", "b"])

    return edges.unionByName(per_group(both, "grp", solve, "a long, b long", "side", "cls"))


def clusters(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """cls, root (smallest class of its component) for classes(cls, rep, n, sig) that share a key with another."""
    groups = components(candidates(classes, percent)).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    members = groups.join(classes, "cls")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = written(members.join(sizes, "grp").withColumn("nth", F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    key = lambda *c: F.xxhash64(*c)
    first = members.withColumn("block", key(F.col("grp"), F.lit("own"), F.col("nth")))
    large = members.where("blocks > 1")
    several = bool(large.take(1))
    if several:
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("cls", F.lit(7)), "cls"))
        hubs = large.withColumn("rank", rank).where(f"rank <= {HUBS}").withColumn("in", F.explode(F.expr("sequence(0L, blocks - 1)")))
        hubs = hubs.where("`in` <> nth").withColumn("block", key(F.col("grp"), F.lit("own"), F.col("in")))
        first = first.unionByName(hubs.select(first.columns))
    roots = written(by_block(with_text(first.withColumn("comp", F.col("cls")), docs), percent))
    if not several:
        return roots
    edges = roots.select(F.col("cls").alias("a"), F.col("root").alias("b"))
    now = components(edges).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    left = large.join(now, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    counts = left.groupBy("grp", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    main = counts.groupBy("grp").agg(F.max_by("comp", F.struct("members", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("members").alias("all"), F.sum("shingles").alias("all_shingles"), F.max(F.struct("members", "comp", "shingles")).alias("top"))
    halves = lambda n, s: F.greatest(F.lit(1), F.ceil(2 * n / BLOCK), F.ceil(2 * s / BLOCK_SHINGLES))
    main = main.where("comps > 1").select("grp", "main", halves(F.col("top.members"), F.col("top.shingles")).alias("in_main"), halves(F.col("all") - F.col("top.members"), F.col("all_shingles") - F.col("top.shingles")).alias("in_rest"))
    left = left.join(main, "grp").withColumn("is_main", F.col("comp") == F.col("main"))
    left = written(left.withColumn("nth", F.pmod(F.xxhash64("cls"), F.when(F.col("is_main"), F.col("in_main")).otherwise(F.col("in_rest")))))
    if not left.take(1):
        return now.select("cls", F.col("comp").alias("root")).unionByName(roots.join(now, "cls", "left_anti"))
    cols = ["block", "cls", "comp", "sig", "rep"]
    mains = left.where("is_main").withColumn("other", F.explode(F.expr("sequence(0L, in_rest - 1)"))).withColumn("block", key(F.col("grp"), F.lit("main"), F.col("other"), F.col("nth")))
    rest = left.where("not is_main")
    to_main = rest.withColumn("other", F.explode(F.expr("sequence(0L, in_main - 1)"))).withColumn("block", key(F.col("grp"), F.lit("main"), F.col("nth"), F.col("other")))
    to_rest = rest.withColumn("other", F.explode(F.expr("sequence(0L, in_rest - 1)"))).withColumn("block", key(F.col("grp"), F.lit("rest"), F.least("nth", "other"), F.greatest("nth", "other")))
    second = mains.select(cols).unionByName(to_main.select(cols)).unionByName(to_rest.select(cols))
    more = by_block(with_text(second, docs), percent).select(F.col("cls").alias("a"), F.col("root").alias("b"))
    done = components(edges.unionByName(more)).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    return done.unionByName(roots.join(done, "cls", "left_anti").select("cls", F.col("cls").alias("root")))


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tie, n_shingles, component_id, root for each row of docs(doc_id, text): root is the smallest class of the
    row's component, null for texts without words."""
    rows = written(described(docs))
    classes = written(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig")))
    roots = clusters(classes, docs, percent).groupBy("cls").agg(F.min("root").alias("root"))
    nodes = classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    nodes = written(nodes.join(least, "root").select("cls", "component_id", "root"))
    known = rows.where("n > 0").select("doc_id", "tie", "n", "cls").join(nodes, "cls").select("doc_id", "tie", F.col("n").alias("n_shingles"), "component_id", "root")
    none = rows.where("n = 0").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return known.unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text), linking where
    100 * intersection >= percent * union of the sets of WORDS-word shingles.

    Null and blank texts have no shingles and link with nothing: their component is their own doc_id. Texts of fewer
    words are one shingle, very long ones are read whole. Rows with equal sets, among them repeated rows, are linked; a
    pair at exactly the threshold is. component_id is the smallest doc_id reachable; of rows without doc_id null. An empty
    table gives none. Columns other than the two are not read."""
    found = grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, the one with the smallest doc_id; columns as they are.

    Rows are told apart by doc_id and text: a row without doc_id, or with the id of another text, is in its own text's
    group, and of rows alike in both one stays. A row without doc_id stays only where its whole group has none. Texts
    without words are in no group and stay, repeated ones, too; very long texts are read whole. An empty table stays empty."""
    found = grouped(docs, percent).where("root is not null").groupBy("root", "doc_id", "tie").agg(F.count("*").alias("times"))
    found = written(found)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("root").alias("__root"), "first")
    is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    # what rows of a key do that don't all stay: go, or be one
    keys_ = found.join(first, F.col("root") == F.col("__root")).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "times", is_first.alias("__one")).where("not __one or times > 1")
    gone = written(keys_.select("__id", "__tie", "__one", F.xxhash64("__id", "__tie").alias("__gone")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("key_tie")).withColumn("key_hash", F.xxhash64("key", "key_tie"))
    # no anti join: the optimizer would push it below the filter's flag, and all texts would be shuffled
    met = lambda rows: rows.join(gone, F.col("key").eqNullSafe(F.col("__id")) & (F.col("key_tie") == F.col("__tie")), "left").where("__one is null or __one")
    blocks = bloom.blocks_for(gone.count())
    if bloom.size_of(blocks) <= FILTER_BYTES:  # texts that can't go aren't shuffled
        packed = bloom.flagged(packed, "key_hash", F.broadcast(bloom.bloom_filter(gone, "__gone", blocks)), blocks, "maybe")
        sure, left = packed.where("not maybe").select("doc"), met(packed.where("maybe"))
    else:
        sure, left = docs.limit(0).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), met(packed)
    kept = sure.unionByName(left.where("__one is null").select("doc"))
    if gone.where("__one").take(1):  # repeated rows of which one stays
        once = left.where("__one").groupBy("key", "key_tie").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        kept = kept.unionByName(once.select("doc"))
    return kept.select("doc.*")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents; see near_duplicates() for odd rows."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)
