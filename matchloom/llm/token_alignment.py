"""Alignment of two tokenizers over a corpus: where their tokens end together, which tokens overlap, and how often.

Both encode a space and the text. Byte offsets where tokens of both end cut the tokens into groups; tokens of either side whose
byte ranges overlap are linked. Ends are running sums of token lengths, common cuts their intersection, group labels a search of
ends in the cuts, and links a repeat of each A token for the B tokens that it overlaps, all as arrays over many words at once.

A space between two characters that are no white space starts a word for both tokenizers: no token spans it. So a text is its
words, a word's alignment is made once and kept (a worker holds a bounded number), and a text's is put together from them.

The counts of id pairs need the whole corpus: each text's pairs are written with their number, summed by (pair, salt) and then by pair, and
joined back. Pairs that hold more than a share of all links, of which there can only be so many, are joined by broadcast, all others by a
shuffle in which no key is heavy; nothing depends on the size of the input.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.bpe import byte_letters
from matchloom.llm.common import ship, table, tidied, written

#: Links of aligned words after which a worker starts its store anew. Ids must be below 2 ** ID_BITS.
MOST_LINKS, ID_BITS = 3_000_000, 20
#: Salts of the first sum, and the share of all links (1 in so many) beyond which a pair counts as frequent: there are at most so many such pairs.
SALTS, FREQUENT = 16, 10_000
WORD_START = re.compile(r"(?<=\S) (?=\S)")


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for all (s, n), one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offsets where tokens of both end, and for each token of A and of B the number of its group."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def overlaps(ends_a: np.ndarray, len_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in A and in B of all tokens that overlap, ordered by A, and how many each A token has."""
    first = np.searchsorted(ends_b, ends_a - len_a, "right")
    each = np.searchsorted(ends_b, ends_a) - first + 1
    before = np.cumsum(each) - each
    return np.repeat(np.arange(len(ends_a)), each), np.repeat(first - before, each) + np.arange(int(each.sum())), each


class Pair:
    """Both tokenizers, and the words aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a, self.b = tokenizers.Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        label_a = {i: bytes(map(letters.__getitem__, s)) if all(c in letters for c in s) else s.encode() for s, i in vocab.items()}
        self.label_a = [label_a.get(i, b"") for i in range(max(label_a) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.label_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.label_a), len(self.label_b)) >= 1 << ID_BITS:
            raise ValueError("vocabularies must be smaller")
        self.len_a, self.len_b = (np.array([len(x) for x in labels], np.int64) for labels in (self.label_a, self.label_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(labels))] for labels in (self.label_a, self.label_b))
        spec = json.loads(self.a.to_str())
        own_words = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec.get("normalizer")
        self.by_words = own_words and not any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:]))
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.names: list[str] = []  # of a word's groups
        self.links = np.empty(1 << 16, np.int64)
        self.used = 0
        #: For each word: where its links start, how many they are, tokens of A and of B, groups, whether its bytes are those of both.
        self.about = np.empty((1 << 14, 6), np.int64)

    def add(self, words: list[str]) -> None:
        """Aligns words not seen yet; each stands for a space and itself."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        ids_b = self.b.encode(words, num_threads=1)
        spelt = [b" " + w.encode() for w in words]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        good = self._spell(ids_a, ids_b, spelt, sizes)
        if not good.all():
            ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        del ids_a, ids_b
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        cuts, group_a, group_b = common_cuts(ends_a, ends_b)
        at_a, at_b, each = overlaps(ends_a, self.len_a[flat_a], ends_b)
        word_ends = np.cumsum(np.where(good, sizes, 0))
        groups = np.diff(np.searchsorted(cuts, word_ends, "right"), prepend=0)
        made = np.diff(np.concatenate([[0], np.cumsum(each)])[np.cumsum(n_a)], prepend=0)
        self._keep((flat_a[at_a] << ID_BITS) | flat_b[at_b], np.stack([self.used + np.cumsum(made) - made, made, n_a, n_b, groups, good], 1))
        from_a, from_b = (np.searchsorted(x, np.arange(len(cuts) + 1)).tolist() for x in (group_a, group_b))
        name_a, name_b = [self.name_a[i] for i in flat_a.tolist()], [self.name_b[i] for i in flat_b.tolist()]
        side = lambda names, at: [names[i] if j - i == 1 else ",".join(names[i:j]) for i, j in zip(at, at[1:])]
        spelt_groups = [f"{x}|{y}" for x, y in zip(side(name_a, from_a), side(name_b, from_b))]
        i = 0
        for w, n in zip(words, groups.tolist()):
            self.code[w] = len(self.names)
            self.names.append(";".join(spelt_groups[i : i + n]))
            i += n

    def _spell(self, ids_a: list[list[int]], ids_b: list[list[int]], spelt: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of both spell each word; looked at one by one only where they don't spell all of them."""
        whole, same = b"".join(spelt), True
        for ids, labels, lengths in ((ids_a, self.label_a, self.len_a), (ids_b, self.label_b, self.len_b)):
            flat = list(chain.from_iterable(ids))
            ends = np.concatenate([[0], np.cumsum(lengths[np.array(flat, np.int64)])])[np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
            same = same and np.array_equal(ends, np.cumsum(sizes)) and b"".join(map(labels.__getitem__, flat)) == whole
        if same:
            return np.ones(len(spelt), bool)
        join = lambda labels, ids: b"".join([labels[i] for i in ids])
        return np.array([join(self.label_a, x) == s == join(self.label_b, y) for x, y, s in zip(ids_a, ids_b, spelt)], bool)

    def _keep(self, links: np.ndarray, about: np.ndarray) -> None:
        while self.used + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.empty_like(self.links)])
        while len(self.names) + len(about) > len(self.about):
            self.about = np.concatenate([self.about, np.empty_like(self.about)])
        self.links[self.used : self.used + len(links)] = links
        self.about[len(self.names) : len(self.names) + len(about)] = about
        self.used += len(links)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of the texts, one text after the other and all of them aligned, and how many each text has; none for empty texts. Where a word's bytes aren't those of both, the text is
        taken as one word, as only its joined bytes count."""
        if self.used > MOST_LINKS:
            self.clear()
        words = [[] if not t else WORD_START.split(t) if self.by_words else [t] for t in texts]
        flat = self._coded(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        wrong = np.bincount(np.repeat(np.arange(len(texts)), lengths)[self.about[flat, 5] == 0], minlength=len(texts)) if len(flat) else np.zeros(len(texts))
        odd = np.flatnonzero((wrong > 0) & (lengths > 1)).tolist()
        if odd:
            for k in odd:
                words[k] = [texts[k]]
            flat, lengths = self._coded(words), np.fromiter(map(len, words), np.int64, len(words))
        return flat, lengths

    def _coded(self, words: list[list[str]]) -> np.ndarray:
        """The codes of all words, one text after the other; new words are aligned first."""
        flat = list(chain.from_iterable(words))
        new = set(flat).difference(self.code)
        if new:
            self.add(list(new))
        return np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links (a row) and the digest of its groups; then of all texts, one after the other, how many
        different pairs each has, these pairs, and the number of links of each."""
        flat, lengths = self.codes(texts)
        of = np.repeat(np.arange(len(texts)), lengths)
        totals = np.stack([np.bincount(of, self.about[flat, k], len(texts)).astype(np.int64) for k in (2, 3, 4, 1)], 1)
        named, ends = list(map(self.names.__getitem__, flat.tolist())), np.cumsum(lengths).tolist()
        digests = [hashlib.sha256(";".join(named[j - k : j]).encode()).hexdigest() if n else "" for j, k, n in zip(ends, lengths.tolist(), totals[:, 0].tolist())]
        of_word, times = np.unique(of * max(1, len(self.names)) + flat, return_counts=True)
        of, flat = np.divmod(of_word, max(1, len(self.names)))
        starts, made = self.about[flat, 0], self.about[flat, 1]
        keys = gathered(self.links, starts, made) | np.repeat(of, made) << 2 * ID_BITS
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], np.repeat(times, made)[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.add.reduceat(weight, first) if len(first) else weight
        keys = keys[first]
        return totals, digests, np.bincount(keys >> 2 * ID_BITS, minlength=len(texts)), keys & ((1 << 2 * ID_BITS) - 1), counts


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """One per worker and pair of vocabulary files."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row (a number of its own for each row), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times for each row of docs(doc_id,
    text): pairs are A id * 2 ** ID_BITS + B id, each once, times the links of each.

    A is a byte-level file of the tokenizers library, B a sentencepiece model that normalises nothing. Null and empty texts, and texts whose
    bytes either side doesn't give back, have no tokens: zeros, an empty digest and empty arrays. Repeated rows stay repeated; an empty
    table gives no rows; other columns are not read; texts are taken whole."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = pair_of(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            totals, digests, held, pairs, times = both.aligned([t or "" for t in batch.column(1).to_pylist()])
            at = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), *[pa.array(totals[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def opened(rows: DataFrame) -> DataFrame:
    """row, pair, times: a row for each different pair of each text."""
    return rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, links, best (no pair with the same B id has more) over all of aligned(), summed by salt first."""
    salted = opened(rows).select("pair", "times", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    counts = written(salted.groupBy("pair", "salt").agg(F.sum("times").alias("links")).groupBy("pair").agg(F.sum("links").alias("links")))
    of_b = F.pmod(F.col("pair"), F.lit(1 << ID_BITS))
    most = counts.groupBy(of_b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", of_b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """row, n_best, count_sum for the rows of aligned() that have pairs. Pairs with more than 1 / frequent of all links (fewer than
    `frequent` of them) are joined by broadcast, others by shuffle."""
    total = counts.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("n")).first().n
    often = F.col("links") * frequent > total
    links, hot, rest = opened(rows), F.broadcast(counts.where(often)), counts.where(~often)
    found = links.join(hot, "pair").unionByName(links.join(F.broadcast(counts.where(often).select("pair")), "pair", "left_anti").join(rest.hint("merge"), "pair"))
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))


def alignment(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs, and the counts of pairs over all of them: a, b, links, best."""
    rows = written(aligned(docs, path_a, path_b))
    counts = written(pair_counts(rows))
    texts = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scored(rows, counts, frequent), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    pairs = counts.select(F.call_function("shiftright", "pair", F.lit(ID_BITS)).cast("int").alias("a"), F.pmod("pair", F.lit(1 << ID_BITS)).cast("int").alias("b"), "links", "best")
    return texts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligns the byte-level vocabulary (A) with the piece vocabulary (B) over all documents; see aligned() for odd rows."""
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
