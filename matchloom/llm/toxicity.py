"""Toxicity by compression distance: windows of a text are compressed with a dictionary of toxic and one of
ordinary text, and the differences in length are held against calibrated thresholds.

The ordinary dictionary is trained on ordinary documents. The toxic one has its entropy tables and content, and
before them the strings that training finds typical of toxic documents: words and word beginnings whose number of
different preceding words (so copies of a document count once) is many times what ordinary documents have. Equal
tables and tail make windows without such strings compress alike, so a difference means something. How many
windows of a text reach each difference goes into a logistic calibration, fitted on halves of the labelled
documents measured with dictionaries of the other half.

The fit takes at most MOST_TOXIC + MOST_ORDINARY labelled documents, chosen by hash of doc_id; that bound holds at every
size of the tables. Their texts are learnt from whole, and scoring covers all texts whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import fold, release, ship, table, tidied

#: Bounds of the labelled sample; bytes of a window; bytes of the ordinary dictionary.
MOST_TOXIC, MOST_ORDINARY, WINDOW, DICTIONARY = 1200, 2400, 124, 8192
#: A string is typical if it has so many times the ordinary rate of contexts, and so many contexts (at least, or of the documents).
RATE, LEAST, SHARE = 10, 4, 0.015
GAINS, LOSSES, THRESHOLD = (1, 2, 3, 4, 5, 6, 8), (1, 2), 0.7
#: Share of toxic texts that scores assume; that of the labelled sample where there are enough of both.
PRIOR = MOST_TOXIC / (MOST_TOXIC + MOST_ORDINARY)
WORD = re.compile(r"\w+")
#: The repeat offsets that close the tables of a trained dictionary.
REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def contexts(texts: Iterable[str]) -> dict[str, int]:
    """Number of different words before each word and word beginning of 4 to 8 letters."""
    seen: dict[str, set] = defaultdict(set)
    for t in texts:
        before = ""
        for w in WORD.findall(t.lower()):
            for u in {f" {w} ", *(f" {w[:k]}" for k in range(4, 9) if len(w) >= k)}:
                seen[u].add(before)
            before = w
    return {u: len(c) for u, c in seen.items()}


def typical(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Strings typical of toxic texts, rarest first; of a string and its beginnings the one that says most."""
    a, b = contexts(toxic), contexts(ordinary)
    least = max(LEAST, SHARE * len(toxic))
    found = {u for u, n in a.items() if n >= least and n / len(toxic) >= RATE * (b.get(u, 0) + 0.5) / len(ordinary)}
    dropped = set()
    for u in found:
        for k in range(5, len(u)):
            if u[:k] in found:
                dropped.add(u[:k] if a[u] >= 0.8 * a[u[:k]] else u)
    return sorted(found - dropped, key=lambda u: (a[u], u))


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, int]:
    """Toxic dictionary, ordinary dictionary and their kind. Samples too few to train on are taken as they are."""
    own = "".join(typical(toxic, ordinary)).encode()
    samples = [b[i : i + 256] for b in (t.lower().encode() for t in ordinary) for i in range(0, len(b), 256)]
    try:
        base = zstd.train_dictionary(DICTIONARY, samples).as_bytes()
        at = base.index(REPEATS) + len(REPEATS)
        return base[:at] + own + base[at:], base, zstd.DICT_TYPE_FULLDICT
    except (zstd.ZstdError, ValueError):
        base = b" " * 8 + b"".join(samples)[:DICTIONARY]
        return own + base, base, zstd.DICT_TYPE_RAWCONTENT


class Windows:
    """Compresses windows with either dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes, kind: int):
        self.by = [self._compressor(d, kind) for d in (toxic, ordinary)]

    @staticmethod
    def _compressor(d: bytes, kind: int) -> zstd.ZstdCompressor:
        how = zstd.ZstdCompressionParameters(
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=14, chain_log=12, hash_log=13, search_log=2, min_match=4, target_length=16, strategy=zstd.STRATEGY_LAZY2
        )
        held = zstd.ZstdCompressionDict(d, dict_type=kind)
        held.precompute_compress(compression_params=how)
        return zstd.ZstdCompressor(dict_data=held, compression_params=how)

    @staticmethod
    def cut(text: bytes, first: int) -> list[bytes]:
        """Windows from the start, the first of `first` bytes, each ending before a space where it has one."""
        out, i, n = [], 0, first
        while i < len(text):
            j = min(len(text), i + n)
            if j < len(text):
                k = text.rfind(b" ", i + 1, j)
                j = k if k > i else j
            out.append(text[i:j])
            i, n = j, WINDOW
        return out

    def features(self, text: str) -> np.ndarray:
        """Logarithms of how many windows (in two phases, half a window apart) gain or lose so many bytes, and of all."""
        b = (" " + text.lower()).encode("utf-8", "replace")
        toxic, ordinary = self.by[0].compress, self.by[1].compress
        d = np.array([len(ordinary(w)) - len(toxic(w)) for first in (WINDOW, WINDOW // 2) for w in self.cut(b, first)])
        return np.log1p([*((d >= k).sum() for k in GAINS), *((d <= -k).sum() for k in LOSSES), len(d)])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights (the constant last) of a ridge-penalised logistic regression by Newton steps.

    Rows of label 1 weigh PRIOR in all, whatever their number, so a threshold means the same for any sample."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    each = len(y) * np.where(y > 0, PRIOR / max(1, (y > 0).sum()), (1 - PRIOR) / max(1, (y <= 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (each * (y - p)) - w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return mean, dev, w


class Model:
    """Dictionaries and calibration. Without two examples of either kind every text scores 0."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.fitted = min(len(toxic), len(ordinary)) > 1
        if not self.fitted:
            return
        x, y = [], []
        for k in (0, 1):  # each half is measured with dictionaries of the other
            w = Windows(*dictionaries(toxic[k::2], ordinary[k::2]))
            for label, texts in ((1, toxic[1 - k :: 2]), (0, ordinary[1 - k :: 2])):
                x += [w.features(t) for t in texts]
                y += [label] * len(texts)
        self.dictionaries = dictionaries(toxic, ordinary)
        self.calibration = logistic(np.array(x), np.array(y, float))

    def scorer(self):
        """A function of a text; made where it runs, as compressors don't travel."""
        if not self.fitted:
            return lambda text: 0.0
        w, (mean, dev, weights) = Windows(*self.dictionaries), self.calibration
        return lambda text: float(1 / (1 + np.exp(-np.clip(((w.features(text) - mean) / dev) @ weights[:-1] + weights[-1], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from docs(doc_id, text) joined with labels(doc_id, toxic); see the bounds above.

    Documents labelled both ways count as toxic; null labels, null and empty texts are left out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    by_hash = F.xxhash64("doc_id")
    spark = docs.sparkSession
    # some chosen documents may be empty or missing, so more are asked for than used
    ids = [(r[0], i) for i, (kind, n) in enumerate((("toxic > 0", MOST_TOXIC), ("toxic <= 0", MOST_ORDINARY))) for r in marks.where(kind).orderBy(by_hash, "doc_id").limit(n + n // 4).select("doc_id").collect()]
    if not ids:
        return Model([], [])
    chosen = spark.createDataFrame(ids, f"doc_id {dict(labels.dtypes)['doc_id']}, kind int")
    got: dict[int, dict] = {0: {}, 1: {}}
    for doc_id, text, kind in texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "kind").collect():
        got[kind].setdefault(doc_id, text)
    rank = {doc_id: n for n, (doc_id, _) in enumerate(ids)}
    toxic, ordinary = ([t for _, t in sorted(got[k].items(), key=lambda x: rank[x[0]])] for k in (0, 1))
    return Model(toxic[:MOST_TOXIC], ordinary[:MOST_ORDINARY])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted for each row of docs(doc_id, text). Null text counts as empty and gets the
    score of a text without windows. Texts are scored whole; repeated rows stay repeated and score alike; an empty table
    gives no rows. Other columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = [score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; columns as they are. Null texts count as empty; repeated rows share one
    fate; texts are scored whole; an empty table stays empty. Only the texts go to Python, and only verdicts come back."""
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def stays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        try:
            for texts in batches:
                yield pa.array([score(t.as_py() or "") < THRESHOLD for t in texts], pa.bool_())
        finally:
            release()

    return docs.where(stays(F.col("text")))


def learnt_from(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of op8: labels whose crc32 modulo 3 is 1 are held out."""
    return fit(docs, labels.where(fold(3) != 1))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; see fit() and scored() for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = learnt_from(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
