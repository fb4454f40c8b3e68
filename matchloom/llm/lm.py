"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation in numpy.

Words fall into CLASSES classes: the most frequent words and the end of a text are classes of their own, other words
go by their last two bytes. A log-bilinear network (Mnih and Hinton 2007) predicts the next class from CONTEXT
classes before it: q = sum_i C_i r(c_i), score(c) = q . s(c) + b(c). Batched matrix products give the scores of all
classes for a block of positions, and so normalised log-probabilities. Within a class a word has its corpus count:
P(word | context) = P(class | context) * (c + 0.1) / (sum of the class's c + 0.1 * (its words + 1)),
the last share being that of unknown words. So the model is a distribution over known words and unknown ones by class.

Classes and head words are ranked by counts over all training rows. The network is trained on all training rows, whole.
They are dealt to ROUNDS rounds by hash: in each, every task starts from the shared weights, passes over all of its rows
and returns how far the weights moved and the number of its tokens; Spark averages the moves by tokens. A corpus is passed over
once, but one of fewer than EPOCH_TOKENS tokens as often as it takes to see about so many, at most PASSES times, and one that is
a single task has nothing to average and takes one round. The weights are a fixed number. Counts of
up to HEAD words are broadcast, a fixed bound; all other words are counted by shuffle: each document sends its words by
hash, a word's count meets its documents there, and each document gets its sum of logarithms back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import fold, ship, table, tidied, written

HEAD = 150_000
SINGLES, SUFFIXES, REST, CONTEXT, DIM = 127, 112, 16, 4, 32
CLASSES = SINGLES + SUFFIXES + REST + 1
END, PAD = CLASSES - 1, CLASSES
SMOOTH, BLOCK, HELD_WORDS = 0.1, 2048, 500_000
EPOCH_TOKENS, BATCH, NOISE, RATE = 6_000_000, 2048, 128, 0.02
#: Rounds of averaging; most passes over the rows, where the corpus is small; tokens of a task, and of those shuffled together in it.
ROUNDS, PASSES, TASK_TOKENS, CHUNK_TOKENS = 2, 6, 4_000_000, 1_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased, without the end."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Vocabulary(dict):
    """Code of a word: its number among the head words, or for others len(head) plus the class."""

    def __init__(self, singles: list[bytes], others: list[bytes], suffixes: list[bytes]):
        """Words that are classes, other head words, and endings that are classes, each by rank."""
        head = singles + others
        self.suffixes = {e: SINGLES + i for i, e in enumerate(suffixes)}
        super().__init__((w, i) for i, w in enumerate(head))
        self.size = len(head)
        self.single = np.array([True] * len(singles) + [False] * (len(others) + CLASSES))
        self.classes = np.array([*range(len(singles)), *map(self.class_of, others), *range(CLASSES)], np.int32)

    def class_of(self, w: bytes) -> int:
        found = self.suffixes.get(w[-2:])
        return SINGLES + SUFFIXES + sum(w[-2:]) % REST if found is None else found

    def __missing__(self, w: bytes) -> int:
        found = self.suffixes.get(w[-2:])
        return self.size + (SINGLES + SUFFIXES + sum(w[-2:]) % REST if found is None else found)

    def __reduce__(self):
        return _restored, (list(self.items()), self.suffixes, self.size, self.single, self.classes)

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _restored(items, suffixes, size, single, classes) -> Vocabulary:
    v = Vocabulary.__new__(Vocabulary)
    dict.update(v, items)
    v.suffixes, v.size, v.single, v.classes = suffixes, size, single, classes
    return v


def windows(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each position, the nearest first; PAD before a text's start."""
    at = np.arange(len(classes)) - np.repeat(starts, np.diff(np.append(starts, len(classes))))
    out = np.full((CONTEXT, len(classes)), PAD, np.int32)
    for i in range(CONTEXT):
        out[i, i + 1 :] = classes[: max(0, len(classes) - i - 1)]
        out[i, at <= i] = PAD
    return out


def summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    order = np.argsort(index.astype(np.int16), kind="stable")
    by = index[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    out = np.zeros((size, values.shape[1]), np.float32)
    out[by[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class LogBilinear:
    """r, C and s of the network, and the biases b."""

    def __init__(self, classes: np.ndarray, starts: np.ndarray, seed: int = 0):
        """Trains on the concatenated classes of texts that begin at `starts`."""
        self._begin(np.bincount(classes, minlength=CLASSES), seed)
        if len(classes):
            passes = min(PASSES, max(1, EPOCH_TOKENS // len(classes)))
            learner = Learner(self, len(classes), passes)
            learner.learn(classes, starts, lambda done: done, np.random.default_rng(seed))

    @classmethod
    def untrained(cls, counts: np.ndarray, seed: int = 0) -> LogBilinear:
        """Biases by counts of classes, and weights to start from."""
        out = cls.__new__(cls)
        out._begin(counts, seed)
        return out

    def _begin(self, counts: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.r = (rng.standard_normal((CLASSES + 1, DIM)) * 0.1).astype(np.float32)
        self.c = np.stack([np.eye(DIM, dtype=np.float32) / (i + 1) for i in range(CONTEXT)])
        self.s = (rng.standard_normal((CLASSES, DIM)) * 0.1).astype(np.float32)
        self.noise = (counts + 0.5) / (counts + 0.5).sum()
        self.b = np.log(self.noise).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.r, self.c, self.s, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()]).astype(np.float64)

    def moved(self, by: np.ndarray) -> LogBilinear:
        """A network with the weights of this plus `by`, which is as flat() is."""
        out, at = LogBilinear.__new__(LogBilinear), 0
        out.noise = self.noise
        for name, w in zip("rcsb", self.weights()):
            setattr(out, name, (w + by[at : at + w.size].reshape(w.shape)).astype(np.float32))
            at += w.size
        return out

    def log10(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each class given those before it in its text."""
        context = windows(classes, starts)
        tables = [self.r @ self.c[i] for i in range(CONTEXT)]
        out = np.empty(len(classes))
        held = np.empty((BLOCK, CLASSES), np.float32)
        for i in range(0, len(classes), BLOCK):
            n = min(BLOCK, len(classes) - i)
            q = tables[0][context[0, i : i + n]]
            for k in range(1, CONTEXT):
                q += tables[k][context[k, i : i + n]]
            s = np.matmul(q, self.s.T, out=held[:n])
            s += self.b
            np.clip(s, -60, 60, out=s)
            own = s[np.arange(n), classes[i : i + n]].astype(np.float64)
            np.exp(s, out=s)
            out[i : i + n] = own - np.log(s.sum(1))
        return out / np.log(10)


class Learner:
    """Changes a network by noise-contrastive estimation, chunk by chunk of about `expected` tokens in all."""

    def __init__(self, network: LogBilinear, expected: int, passes: int):
        self.network, self.passes, self.all = network, passes, max(1, expected) * passes
        self.square = [np.full_like(p, 1e-6) for p in network.weights()]
        self.log_noise = np.log(network.noise * NOISE).astype(np.float32)
        self.batch = min(BATCH, max(64, expected // 50))
        self.done = 0

    def learn(self, target: np.ndarray, starts: np.ndarray, progress, rng: np.random.Generator) -> None:
        """Every position `passes` times. progress: share of all training, given this learner's share."""
        context = np.ascontiguousarray(windows(target, starts).T.astype(np.int16))  # a row for each position
        for _ in range(self.passes):
            for at in np.array_split(rng.permutation(len(target)), -(-len(target) // self.batch)):
                rate = RATE * (1 - progress(min(1.0, self.done / self.all))) + 1e-4
                self._step(target[at], np.ascontiguousarray(context[at].T), rng.choice(CLASSES, NOISE, p=self.network.noise), rate)
                self.done += len(at)

    def _step(self, y: np.ndarray, x: np.ndarray, drawn: np.ndarray, rate: float) -> None:
        n, log_noise = self.network, self.log_noise
        q = (n.r @ n.c[0])[x[0]]
        for i in range(1, CONTEXT):
            q += (n.r @ n.c[i])[x[i]]
        s_y, s_drawn = n.s[y], n.s[drawn]
        # data against noise: d/ds of log sigmoid(s - log kp) is 1 - sigma, of log(1 - sigma) is -sigma
        own = 1 - 1 / (1 + np.exp(-(np.einsum("nd,nd->n", q, s_y) + n.b[y] - log_noise[y])))
        other = q @ s_drawn.T
        other += n.b[drawn] - log_noise[drawn]
        np.negative(other, out=other)
        np.exp(other, out=other)
        other += 1
        np.reciprocal(other, out=other)
        grad_s = summed(y, own[:, None] * q, CLASSES)
        np.add.at(grad_s, drawn, -(other.T @ q))
        grad_b = np.bincount(y, own, CLASSES).astype(np.float32)
        np.add.at(grad_b, drawn, -other.sum(0))
        s_y *= own[:, None]
        s_y -= other @ s_drawn
        grad_r, grad_c = np.zeros_like(n.r), np.zeros_like(n.c)
        for i in range(CONTEXT):
            g = summed(x[i], s_y, CLASSES + 1)
            grad_r += g @ n.c[i].T
            grad_c[i] = n.r.T @ g
        for p, g, h in zip(n.weights(), (grad_r, grad_c, grad_s, grad_b), self.square):
            g = g / len(y)
            h *= 0.99
            h += 0.01 * g * g
            p += rate * g / np.sqrt(h + 1e-8) * 0.3


def joined(words: list[list[bytes]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts one after the other, each closed by the end, and where they start."""
    end = vocabulary.size + END
    codes = np.concatenate([np.append(vocabulary.codes(w), np.int32(end)) for w in words]) if words else np.empty(0, np.int32)
    return codes, np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]


def keyed(docs: DataFrame, train: F.Column | None = None) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text", key.alias("key"), F.coalesce(train if train is not None else F.lit(True), F.lit(True)).alias("train"))


def ranked(rows: DataFrame) -> Vocabulary:
    """The vocabulary by counts of words over all training rows."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for text in b.column(0).to_pylist():
                count.update(tokens(text))
                if len(count) > HELD_WORDS:
                    yield out()
                    count.clear()
        yield out()

    found = rows.where("train").select("text").mapInArrow(tidied(run), "word binary, n long")
    found = written(found.groupBy("word").agg(F.sum("n").alias("n")))
    singles = [bytes(r.word) for r in found.orderBy(F.desc("n"), "word").limit(SINGLES).collect()]
    # the head ends where words of one count no longer fit; the counts that occur are few beside the words
    least, room = 0, HEAD
    for n, m in sorted(found.groupBy("n").count().collect(), reverse=True):
        room -= m
        if room < 0:
            least = n
            break
    head = sorted(((-n, bytes(w)) for w, n in found.where(F.col("n") > least).collect()))
    own = set(singles)
    ends = found.where(~F.col("word").isin(singles)) if singles else found
    ends = ends.groupBy(F.expr("substring(word, -2, 2)").alias("ending")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(SUFFIXES)
    return Vocabulary(singles, [w for _, w in head if w not in own], [bytes(r.ending) for r in ends.collect()])


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """kind, word, key, n, known, cls, classes. kind 0: training count `known` of the code `word`; kind 1: a word that isn't
    in the head, by hash, in document `key`, n times, of which `known` in training; kind 2: the classes of a training row,
    a byte each. Counts are per task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = vocabulary.size, np.zeros(vocabulary.size + CLASSES, np.int64)
        hash_of = xxhash.xxh3_64_intdigest
        names = ["kind", "word", "key", "n", "known", "cls", "classes"]
        for b in batches:
            word, n, cls, rows, of, seen, every = [], [], [], [], [], [], []
            for text, k, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = tokens(text)
                codes = vocabulary.codes(words)
                if train:
                    every.append(codes)
                    of.append(k)
                    seen.append(vocabulary.classes[codes].astype(np.uint8).tobytes() + bytes([END]))
                at = np.flatnonzero(codes >= size)
                tail = [words[i] for i in at.tolist()]
                counts = Counter(tail)
                word += map(hash_of, counts)
                n += counts.values()
                cls += dict(zip(tail, (codes[at] - size).tolist())).values()  # in the order of counts: by first place
                rows.append((k, train, len(counts)))
            if word:
                k, train, m = (np.array(x) for x in zip(*rows))
                many = np.array(n, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(word), np.int8)), pa.array(np.array(word, np.uint64).view(np.int64)), pa.array(np.repeat(k, m), pa.int64()), pa.array(many), pa.array(np.where(np.repeat(train, m), many, 0).astype(np.int64)), pa.array(np.array(cls, np.int16)), pa.nulls(len(word), pa.binary())], names
                )
            if of:
                total += np.bincount(np.concatenate(every), minlength=len(total))
                total[size + END] += len(of)
                none = np.zeros(len(of), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), 2, np.int8)), pa.array(none), pa.array(of, pa.int64()), pa.array(none.astype(np.int32)), pa.array(none), pa.array(none.astype(np.int16)), pa.array(seen, pa.binary())], names)
        at = np.flatnonzero(total)
        zero = np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int8)), pa.array(at.astype(np.int64)), pa.array(zero), pa.array(zero.astype(np.int32)), pa.array(total[at]), pa.array(zero.astype(np.int16)), pa.nulls(len(at), pa.binary())], names)

    return docs.select("text", "key", "train").mapInArrow(tidied(run), "kind byte, word long, key long, n int, known long, cls short, classes binary")


def trained(texts: DataFrame, by_class: np.ndarray, seed: int = 0) -> LogBilinear:
    """The network after the rounds over all rows of texts(key, classes), of which by_class are the counts."""
    spark, total = texts.sparkSession, int(by_class.sum())
    network = LogBilinear.untrained(by_class, seed)
    if not total:
        return network
    rounds = ROUNDS if total > TASK_TOKENS else 1
    parts, seen = -(-total // (rounds * TASK_TOKENS)), 0
    passes = min(PASSES, max(1, EPOCH_TOKENS // total))
    for round_ in range(rounds):
        dealt = texts.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(rounds)) == round_).repartition(parts, "key").sortWithinPartitions("key", "classes")
        shared = spark.sparkContext.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            start = shared.value
            own = start.moved(np.zeros(len(start.flat())))
            learner, rng = Learner(own, total // (rounds * parts), passes), np.random.default_rng([seed, round_, TaskContext.get().partitionId()])
            progress = lambda done: (round_ + done) / rounds
            held, size, n = [], 0, 0
            for b in batches:
                for text in b.column(0).to_pylist():
                    held.append(text)
                    size += len(text)
                    if size >= CHUNK_TOKENS:
                        learner.learn(*_one_after_another(held), progress, rng)
                        held, size, n = [], 0, n + size
            if held:
                learner.learn(*_one_after_another(held), progress, rng)
                n += size
            if n:
                move = own.flat() - start.flat()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(move), dtype=np.int32)), pa.array(move), pa.array(np.full(len(move), n))], ["i", "move", "n"])

        moves = dealt.select("classes").mapInArrow(tidied(run), "i int, move double, n long").groupBy("i").agg(F.sum(F.col("move") * F.col("n")) / F.sum("n"), F.sum("n"))
        by, n = np.zeros(len(network.flat())), 0
        for i, move, n in moves.collect():  # as many as there are weights
            by[i] = move
        seen += n
        network = network.moved(by)
        shared.unpersist()
    assert seen == total, (seen, total)
    return network


def _one_after_another(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts one after the other, and where they start."""
    return np.frombuffer(b"".join(texts), np.uint8).astype(np.int32), np.cumsum([0, *map(len, texts)])[:-1]


class Scorer:
    """What a task needs: network, vocabulary, logarithms of counts of head words and of class totals."""

    def __init__(self, network: LogBilinear, vocabulary: Vocabulary, count: np.ndarray, tail_words: np.ndarray):
        """count: training count of each code; tail_words: known words outside the head, by class."""
        head = count[: vocabulary.size]
        by_class = np.zeros(CLASSES)
        np.add.at(by_class, vocabulary.classes, count)
        self.network, self.vocabulary = network, vocabulary
        self.n = int(count.sum())
        known = np.append(head > 0, np.zeros(CLASSES, bool))
        known[vocabulary.size + END] = count[vocabulary.size + END] > 0
        self.known = known
        self.distinct = int(known.sum() + tail_words.sum())
        self.log_count = np.log10(np.append(head, np.zeros(CLASSES)) + SMOOTH)
        self.log_count[vocabulary.size + END] = np.log10(count[vocabulary.size + END] + SMOOTH)
        self.log_count[vocabulary.size : vocabulary.size + END] = 0  # these come from the shuffle
        self.log_all = np.log10(self.n + SMOOTH * (self.distinct + 1))
        words = tail_words.astype(float)
        np.add.at(words, vocabulary.classes[: vocabulary.size], head > 0)
        own = vocabulary.single.copy()
        own[vocabulary.size + END] = True  # a class of one: the class is the word
        self.within = np.where(own, 0, self.log_count - np.log10(by_class + SMOOTH * (words + 1))[vocabulary.classes])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known ones of the head, base and model scores without the logarithms of other words' counts."""
        words = [tokens(t) for t in texts]
        codes, starts = joined(words, self.vocabulary)
        classes = self.vocabulary.classes[codes]
        n = np.array([len(w) + 1 for w in words])
        add = lambda x: np.add.reduceat(x, starts)
        model = add(self.network.log10(classes, starts) + self.within[codes])
        return n, add(self.known[codes].astype(np.int64)), add(self.log_count[codes]) - n * self.log_all, model


def scored(docs: DataFrame, train: F.Column, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text); train: Column
    that tells training rows.

    Null and blank texts are their end only; very long ones are read whole. Repeated rows stay repeated and count as often;
    words that are equally frequent are ranked by their bytes. Without training rows nothing is known: the base is certain of the unknown (0), and the model knows its classes only. Other columns are not read."""
    ship(docs.sparkSession)
    rows = keyed(docs, train)
    vocabulary = ranked(rows)
    found = written(counted(rows, vocabulary))
    count = np.zeros(vocabulary.size + CLASSES, np.int64)
    for code, n in found.where("kind = 0").groupBy("word").agg(F.sum("known")).collect():  # at most HEAD + CLASSES rows
        count[code] = n
    by_class = np.zeros(CLASSES, np.int64)
    np.add.at(by_class, vocabulary.classes, count)
    network = trained(found.where("kind = 2").select("key", "classes"), by_class, seed)
    tail = found.where("kind = 1").withColumn("count", F.sum("known").over(Window.partitionBy("word")))
    tail = tail.select("word", "key", "n", "cls", "count")
    by_doc = tail.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("count") + SMOOTH)).alias("tail_log"), F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    tail_words = np.zeros(CLASSES, np.int64)
    for cls, n in found.where("kind = 1 and known > 0").groupBy("word").agg(F.first("cls").alias("cls")).groupBy("cls").agg(F.count("*")).collect():
        tail_words[cls] = n
    scorer = Scorer(network, vocabulary, count, tail_words)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            got = s.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, k) for x, k in zip(got, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], ["doc_id", "key", "n_tokens", "head_known", "base", "model"])

    part = rows.select("doc_id", "text", "key").mapInArrow(tidied(run, 256), f"doc_id {dict(docs.dtypes)['doc_id']}, key long, n_tokens long, head_known long, base double, model double")
    part = written(part)
    times = part.groupBy("key").agg(F.count("*").alias("times"))
    whole = part.join(times, "key").join(by_doc, "key", "left")
    more = F.coalesce(F.col("tail_log") / F.col("times"), F.lit(0.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce(F.col("tail_known") / F.col("times"), F.lit(0)).cast("long")).alias("n_known"), F.lit(scorer.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document with a model of those that aren't held out; see scored() for odd rows."""
    held_out = F.coalesce(fold(10) == 0, F.lit(False))
    return scored(table(spark, sf_dir, "documents"), ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
