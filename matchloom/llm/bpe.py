"""Byte-level BPE by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that accepts exactly the token sequences
that the merges produce (after Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA").
It starts as one state with a loop for every byte. The gadget of a merge u v -> c, applied in order of the
merges: the state that u leads to loses its arc v (after being split from other labels that lead to it), and
every state with an arc u gets an arc c, to the state that v leads to. All arcs with one label lead to one
state, so a state is kept as what it was split from, when, and the arcs it lost; the transition table is
filled from that as pairs come up. A word has one accepted path; it is found left to right, taking the longest
arc label that matches and, where the automaton has no such arc, the next shorter one. Decoding emits labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import ship, table, tidied

#: Entries after which a table of words or transitions is started anew; it bounds a worker's memory (some 400 bytes
#: an entry of either table of words). Jobs that do nothing else take the first number, pipelines the second.
MOST_WORDS, FEWER_WORDS, MOST_ARCS = 600_000, 120_000, 500_000
#: The pre-tokenizer's pattern of the byte-level vocabulary, white space spelt as a property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Letters and numbers assigned after Unicode 16, which the library's pre-tokenizer takes for symbols.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d \U000107bb-\U000107bf \U00010940-\U00010959 "
    "\U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 "
    "\U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 "
    "\U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed "
    "\U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        """Compiles the merges, gadget after gadget."""
        self.label = {i: b for b, i in vocab.items()}
        self.ids = vocab
        self.length = {i: len(b) for b, i in vocab.items()}
        self.reach: dict[bytes, int] = {}  # the longest label that starts with these three bytes
        for b in vocab:
            self.reach[b[:3]] = max(self.reach.get(b[:3], 0), len(b))
        self.split_of, self.born, self.lost = [-1], [-1], [{}]
        self.made: dict[int, int] = {}  # label: merge that made it
        self.first: dict[int, int] = {}  # label: left part
        self.to: dict[int, int] = {}  # label: state it leads to
        self.users = {0: 0}
        for b in range(256):
            if bytes([b]) in vocab:
                t = vocab[bytes([b])]
                self.to[t], self.made[t] = 0, -1
                self.users[0] += 1
        for k, (left, right) in enumerate(merges):
            self._gadget(k, vocab[left], vocab[right], vocab[left + right])
        self.arcs: dict[int, bool] = {}
        self.shorter = {i: next((vocab[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in vocab and vocab[b[:n]] in self.to), -1) for b, i in vocab.items()}

    def _gadget(self, k: int, u: int, v: int, c: int) -> None:
        if u not in self.to or v not in self.to or c in self.to or not self._arc(self.to[u], v, k):
            return
        at, target = self.to[u], self.to[v]
        if self.users[at] > 1 or target == at:
            self.users[at] -= 1
            self.split_of.append(at)
            self.born.append(k)
            self.lost.append({v: k})
            self.to[u] = len(self.lost) - 1
            self.users[self.to[u]] = 1
        else:
            self.lost[at][v] = k
        self.to[c], self.made[c], self.first[c] = target, k, u
        self.users[target] += 1

    def _arc(self, state: int, label: int, when: int) -> bool:
        """Whether the state has an arc with the label, as far as the losses up to merge `when`."""
        while True:
            if self.lost[state].get(label, 1 << 41) <= when:
                return False
            made, born = self.made[label], self.born[state]
            if made < 0 and born < 0:
                return True
            if born > made:  # the state was split off later: it took over what the other had then
                state, when = self.split_of[state], born
            else:
                label, when = self.first[label], made

    def arc(self, state: int, label: int) -> bool:
        key = state << 20 | label
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._arc(state, label, 1 << 40)
        return found

    def encode_word(self, w: bytes) -> list[int]:
        """The labels of the accepted path that spells w."""
        ids, to, length, arcs, reach, end = self.ids, self.to, self.length, self.arcs, self.reach, len(w)
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        i, t, state = 0, -2, 0
        while i < end:
            if t == -2:
                n = min(end - i, reach.get(w[i : i + 3], 2))
                t = ids.get(w[i : i + n], -1)
                while n > 1 and t not in to:
                    n -= 1
                    t = ids.get(w[i : i + n], -1)
            while t >= 0:
                if i + length[t] not in dead:
                    found = arcs.get(state << 20 | t)
                    if found or found is None and self.arc(state, t):
                        break
                t = self.shorter[t]
            if t < 0:
                if not out:
                    raise ValueError(f"no path spells {w!r}")
                dead.add(i)
                t, i = self.shorter[out.pop()], starts.pop()
                state = to[out[-1]] if out else 0
                continue
            out.append(t)
            starts.append(i)
            i += length[t]
            state, t = to[t], -2
        return out


class Codec:
    """Encodes and decodes texts as the vocabulary file says."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.most = most_words
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        spelt = lambda s: bytes(letters[c] for c in s)
        vocab = {spelt(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [tuple(map(spelt, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.automaton = Automaton(vocab, merges)
        self.special = special
        self.labels = self.automaton.label | {i: s.encode() for s, i in special.items()}
        self.words = regex.compile(PATTERN)
        self.newer = regex.compile(f"[{NEWER}]")
        older = lambda p: f"(?:(?![{NEWER}]){p})"
        letters, numbers = older(r"\p{L}"), older(r"\p{N}")
        other = rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{NEWER}])"
        self.words_with_newer = regex.compile(PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", other).replace(r" ?\p{L}", " ?" + letters).replace(r" ?\p{N}", " ?" + numbers))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.by_word: dict[str, list[int]] = {}
        self.by_piece: dict[str, tuple] = {}

    def _encode_plain(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.by_word
        words = self.words if text.isascii() or not self.newer.search(text) else self.words_with_newer
        for w in words.findall(text):
            ids = known.get(w)
            if ids is None:
                if len(known) >= self.most:
                    known.clear()
                ids = known[w] = self.automaton.encode_word(w.encode())
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not self.at_special or not any(s in text for s in self.special):
            return self._encode_plain(text)
        out: list[int] = []
        for k, part in enumerate(self.at_special.split(text)):
            out += [self.special[part]] if k % 2 else self._encode_plain(part)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        labels = self.labels
        return b"".join([labels[i] for i in ids if i in labels])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def _piece(self, p: str) -> tuple:
        if len(self.by_piece) >= self.most:
            self.by_piece.clear()
        ids = self.encode(p)
        got = self.by_piece[p] = (",".join(map(str, ids)), self.decode_bytes(ids), len(ids))
        return got

    def pieces(self, text: str) -> list[tuple]:
        """Pieces of the text, each as ids (written out), decoded bytes and number of ids.

        A space between two characters that are no white space starts a word of its own, whatever stands before
        it; such texts are put together from pieces, each cut before its space and encoded once per worker."""
        special = self.at_special and any(s in text for s in self.special)
        cut = text.replace(" ", "\0 ").split("\0") if not special and "\0" not in text else [text]
        if len(cut) > 1 and not any(len(p) < 2 or p[1].isspace() or p[-1].isspace() for p in cut[1:]) and cut[0] and not cut[0][-1].isspace():
            known, new = self.by_piece.get, self._piece
            return [known(p) or new(p) for p in cut]
        ids = self.encode(text)
        return [(",".join(map(str, ids)), self.decode_bytes(ids), len(ids))] if ids else []

    def digest(self, text: str, pieces: list[tuple] | None = None) -> tuple[int, str, str]:
        """Number of ids, their digest and that of the decoded text."""
        got = self.pieces(text) if pieces is None else pieces
        return sum([x[2] for x in got]), hashlib.sha256(",".join([x[0] for x in got]).encode()).hexdigest(), self._of_decoded(b"".join([x[1] for x in got]))

    @staticmethod
    def _of_decoded(b: bytes) -> str:
        try:
            b.decode()
        except UnicodeDecodeError:
            b = b.decode("utf-8", errors="replace").encode()
        return hashlib.sha256(b).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str, most_words: int = MOST_WORDS) -> Codec:
    """One per worker and vocabulary file; tasks of a worker share it."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    _CODECS[path].most = most_words
    return _CODECS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), ids_sha256, decoded_sha256 for each row of docs(doc_id, text).
    Null and empty texts have no ids; repeated rows stay repeated; texts are encoded whole, however long; an empty table
    gives no rows. Other columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, FEWER_WORDS)
        for b in batches:
            got = [c.pieces(t or "") for t in b.column(1).to_pylist()]
            digest = [c.digest("", p) for p in got]
            offsets = pa.array([0, *accumulate(d[0] for d in digest)], pa.int32())
            written_out = ",".join([x[0] for p in got for x in p])
            values = pa.array(np.fromstring(written_out, np.int32, sep=",") if written_out else np.empty(0, np.int32))
            n, ids, decoded = zip(*digest)
            del got
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        _CODECS.clear()  # stages of a pipeline share workers: leave none of it behind

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows with their ids (array of int) decoded to `text`: the automaton's arc labels, one after the other. Null ids give
    null, ids that the vocabulary lacks nothing."""
    ship(rows.sparkSession)

    @F.pandas_udf("string", F.PandasUDFType.SCALAR)
    def emit(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode([int(i) for i in x]))

    return rows.withColumn("text", emit(F.col("ids")))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs(doc_id, text).

    Null text counts as empty: no tokens, digests of nothing. Repeated rows stay repeated, other columns are not
    read. Texts are encoded whole; a worker keeps at most MOST_WORDS words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = [c.digest(t or "") for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; see digests() for odd rows."""
    return digests(table(spark, sf_dir, "documents"), default_path())
