"""License scans: ordered signature rules behind a keyword prefilter.

A text's words are lower-cased and joined by single spaces. The words that gates name are looked up in one pass; only rules whose
gate is met run, each over the whole text. A detection inside another of a stronger tier, or inside an earlier or longer one of its
own tier, is suppressed. Beside that, fixed phrases are counted wherever their words stand; nothing suppresses those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import ship, table, tidied
from matchloom.llm.license_rules import SIGNATURES, TIERS, Rule, rules

#: The phrases counted as they stand, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Each byte as words keep it: A-Z lower-cased, other ASCII that is no letter or digit a space; bytes of other letters as they are.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@lru_cache(maxsize=4)
def compiled(signatures: str) -> tuple[tuple[Rule, ...], frozenset[bytes]]:
    """The rules, and all words of their gates. Made once in a worker."""
    own = rules(signatures)
    return own, frozenset().union(*(r.gate for r in own), [b"licence"])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_AS_WORDS).split()


def phrase_places(joined: bytes) -> list[tuple[int, str]]:
    """(byte, label) of every place where a phrase's words stand, by place."""
    out = []
    for phrase, label in PHRASES.items():
        needle = f" {phrase} ".encode()
        i = joined.find(needle)
        while i >= 0:
            out.append((i, label))
            i = joined.find(needle, i + 1)
    return sorted(out)


def unsuppressed(found: list[tuple[int, int, int]], own: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule) those inside no other that goes before: tier by tier, within a tier from left to right with the longer
    and then the earlier rule first."""
    kept: list[tuple[int, int, int]] = []
    for tier in TIERS:
        starts = np.array([a for a, _, _ in kept], np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b, _ in kept], np.int64)) if kept else starts
        new, furthest = [], -1
        for a, b, r in sorted((x for x in found if own[x[2]].tier == tier), key=lambda x: (x[0], -x[1], x[2])):
            before = int(np.searchsorted(starts, a, "right"))
            if b > furthest and not (before and reach[before - 1] >= b):
                new.append((a, b, r))
                furthest = b
        kept = sorted(kept + new)
    return kept


def detections(joined: bytes, words: list[bytes], signatures: str = SIGNATURES) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes of ` word word .. ` that stay, by place."""
    own, gates = compiled(signatures)
    held = gates.intersection(words)
    if b"licence" in held:
        held |= {b"license"}
    return unsuppressed([(m.start(), m.end(), i) for i, r in enumerate(own) if r.gate <= held for m in r.pattern.finditer(joined)], own) if held else []


def word_numbers(joined: bytes, places: list[int]) -> list[int]:
    """Which word follows the space at each of the ascending places."""
    out, at, n = [], 0, 0
    for p in places:
        n += joined.count(b" ", at, p)
        at = p
        out.append(n)
    return out


FOUND = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def scan(docs: DataFrame, signatures: str = SIGNATURES) -> DataFrame:
    """doc_id, n_words, base (places of the phrases: label, word), found (unsuppressed detections: label, rule, first_word, last_word
    inclusive, score), for each row of docs(doc_id, text); words are numbered from 0, both arrays are in order of place.

    Null text counts as empty: no words, empty arrays. Repeated rows stay repeated, an empty table gives no rows; other columns are
    not read; texts are read whole, however long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = compiled(signatures)
        for batch in batches:
            counts, base, found = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                joined = b" " + b" ".join(words) + b" "
                places = phrase_places(joined)
                base.append([{"label": x, "word": n} for (_, x), n in zip(places, word_numbers(joined, [p for p, _ in places]))])
                stay = detections(joined, words, signatures)
                firsts = word_numbers(joined, [a for a, _, _ in stay])
                found.append([{"label": own[r].label, "rule": own[r].name, "first_word": n, "last_word": n + joined.count(b" ", a + 1, b), "score": TIERS[own[r].tier]} for (a, b, r), n in zip(stay, firsts)])
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(base, BASE), pa.array(found, FOUND)], ["doc_id", "n_words", "base", "found"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,rule:string,first_word:long,last_word:long,score:double>>")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every document. score: of the surest detection that stays, a phrase counting as a name; 0 without any."""
    rows = scan(table(spark, sf_dir, "documents"))
    spelt = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    named = F.when(F.size("base") > 0, F.lit(TIERS["name"])).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        spelt(F.col("base.label")).alias("base_labels"), spelt(F.concat("base.label", "found.label")).alias("labels"), F.greatest(F.coalesce(F.array_max("found.score"), F.lit(0.0)), named).alias("score"),
    )
