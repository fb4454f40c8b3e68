"""Cross-tokenizer alignment against whole texts encoded by the libraries and links found pair by pair."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from matchloom.llm import queries, token_alignment
from matchloom.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, pairs string, links long, best string"


@pytest.fixture(scope="module")
def libraries():
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def brute(rows, libraries):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text), and the count of each pair."""
    a, b = libraries
    letters = byte_letters()
    out, every = [], Counter()
    for doc_id, text in rows:
        none = (doc_id, 0, 0, [], [])
        if not text:
            out.append(none)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not (b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode()):
            out.append(none)
            continue
        groups, links = [], []
        i = j = at_a = at_b = 0
        group_a, group_b = [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                at_a += len(spelt_a[i])
                group_a.append((ids_a[i], at_a - len(spelt_a[i]), at_a))
                i += 1
            else:
                at_b += len(spelt_b[j])
                group_b.append((ids_b[j], at_b - len(spelt_b[j]), at_b))
                j += 1
            if at_a == at_b:
                links += [(x, y) for x, s, e in group_a for y, u, v in group_b if s < v and u < e]
                groups.append(f"{','.join(str(x[0]) for x in group_a)}|{','.join(str(x[0]) for x in group_b)}")
                group_a, group_b = [], []
        every.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, y), n in every.items():
        most[y] = max(n, most.get(y, 0))
    return [(d, n, m, len(g), len(x), sum(every[p] == most[p[1]] for p in x), sum(every[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for d, n, m, g, x in out], every


TEXTS = [
    "", None, " ", "a", "  two  spaces ", "tail \n", "\n\n x\t y", "don't we'll I'd", "<s> </s> <|endoftext|> <0x41> <unk>", "café é 你好 \U0001f600 \u0007", "a▁b and more words", "word a▁", "▁ alone", "nul \x00 here", "﻿bom  nbsp 　wide",
    "same same same same", "x" * 3_000, "longest words of all " * 4_000, "12345 67 890,000.5", "line\r\nline", "Ünïcode straße naïve", "the the the cat", " lead", "\x1c sep \x1d\x85 next", "e ́ lone mark",
]


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 3])
def test_odd_rows_match_brute_force(spark, libraries, frequent):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (3, "the same"), (3, "the same")]
    docs = spark.createDataFrame([(i, t, 1, "p", 2, "b") for i, t in rows], SCHEMA)
    got, pairs = token_alignment.alignment(docs, A, B, frequent)
    want, every = brute(rows, libraries)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.links for r in pairs.collect()} == every
    assert sum(r[1] > 0 for r in want) > 20 and want[10][1] == 0


def test_empty_table(spark):
    got, pairs = token_alignment.alignment(spark.createDataFrame([], SCHEMA), A, B)
    assert got.collect() == [] and pairs.collect() == []


def test_store_of_words_starts_anew(monkeypatch):
    texts = [f"some words {i} and others {i * 7919} again" for i in range(60)]
    free = token_alignment.Pair(A, B).aligned(texts)
    monkeypatch.setattr(token_alignment, "MOST_LINKS", 20)
    both = token_alignment.Pair(A, B)
    parts = [both.aligned(texts[i : i + 7]) for i in range(0, 60, 7)]
    assert [d for p in parts for d in p[1]] == free[1] and len(both.code) < 60
    for k in (0, 2, 3, 4):
        assert [x for p in parts for x in p[k].tolist()] == free[k].tolist()


def test_query_matches_brute_force(spark, sf_dir, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.QUERIES["op12_token_alignment"](spark, sf_dir)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(brute(rows, libraries)[0])
