"""License scans: base places against brute force, rules one by one, suppression, odd rows."""

import re

import pytest

from matchloom.llm import license_rules, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_words long, base string, found string, label string"


def brute_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(hits)


def brute_found(text):
    """Every rule on every text without a gate, and suppression by looking at all pairs."""
    words = WORD.findall((text or "").translate(LOWER))
    joined = " " + " ".join(words) + " "
    own, order = license_rules.rules(), list(license_rules.TIERS)
    every = [(m.start(), m.end(), i) for i, r in enumerate(own) for m in re.finditer(r.pattern.pattern.decode(), joined)]
    rank = lambda x: (order.index(own[x[2]].tier), x[0], -x[1], x[2])
    kept = []
    for x in sorted(every, key=rank):
        if not any(k[0] <= x[0] and x[1] <= k[1] for k in kept):
            kept.append(x)
    return sorted((own[i].label, joined[:a].count(" "), joined[:b].count(" ") - 1) for a, b, i in kept)


def labels(text):
    words = licenses.words_of(text.encode())
    own, _ = licenses.compiled(license_rules.SIGNATURES)
    return [own[r].label for _, _, r in licenses.detections(b" " + b" ".join(words) + b" ", words)]


TEXTS = [
    "", None, " ", "MIT License", "mit-license, MIT_LICENSE; cc-by cc by CC BY-SA 4.0", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "gnu general public license " * 3_000, "é mit license ünder", "cc\x00by", "mitlicense amit license", "MIT Licence", "Apache licence version 2", "x " * 50_000 + "Apache License", "no licence here at all", "gnu general public", "Copyright (c) 2019 Foo. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal. MIT License",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 under the Apache License 2.0",
]


def test_every_rule_is_met_only_behind_its_gate():
    own = license_rules.rules()
    assert len(own) > 200 and len({r.name for r in own}) == len(own)
    for r in own:
        plain = r.pattern.pattern.decode().replace("licen[cs]e", "license").replace("non ?commercial", "commercial")
        assert all(g.decode() in plain for g in r.gate), r.name


@pytest.mark.parametrize("text, want", [
    ("SPDX-License-Identifier: MIT", ["mit"]), ("SPDX-License-Identifier: MIT-0", ["mit-0"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0-or-later"]), ("SPDX-License-Identifier: LGPL-2.1-only", ["lgpl-2.1-only"]),
    ("Released under the MIT License.", ["mit"]), ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]), ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]), ("the GNU Lesser General Public License", ["lgpl"]),
    ("CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0"]), ("http://creativecommons.org/licenses/by/4.0/", ["cc-by-4.0"]), ("MIT Licence", ["mit"]), ("Mit Freunden", []), ("a license to drive", []), ("released under the MIT", []),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", ["bsd"]), ("Do What The F*ck", []), ("MPL: This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mpl-2.0"]),
])
def test_rules(text, want):
    assert labels(text) == want


def test_hundreds_of_overlaps_are_resolved_as_by_all_pairs():
    text = "the gnu general public license version 2 and licensed under the gnu general public license version 3 mit license apache license cc by sa 4 0 " * 200
    own, _ = licenses.compiled(license_rules.SIGNATURES)
    words = licenses.words_of(text.encode())
    got = licenses.detections(b" " + b" ".join(words) + b" ", words)
    joined = f" {b' '.join(words).decode()} "
    assert sorted((own[r].label, joined[:a].count(" "), joined[:b].count(" ") - 1) for a, b, r in got) == brute_found(text)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "b", "f", "l") for i, t in enumerate(TEXTS)] + [(None, "MIT License", None, None, None, None)] * 2, SCHEMA)
    got = licenses.scan(docs).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in docs.collect()]
    for r, text in zip(got, [*TEXTS, "MIT License", "MIT License"]):
        n, hits = brute_base(text)
        assert (r.n_words, [(b.word, b.label) for b in r.base]) == (n, hits)
        if len(text or "") < 5_000:
            assert sorted((f.label, f.first_word, f.last_word) for f in r.found) == brute_found(text)
    assert licenses.scan(docs.limit(0)).collect() == []


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_licenses"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        r, (n, hits) = got[d.doc_id], brute_base(d.text)
        base = ",".join(sorted({label for _, label in hits}))
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(hits), base)
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        found = brute_found(d.text)
        assert r.labels == ",".join(sorted({label for _, label in hits} | {x[0] for x in found}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        some += bool(found)
    assert some
