import hashlib
import random
import re
from collections import Counter

from gramforge.llm import licenses as op


def brute(rows):
    known = op.known_digests()
    out = Counter()
    for i, t in rows:
        if t is None:
            continue
        for scope, unit in [("document", t), *(("line", x) for x in re.split("[\r\n]+", t))]:
            spdx = known.get(hashlib.md5(op.canonical_text(unit).encode()).hexdigest())
            if spdx:
                out[(i, spdx, scope)] += 1
    return sorted(((*k, n) for k, n in out.items()), key=str)


def run(df):
    return sorted(((r["doc_id"], r["license"], r["scope"], r["n"]) for r in op.scan_licenses(df).collect()), key=str)


def test_against_brute_force(docs, words, clash):
    mit = op._MIT
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Some One\n" + mit.upper().replace("LICENSE", "LICENCE")),
        (3, mit.replace(", ", " - ").replace("\n", "\n\n")),
        (4, mit + " and more"),
        (5, words(1, 30) + "\nLicensed under the MIT Licence!\n" + words(2, 5) + "\nlicensed under the mit license"),
        (6, "Licensed under the Apache License v2.0"),
        (7, "SPDX-License-Identifier: GPL-3.0"),
        (8, None), (9, ""), (10, "?!"), (1, mit), (None, "License: ISC"), (11, words(3, 100)),
    ]
    got = run(docs(rows, clash))
    assert got == brute(rows)
    found = {(i, s, scope): n for i, s, scope, n in got}
    assert found[(2, "MIT", "document")] == found[(3, "MIT", "document")] == 1
    assert found[(1, "MIT", "document")] == 2 and found[(5, "MIT", "line")] == 2
    assert not any(i in (4, 8, 9, 10, 11) for i, *_ in found)
    assert found[(None, "ISC", "line")] == 1


def test_precedence_of_equal_texts(monkeypatch, docs):
    monkeypatch.setattr(op, "KNOWN", [("B", "same text."), ("A", "Same Text")])
    assert run(docs([(1, "same text")])) == [(1, "B", "document", 1), (1, "B", "line", 1)]


def test_long_text_and_empty(docs, words):
    long = "\n".join(words(i, 200) for i in range(200)) + "\nReleased under the MIT License."
    assert run(docs([(1, long)])) == [(1, "MIT", "line", 1)]
    assert run(docs([])) == []


def test_known_licenses_by_their_full_texts():
    assert set(op.known_digests().values()) >= {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "GFDL-1.3-only"}
    assert {n for n, t in op.KNOWN if op.canonical_text(t).startswith("bsd")} == {"BSD-2-Clause", "BSD-3-Clause"}


def test_words_are_in_raw_texts_if_in_canonical_ones():
    """What the words pass over cannot be a known text."""
    assert all(any(w in op.canonical_text(t) for w in op.WORDS) for _, t in op.KNOWN)
    r = random.Random(5)
    pieces = [x for pair in op.SPELLINGS for x in pair] + ["LICEN", "lic", "ence", "permissi", "on", "soft", "ware", "released", "re", "leased", "distrib", "uted", " ", "-", "\n", "(c) x", "Copyright", "s", "e"]
    for _ in range(20_000):
        raw = "".join(r.choice(pieces) for _ in range(r.randint(1, 6)))
        made = op.canonical_text(raw)
        assert all(w in raw.lower() for w in op.WORDS if w in made), raw


def test_a_table_of_known_texts(spark, docs, words):
    """Texts with and without the words, nulls, ties, in place of the built-in ones."""
    plain = [("B", "Use it freely!"), ("A", "use it, freely"), (None, "free"), ("C", None), ("D", "?!")]
    rows = [(1, "USE IT FREELY"), (2, words(1, 20) + "\nuse it freely\n"), (3, "free"), (4, "Licensed under the MIT License."), (5, ""), (6, "Do what you like with this software")]
    for more, expected in (([], []), ([("E", "do what you like with this software.")], [(6, "E", "document", 1), (6, "E", "line", 1)])):
        known = spark.createDataFrame(plain + more, "license string, text string")
        got = sorted(tuple(r) for r in op.scan_licenses(docs(rows), known=known).collect())
        assert got == sorted([(1, "A", "document", 1), (1, "A", "line", 1), (2, "A", "line", 1), *expected])
    only = spark.createDataFrame([("E", "do what you like with this software.")], "license string, text string")
    assert sorted(tuple(r) for r in op.scan_licenses(docs(rows), known=only).collect()) == [(6, "E", "document", 1), (6, "E", "line", 1)]
    assert op.scan_licenses(docs(rows), known=only.limit(0)).count() == 0
