import itertools
import math
import random
import re

import numpy as np

from gramforge.llm import toxicity as op

BAD = ["grublok", "grublokent", "grublokia", "snarfid"]


def corpus(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(r.choice(["ta", "mi", "ko", "re", "lu", "sen"]) for _ in range(r.randint(1, 4))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(40)] = r.choice(BAD)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    trans, start = np.array([[1.5, 0.4], [0.3, 2.0]]), np.array([0.9, 0.1])
    lengths = [1, 4, 6, 3]
    first = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
    e = r.normal(0, 2, len(first))
    expected = []
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = start[y[0]] * np.prod([np.exp(e[at + k]) if y[k] else 1.0 for k in range(n)])
            w *= np.prod([trans[a, b] for a, b in zip(y, y[1:], strict=False)])
            total += w
            on += w * np.array(y)
        expected += list(on / total)
        at += n
    for run in (1, 2, 5, 128):
        p, _, _ = op.marginals(e, first, trans, start, run)
        assert np.allclose(p, expected)


def test_held_out_accuracy_and_unseen_inflections():
    model = op.fit(corpus(600))
    held = corpus(400, seed=1)
    scores = op.document_scores([t for _, t, _ in held], model)
    truth = np.array([bool(y) for _, _, y in held])
    assert ((scores >= model.threshold) == truth).mean() > 0.98
    assert op.document_scores(["taso grublokunk mi"], model)[0] > op.document_scores(["taso misenko mi"], model)[0]


def test_spans_offsets_and_defined_cases(spark, docs, clash):
    rows = corpus(400)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    df = docs([(i, t) for i, t, _ in rows], clash)
    model = op.train(df, labels)
    text = "tami grublok snarfid, re!"
    probe = docs([(1, text), (2, None), (3, ""), (4, "..."), (5, "tami re"), (1, text), (None, text)], clash)
    got = {(r["doc_id"], r["toxic_score"] >= 0.5, tuple((s["start"], s["end"]) for s in r["toxic_spans"])) for r in op.tag_toxicity(probe, model).collect()}
    assert got == {(1, True, ((5, 20),)), (None, True, ((5, 20),)), *((i, False, ()) for i in (2, 3, 4, 5))}
    kept = op.drop_toxic(probe, model)
    assert kept.columns == probe.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert {r["doc_id"] for r in op.toxic_documents(probe, model).collect()} == {1, None}


def test_copies_do_not_make_markers():
    rows = corpus(300)
    copied = "unique words of one much copied document only " * 3
    rows += [(1000 + i, copied + BAD[0] + " " + str(i), 1) for i in range(100)]
    model = op.fit(rows)
    assert op.document_scores(["words of a document"], model)[0] < model.threshold


def test_no_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = docs([(1, "grublok")])
    assert op.train(df, none) is None
    assert op.toxic_documents(df, None).count() == 0 and op.drop_toxic(df, None).count() == 1
    model = op.fit(corpus(300))
    assert op.tag_toxicity(docs([]), model).count() == 0


def test_long_text_is_tagged_whole(docs):
    model = op.fit(corpus(400))
    long = "tami reko " * 300_000 + "grublok"
    (row,) = op.tag_toxicity(docs([(1, long)]), model).collect()
    assert [(s["start"], s["end"]) for s in row["toxic_spans"]] == [(3_000_000, 3_000_007)]


def brute_score(text, model):
    """(score, spans) by plain loops over one chain, in logarithms."""
    found = list(re.finditer(r"\w+", text or ""))
    if not found:
        return 0.0, []
    e = [min(max(model.bias + sum(model.weights.get(f, 0.0) for f in op.token_features(m.group())), -40.0), 40.0) for m in found]
    trans, start, n = np.log(model.transition), np.log(model.start), len(e)
    forward, backward = [[start[0], start[1] + e[0]]], [[0.0, 0.0]]
    for t in range(1, n):
        forward.append([np.logaddexp(forward[-1][0] + trans[0, j], forward[-1][1] + trans[1, j]) + (e[t] if j else 0.0) for j in (0, 1)])
        k = n - t
        backward.append([np.logaddexp(trans[i, 0] + backward[-1][0], trans[i, 1] + e[k] + backward[-1][1]) for i in (0, 1)])
    backward.reverse()
    p = [1 / (1 + math.exp(min(700.0, f[0] + b[0] - f[1] - b[1]))) for f, b in zip(forward, backward, strict=True)]
    top = min(max(max(p), 1e-4), 1 - 1e-4)
    x = model.document @ np.array([1.0, math.log(sum(q * q for q in p) + 0.05), math.log(top / (1 - top)), math.log(n)])
    spans, last = [], None
    for k, (m, q) in enumerate(zip(found, p, strict=True)):
        if q >= op.SPAN_THRESHOLD:
            spans = [*spans[:-1], (spans[-1][0], m.end())] if last == k - 1 and spans else [*spans, (m.start(), m.end())]
            last = k
    return 1 / (1 + math.exp(-x)), spans


def test_scores_and_spans_by_plain_loops(spark, docs):
    rows = corpus(300)
    model = op.fit(rows)
    texts = [t for _, t, _ in corpus(60, seed=3)] + ["", "?!", "grublok", "tami GRUBLOK grublokia, snarfid; re grublokent"]
    got = {r["doc_id"]: r for r in op.tag_toxicity(docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        score, spans = brute_score(t, model)
        assert abs(got[i]["toxic_score"] - score) < 1e-6 and [tuple(s) for s in got[i]["toxic_spans"]] == spans, t
    assert sum(bool(r["toxic_spans"]) for r in got.values()) > 10


def test_ids_of_other_types_and_ties(spark):
    rows = corpus(300)
    labels = spark.createDataFrame([(f"k{i}", y) for i, _, y in rows], "key string, toxic int")
    df = spark.createDataFrame([(f"k{i}", t) for i, t, _ in rows] + [(None, rows[0][1])], "key string, text string")
    model = op.train(df, labels, "key")
    found = {r["key"]: r["toxic_score"] for r in op.toxic_documents(df, model, "key").collect()}
    assert None in found and len(set(found) & {f"k{i}" for i, _, y in rows if y}) >= 70
    # A score equal to the threshold is toxic.
    model.threshold = found["k0"]
    assert "k0" in {r["key"] for r in op.toxic_documents(df, model, "key").collect()}
    assert "k0" not in {r["key"] for r in op.drop_toxic(df, model).collect()}
