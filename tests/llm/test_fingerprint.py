import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramforge.llm import fingerprint as op


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_digest_against_plain_loops(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert op.to_hex(*op.digests(texts)) == [op.brute_force(t) for t in texts]


def test_score_is_bounded_and_small_for_near_copies(words):
    a, b = words(1, 300), words(2, 300)
    near = a.replace(a.split()[7], "changed", 1)
    da, db, dn = (op.brute_force(t) for t in (a, b, near))
    assert op.difference(da, da) == 0
    assert op.difference(da, dn) < op.difference(da, db) <= op.MAX_SCORE
    assert op.difference("ff" + "ff" * 32, "00" * 33) == op.MAX_SCORE


@pytest.mark.parametrize("limits", [(50_000, 2_000_000), (7, 60)])
def test_nearest_against_all_pairs(spark, docs, words, monkeypatch, limits):
    monkeypatch.setattr(op, "PASS_REFERENCES", limits[0])
    monkeypatch.setattr(op, "CELLS", limits[1])
    r = random.Random(2)
    refs = [(i, words(i % 20, 40)) for i in range(25)]
    rows = [(100 + i, words(i % 30, r.randint(20, 90))) for i in range(40)]
    got = op.fingerprint_documents(docs(rows), items(spark, refs)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        own = op.brute_force(texts[row["doc_id"]])
        assert row["digest"] == own
        assert (row["score"], row["nearest_item_id"]) == min((op.difference(own, op.brute_force(t)), i) for i, t in refs)


def test_nulls_short_texts_ties_and_clashes(spark, docs, clash):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "abc abc"), (4, "abc abc"), (None, "abc abc")]
    refs = items(spark, [(9, "abc abc"), (7, "abc abc"), (None, "abc abc"), (8, None)])
    got = sorted(op.fingerprint_documents(docs(rows, clash), refs).collect(), key=str)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["digest"], by[1]["score"], by[1]["nearest_item_id"]) == (None, None, None)
    assert by[2]["digest"] == "00" * 33 and by[3]["digest"] == "02" + "00" * 32
    assert (by[4]["nearest_item_id"], by[4]["score"]) == (by[None]["nearest_item_id"], by[None]["score"]) == (7, 0)


def test_long_text_counts_whole():
    head = "ab " * 400_000
    assert op.brute_force("x" * 10 + "abc") != op.brute_force("x" * 13)
    q = op.bucket_counts([head.encode(), (head + "zzz" * 100_000).encode()])
    assert q[0].sum() == len(head) - 2 and q[1].sum() == len(head) + 300_000 - 2


def test_no_references_and_empty_table(spark, docs):
    (row,) = op.fingerprint_documents(docs([(1, "some text")])).collect()
    assert row["digest"] and row["score"] is None
    assert op.fingerprint_documents(docs([]), items(spark, [])).count() == 0


def brute_classes(rows, near):
    """{(id, digest): (class, links)} of rows with an id and a text."""
    known = [(i, op.brute_force(t)) for i, t in rows if i is not None and t is not None]
    root, links = {i: i for i, _ in known}, [0] * len(known)
    for x, (i, a) in enumerate(known):
        for y, (j, b) in enumerate(known):
            if x != y and op.difference(a, b) <= near:
                links[x] += 1
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {(i, d): (root[i], n) for (i, d), n in zip(known, links, strict=True)}


@pytest.mark.parametrize(("small", "block"), [(256, 16_384), (2, 16_384), (256, 3), (2, 3)])
def test_classes_against_all_pairs(docs, words, monkeypatch, small, block):
    monkeypatch.setattr(op, "SMALL_CELL", small)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "BUFFER", 50)
    rows = []
    for base in range(12):
        text = words(base, 400).split()
        for k in range(5):
            rows.append((100 * base + k, " ".join(text[: 30 * k] + text[31 * k :])))
    rows += [(5000 + k, rows[0][1]) for k in range(4)] + [(5000, rows[0][1]), (6000, None), (None, rows[0][1]), (6001, ""), (6002, "ab"), (6003, rows[20][1]), (6003, rows[40][1])]
    got = op.fingerprint_classes(docs(rows)).collect()
    assert len(got) == len(rows)
    expected = brute_classes(rows, op.NEAR)
    for r in got:
        if r["doc_id"] is None or r["digest"] is None:
            assert r["class_doc_id"] is None and r["links"] is None
        else:
            assert r["links"] <= expected[(r["doc_id"], r["digest"])][1]
    exact = [(r["class_doc_id"], r["links"]) == expected[(r["doc_id"], r["digest"])] for r in got if r["links"] is not None]
    assert sum(exact) >= 0.9 * len(exact)
    assert sum(r["links"] or 0 for r in got) >= 0.9 * sum(expected[(r["doc_id"], r["digest"])][1] for r in got if r["links"] is not None) > 50
    assert op.fingerprint_classes(docs([])).count() == 0


def test_query_finds_near_copies_among_documents(spark, docs, words, tmp_path):
    from gramforge.llm import queries

    base = words(1, 400)
    docs([(1, base), (2, base.replace(base.split()[7], "changed", 1)), (3, words(2, 400)), (4, base)]).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, [(9, words(1, 30))]).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op4_fingerprint(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["class_doc_id"], r["links"]) for r in got} == {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 1, 2)}
    assert all(r["nearest_item_id"] == 9 for r in got)


def test_ids_of_other_types_and_large_ids(spark, words):
    base = words(1, 400)
    near = base.replace(base.split()[7], "changed", 1)
    df = spark.createDataFrame([("b", base), ("a", near), ("c", base), (None, base)], "key string, body string")
    refs = spark.createDataFrame([("y", base), ("x", base), (None, base), ("z", None)], "item string, text string")
    got = op.fingerprint_classes(df, refs, "key", "body", "item").collect()
    assert {(r["key"], r["class_key"], r["links"]) for r in got} == {("a", "a", 2), ("b", "a", 2), ("c", "a", 2), (None, None, None)}
    assert {(r["nearest_item"], r["score"]) for r in got if r["key"] == "b"} == {("x", 0)}
    big = 2**53
    df = spark.createDataFrame([(big + 1, base), (big + 2, base), (None, base)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["class_doc_id"]) for r in op.fingerprint_classes(df).collect()} == {(big + 1, big + 1), (big + 2, big + 1), (None, None)}


def test_without_broadcasts(spark, docs, words, monkeypatch):
    """Beyond the bounds, with sides that are shuffled."""
    monkeypatch.setattr(op, "BROADCAST_DIGESTS", 0)
    base = words(1, 400)
    rows = [(1, base), (2, base.replace(base.split()[7], "changed", 1)), (3, words(2, 400)), (4, base), (None, base)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = op.fingerprint_classes(docs(rows)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["doc_id"], r["class_doc_id"], r["links"]) for r in got} == {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 1, 2), (None, None, None)}


def test_pairs_at_the_bound_share_a_cell():
    """Sixteen buckets one step apart, wherever they are; choices of positions lost some of these."""
    r = np.random.default_rng(8)
    q = r.integers(1, 3, size=(4000, op.BUCKETS)).astype(np.uint8)
    apart = np.argsort(r.random(q.shape), axis=1) < op.NEAR
    other = np.where(apart, 3 - q, q).astype(np.uint8)
    assert (np.abs(q.astype(int) - other).sum(axis=1) == op.NEAR).all()
    keys, others = op.cell_keys(q), op.cell_keys(other)
    assert (keys == others).any(axis=1).all()
    both, n = np.concatenate([q, other]), len(q)
    for t in range(op.TABLES):
        shared = np.flatnonzero(keys[:, t] == others[:, t])
        first = op._first_shared(op._bits(both), shared, shared + n, np.full(len(shared), t))
        assert (first == ~(keys[shared, :t] == others[shared, :t]).any(axis=1)).all()
