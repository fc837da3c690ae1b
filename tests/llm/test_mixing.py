from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramforge.llm import mixing as op


@pytest.fixture(params=[20_000, 7])
def buckets(request, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ROWS", request.param)


def test_against_brute_force(spark, docs, words, buckets):
    rows = [(i, words(i, 5 + i % 40), "abc"[i % 7 % 3]) for i in range(120)]
    df = docs(rows)
    rates = [(r[0], r[1], r[2], r[3]) for r in op.rates(df, None, "source", "text").collect()]
    hashes = dict(df.select("doc_id", F.xxhash64(F.lit(op.SEED), "doc_id", "text")).collect())
    expected = op.brute_force([(i, "s" + s) for i, _, s in rows], rates, hashes.__getitem__)
    got = {r["_gf_row"]["doc_id"]: r["copies"] for r in op.mix_copies(df).collect()}
    assert got == expected
    for source, n, e, _ in rates:
        own = sum(c for i, c in got.items() if "s" + rows[i][2] == source)
        assert abs(own - n * e / op.UNIT) < 1


def test_target_weights(docs, words):
    rows = [(i, words(i, 20), "big" if i % 10 else "small") for i in range(400)]
    mixed = op.mix(docs(rows), {"big": 1, "small": 1})
    chars = {r["source"]: r["c"] for r in mixed.groupBy("source").agg(F.sum("n_chars").alias("c")).collect()}
    assert 0.9 < chars["big"] / chars["small"] < 1.1
    assert {r["source"] for r in op.mix(docs(rows), {"small": 3}).collect()} == {"small"}
    assert op.mix(docs(rows), {}).count() == 0


def test_nulls_repeats_and_clashes(docs, clash):
    rows = [(1, "abcd", "x"), (1, "abcd", "x"), (2, None, "x"), (3, "", "y"), (None, "abcd", None), (5, None, None)]
    df = docs(rows, clash)
    got = op.mix_copies(df).collect()
    assert len(got) == len(rows) and all(r["copies"] >= 0 for r in got)
    empty = [r["copies"] for r in got if r["_gf_row"]["source"] == "y"]
    assert empty == [1]
    assert op.mix(df).columns == df.columns


def test_copies_are_rows(docs, words):
    rows = [(i, words(i, 30), "a" if i < 5 else "b") for i in range(205)]
    counts = Counter(r["doc_id"] for r in op.mix(docs(rows), {"a": 1, "b": 1}).collect())
    assert min(counts[i] for i in range(5)) >= 15


def test_empty(docs):
    assert op.mix(docs([])).count() == 0


def test_fractional_weights(docs, words):
    rows = [(i, words(i, 20), "x" if i % 4 else "y") for i in range(400)]
    df = docs(rows)
    as_fractions = Counter(r["doc_id"] for r in op.mix(df, {"x": 0.7, "y": 0.3}).collect())
    assert as_fractions == Counter(r["doc_id"] for r in op.mix(df, {"x": 7, "y": 3}).collect())
    total, size = sum(r["n_chars"] for r in df.collect()), Counter()
    for i, n in as_fractions.items():
        size[rows[i][2]] += n * len(rows[i][1])
    assert abs(size["x"] / total - 0.7) < 0.01 and abs(size["y"] / total - 0.3) < 0.01


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_weights_that_are_none(docs, bad):
    with pytest.raises(ValueError):
        op.mix(docs([(1, "a", "x")]), {"x": bad, "y": 1})


def test_large_ids_next_to_null_ids_and_hot_ids(docs, words, monkeypatch):
    """Rows without an id are spread over the buckets by their texts."""
    monkeypatch.setattr(op, "BUCKET_ROWS", 20)
    rows = [(2**53 + 1, words(1, 9), "x")] + [(None, words(i, 9), "x") for i in range(300)]
    got = op.mix_copies(docs(rows), {"x": 1}).collect()
    assert [r["copies"] for r in got] == [1] * 301 and 2**53 + 1 in {r["_gf_row"]["doc_id"] for r in got}


def test_long_text_and_string_ids(spark, words):
    df = spark.createDataFrame([("a", words(1, 60_000), "x"), ("b", words(2, 10), "x"), ("b", words(2, 10), "x")], "doc_id string, text string, source string")
    assert sorted(r["_gf_row"]["doc_id"] for r in op.mix_copies(df).collect() for _ in range(r["copies"])) == ["a", "b", "b"]
