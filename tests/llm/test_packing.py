import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gramforge.llm import packing as op


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=14), st.integers(1, 5))
def test_differencing_against_list_version(sizes, k):
    sizes = sorted(sizes, reverse=True)
    window = op.differencing(np.array(sizes), k)
    sums = sorted(np.bincount(window, weights=sizes, minlength=k).astype(int).tolist(), reverse=True)
    brute = op.brute_force(sizes, k)
    assert sum(sums) == sum(brute) == sum(sizes)
    assert sums[0] - sums[-1] <= max(sizes)


def test_near_equal_windows():
    r = random.Random(3)
    sizes = np.array([r.randint(1, 2000) for _ in range(900)])
    k = 100
    sums = np.bincount(op.differencing(sizes, k), weights=sizes, minlength=k)
    assert sums.max() - sums.min() < 0.03 * sums.mean()


def test_window_count_rises_until_capacity_holds():
    sizes = np.array([60, 60, 60, 60, 60])
    window = op.pack(sizes, 100)
    assert len(set(window)) == 5


def test_every_token_once(docs, words, clash):
    rows = [(i, words(i, 30 + 7 * i)) for i in range(60)] + [(None, words(1, 20)), (3, None), (4, ""), (5, "  \n"), (7, words(7, 79))]
    rows.append((99, words(5, 5000)))
    got = op.pack_windows(docs(rows, clash), capacity=400, shard_tokens=3000).toPandas()
    for key, tokens in op.windows_of(got):
        assert tokens <= 400, key
    for i in {r[0] for r in rows}:
        own = got[got["doc_id"].isna()] if i is None else got[got["doc_id"] == i]
        assert own["tokens"].sum() == sum(len((t or "").split()) for j, t in rows if j == i)
    long = got[got["doc_id"] == 99].sort_values("begin")
    assert (long["begin"].to_numpy() == np.r_[0, long["tokens"].cumsum().to_numpy()[:-1]]).all()
    assert len(got) == sum(-(-len((t or "").split()) // 400) for _, t in rows)


def test_result_does_not_depend_on_row_order(docs, words):
    rows = [(i, words(i, 50)) for i in range(50)]
    a = op.pack_windows(docs(rows), capacity=128, shard_tokens=1000).toPandas()
    b = op.pack_windows(docs(rows[::-1]), capacity=128, shard_tokens=1000).toPandas()
    by = ["doc_id", "begin"]
    assert a.sort_values(by).reset_index(drop=True).equals(b.sort_values(by).reset_index(drop=True))


def test_empty(docs):
    assert op.pack_windows(docs([])).count() == 0
    assert op.pack_windows(docs([(1, None), (2, "")])).count() == 0


def test_large_ids_next_to_null_ids(docs, words):
    big = 9007199254740993
    got = {r["doc_id"] for r in op.pack_windows(docs([(big, words(1, 20)), (None, words(2, 20)), (7, words(3, 20))])).collect()}
    assert got == {big, None, 7}


def test_string_ids(spark, words):
    df = spark.createDataFrame([("b", words(1, 20)), (None, words(2, 20)), ("a", words(3, 20))], "doc_id string, text string")
    assert {r["doc_id"] for r in op.pack_windows(df).collect()} == {"a", "b", None}


def test_rows_alike_are_spread_over_shards(docs, words):
    text = words(1, 100)
    got = op.pack_windows(docs([(None, text)] * 500 + [(1, text)] * 7), capacity=400, shard_tokens=5000).toPandas()
    assert len(got) == 507 and got["tokens"].sum() == 50_700
    per_shard = got.groupby("shard")["tokens"].sum()
    assert len(per_shard) == -(-50_700 // 5000) and per_shard.max() - per_shard.min() <= 400
    assert all(n <= 400 for _, n in op.windows_of(got))
