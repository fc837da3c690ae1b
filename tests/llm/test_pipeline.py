import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gramforge.llm import exact_dedup, mixing, packing, simhash, toxicity

from test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, docs, words, tmp_path_factory):
    rows = [(i, t, f"s{i % 3}") for i, t, _ in corpus(400)]
    labels = [(i, 1, y) for i, _, y in corpus(400)]
    rows += [(1000 + i, words(i % 40, 60), f"s{i % 2}") for i in range(60)]  # exact copies
    base = words(5000, 200).split()
    for k in range(12):  # near copies
        w = list(base)
        w[random.Random(k).randrange(200)] = "other"
        rows.append((2000 + k, " ".join(w), "s1"))
    rows += [(None, "a text without an id"), (3000, None), (3001, "")]
    d = tmp_path_factory.mktemp("sf")
    docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, labels


def test_stages_against_brute_force(spark, folder, tmp_path):
    d, rows, labels = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        out = f"{tmp_path}/{k}"
        stage(spark, docs, d).write.parquet(out)
        after = spark.read.parquet(out)
        got = after.toPandas()
        pairs = [(None if i != i else int(i), t) for i, t in zip(before["doc_id"], before["text"], strict=True)]
        ids = sorted((-1 if i != i else int(i)) for i in got["doc_id"])
        key = lambda i: -1 if i is None else i
        if name == "toxicity":
            scores = toxicity.document_scores([t for _, t in pairs], model)
            assert ids == sorted(key(i) for (i, _), s in zip(pairs, scores, strict=True) if s < model.threshold)
            toxic = {i for i, _, y in labels if y}
            assert len(toxic & set(ids)) <= 0.02 * len(toxic)
            assert {i for i, _, y in labels if not y} <= set(ids) and {1000, 2000, 3000, 3001} <= set(ids)
        elif name == "exact_dedup":
            gone = {i for i, _ in exact_dedup.brute_force(pairs)}
            assert ids == sorted(key(i) for i, _ in pairs if i not in gone)
        elif name == "simhash_near_dedup":
            fps = {i: simhash.fingerprint(t) for i, t in pairs if t and i is not None}
            fps = {i: f for i, f in fps.items() if f}
            root = {i: i for i in fps}
            for a in fps:
                for b in fps:
                    if a < b and sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) <= simhash.THRESHOLD:
                        ra, rb = root[a], root[b]
                        for i, r in root.items():
                            if r == max(ra, rb):
                                root[i] = min(ra, rb)
            assert ids == sorted(key(i) for i, _ in pairs if root.get(i, i) == i)
            assert [i for i in ids if 2000 <= i < 2100] == [2000]
        elif name == "mixing":
            rates = [tuple(r) for r in mixing.rates(docs, None, "source", "text").collect()]
            copies = {r["_gf_row"]["doc_id"]: r["copies"] for r in mixing.mix_copies(docs).collect()}
            assert ids == sorted(key(i) for i, c in copies.items() for _ in range(c))
            for source, n, e, _ in rates:
                own = sum(copies[r["doc_id"]] for r in docs.collect() if ("s" + r["source"]) == source)
                assert abs(own - n * e / mixing.UNIT) < 1
        else:
            tokens = {}
            for i, t in pairs:
                tokens[i] = tokens.get(i, 0) + len((t or "").split())
            packed = {None if i != i else int(i): n for i, n in got.groupby("doc_id", dropna=False)["tokens"].sum().items()}
            assert packed == {i: n for i, n in tokens.items() if n}
            assert all(n <= packing.CAPACITY for _, n in packing.windows_of(got))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == columns
            docs = spark.read.parquet(out)


def test_run_is_the_stages_one_after_another(spark, folder):
    d, _, _ = folder
    got = corpus_pipeline.run(spark, d).toPandas()
    assert list(got.columns) == ["doc_id", "begin", "tokens", "shard", "window"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    by = ["doc_id", "begin", "tokens"]
    assert sorted(map(tuple, got[by].fillna(-1).values.tolist())) == sorted(map(tuple, docs.toPandas()[by].fillna(-1).values.tolist()))


def test_empty_documents(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_near_copy_is_left_in(spark, docs, words, monkeypatch):
    """Copies at all distances up to the threshold, of more documents than a cell holds."""
    monkeypatch.setattr(simhash, "CELL", 20)
    rows, fps = [], {}
    for k in range(700):
        text = words(20_000 + k, 60).split()
        for j in range(2):
            edited = [f"e{k}x{i}" if j and i < 9 else w for i, w in enumerate(text)]
            rows.append((2 * k + j, " ".join(edited)))
            fps[2 * k + j] = simhash.fingerprint(rows[-1][1])
    f = np.array([fps[i] for i, _ in rows], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= simhash.THRESHOLD
    root = np.arange(len(f))
    while (low := np.where(near, root[None], len(f)).min(axis=1)).tolist() != root.tolist():
        root = low
    kept = corpus_pipeline.drop_near(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == np.flatnonzero(root == np.arange(len(f))).tolist()
    assert 100 < (root != np.arange(len(f))).sum() < 700


def test_texts_go_to_python_in_small_batches(spark, folder):
    d, _, _ = folder
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name in ("toxicity", "simhash_near_dedup"):
        spark.conf.unset(setting)
        dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        sizes = spark.range(0, 4_000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")
        assert max(r["n"] for r in sizes.collect()) <= corpus_pipeline.BATCH_ROWS
    spark.conf.unset(setting)
