"""The registered queries that SQL cannot express, on whole small tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_fingerprint import brute_classes
from test_html_density import brute_content
from test_pii import brute_redaction
from test_simhash import brute_pairs, near
from test_toxicity import brute_score, corpus

from gramforge.llm import fingerprint, mixing, packing, queries, simhash, toxicity


@pytest.fixture(scope="module")
def tables(spark, docs, words, tmp_path_factory):
    rows = [(i, t, f"s{i % 3}") for i, t, _ in corpus(300)]
    rows += [(1000 + i, words(i, 30) + f" mail{i}@host.example.com or 10.0.{i}.7", "mail") for i in range(20)]
    base = words(77, 200)
    rows += [(2000 + i, near(base, i, i), "s1") for i in range(8)] + [(3000, None, None), (3001, "", "s0"), (3002, words(5, 3000), "s2")]
    r = random.Random(1)
    pages = [(i, f"http://h{i % 3}.org/{i}", "<body><ul><li><a href=x>menu</a></ul><div>" + "".join("<p>" + words(100 * i + k, r.randint(5, 60)) + "</p>" for k in range(4)) + "</div></body>") for i in range(25)]
    items = [(i, words(i * 3, 30)) for i in range(10)]
    d = str(tmp_path_factory.mktemp("tables"))
    docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, pages, items


def test_toxicity(spark, tables):
    d, rows, _, _ = tables
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    plain = {i: brute_score(t, model) for i, t, _ in rows}
    result = queries.op1_toxicity(spark, d).collect()
    got = {r["doc_id"]: r["toxic_score"] for r in result}
    assert got == pytest.approx({i: s for i, (s, _) in plain.items() if s >= model.threshold})
    assert {r["doc_id"]: [tuple(s) for s in r["toxic_spans"]] for r in result} == {i: plain[i][1] for i in got}
    assert len({i for i, _, y in corpus(300) if y} - set(got)) <= 1


def test_packing(spark, tables):
    d, rows, _, _ = tables
    got = queries.op2_packing(spark, d).toPandas()
    assert got.groupby("doc_id")["tokens"].sum().to_dict() == {r[0]: len(r[1].split()) for r in rows if r[1]}
    sums = sorted(n for _, n in packing.windows_of(got))
    rest = sorted((len((r[1] or "").split()) % packing.CAPACITY for r in rows), reverse=True)
    rest = [n for n in rest if n]
    whole = [packing.CAPACITY] * sum(len((r[1] or "").split()) // packing.CAPACITY for r in rows)
    k = len(sums) - len(whole)
    assert sums[-1] <= packing.CAPACITY and k >= -(-sum(rest) // packing.CAPACITY)
    assert abs(max(sums) - max(whole + packing.brute_force(rest, k))) <= 1


def test_mixing(spark, tables):
    d, rows, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rates = [tuple(r) for r in mixing.rates(docs, None, "source", "text").collect()]
    hashes = dict(docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect())
    keyed = [(i, "n" if s is None else "s" + s) for i, _, s in rows]
    got = {r["doc_id"]: r["copies"] for r in queries.op3_mixing(spark, d).collect()}
    assert got == mixing.brute_force(keyed, rates, hashes.__getitem__)


def test_fingerprint(spark, tables):
    d, rows, _, items = tables
    known = [(fingerprint.brute_force(t), i) for i, t in items]
    classes = brute_classes([(i, t) for i, t, _ in rows], fingerprint.NEAR)
    for r in queries.op4_fingerprint(spark, d).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        own = None if text is None else fingerprint.brute_force(text)
        best = (None, None) if own is None else min((fingerprint.difference(own, k), i) for k, i in known)
        assert (r["digest"], r["score"], r["nearest_item_id"]) == (own, *best)
        assert (r["class_doc_id"], r["links"]) == (classes[(r["doc_id"], own)] if own and r["doc_id"] is not None else (None, None))


def test_pii(spark, tables):
    d, rows, _, _ = tables
    expected = {i: brute_redaction(t)[1] for i, t, _ in rows if t and brute_redaction(t)[0]}
    got = {r["doc_id"]: r["redacted_text"] for r in queries.op6_pii(spark, d).collect()}
    assert got == expected and set(range(1000, 1020)) <= set(got)


def test_simhash(spark, tables):
    d, rows, _, _ = tables
    prints = {i: simhash.fingerprint(t) for i, t, _ in rows if t}
    root = {i: i for i in prints}
    for a, b in sorted(brute_pairs(prints, simhash.THRESHOLD)):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    got = {(r["doc_id"], r["keep_doc_id"]) for r in queries.op7_simhash(spark, d).collect()}
    assert got == {(i, r) for i, r in root.items() if i != r}
    assert {(i, 2000) for i in range(2001, 2008)} <= got


def test_html(spark, tables):
    d, _, pages, _ = tables
    got = {r["page_id"]: r["content"] for r in queries.op9_html_density(spark, d).collect()}
    assert {i: c.split() for i, c in got.items()} == {i: brute_content(h) for i, _, h in pages}
    assert all("menu" not in c for c in got.values())


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
