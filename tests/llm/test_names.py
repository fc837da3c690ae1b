"""Input columns may have any name that an operator uses itself."""

import re
from pathlib import Path

import pytest
from test_toxicity import corpus

import corpus_pipeline
from gramforge.llm import exact_dedup, fingerprint, html_density, licenses, lines, mixing, packing, pii, simhash, toxicity

FOLDER = Path(toxicity.__file__).parent
OWN = {n for f in FOLDER.glob("*.py") for n in re.findall(r"_gf_\w+", f.read_text())} - {"_gf_c"} | {f"_gf_c{i}" for i in range(6)}
RESULTS = "window shard begin tokens copies digest score links keep_links class_doc_id keep_doc_id nearest_item_id license scope n host dropped content toxic_score toxic_spans pii_spans redacted_text a.b"
NAMES = sorted(OWN | set(RESULTS.split()))


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(corpus(300))


def operators(model):
    docs = {
        "tag": lambda d: toxicity.tag_toxicity(d, model),
        "toxic": lambda d: toxicity.toxic_documents(d, model),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, model),
        "pack": packing.pack_windows,
        "copies": lambda d: mixing.mix_copies(d).selectExpr("_gf_row.doc_id as doc_id", "_gf_row.text as text", "copies"),
        "mix": mixing.mix,
        "digest": lambda d: fingerprint.fingerprint_classes(d),
        "equal": exact_dedup.exact_duplicates,
        "drop_equal": exact_dedup.drop_exact_duplicates,
        "pii": pii.find_pii,
        "redact": pii.redact,
        "near": simhash.near_duplicates,
        "drop_near": simhash.drop_near_duplicates,
        "licenses": licenses.scan_licenses,
        "lines": lambda d: lines.drop_boilerplate(d, "doc_id", "source", "text"),
        "html": lambda d: html_density.extract_pages(d, "doc_id", "text"),
    }
    return docs


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_every_operator_beside_every_name(docs, words, model, name):
    assert len(NAMES) > 60
    rows = [(i, words(i // 2, 60)) for i in range(6)] + [(7, None), (8, ""), (None, words(1, 60)), (9, "License: MIT\nmail a.b@example.org grublok"), (9, "License: MIT\nmail a.b@example.org grublok")]
    plain = docs(rows)
    crowded = plain.selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(NAMES)])
    operator = operators(model)[name]
    expected = operator(plain)
    got = operator(crowded)
    if set(plain.columns) <= set(expected.columns):  # a filter: all columns stay
        assert got.columns == crowded.columns
        assert all(tuple(r[len(plain.columns) :]) == tuple(range(len(NAMES))) for r in got.collect())
        got = got.select(*plain.columns)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())) and expected.count() > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_beside_every_name(spark, docs, words, tmp_path, name, stage):
    rows = [(i, t, "s") for i, t, _ in corpus(200)] + [(1000, None, "s"), (1001, "", None), (None, words(1, 20), "s"), (1002, words(1, 60_000), "s"), (0, corpus(1)[0][1], "s")]
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs(rows)
    crowded = plain.selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(NAMES)])
    expected, got = stage(spark, plain, str(tmp_path)), stage(spark, crowded, str(tmp_path))
    by = ["doc_id", "text"] if "text" in expected.columns else ["doc_id", "begin", "tokens"]
    assert sorted(map(str, got.select(*by).collect())) == sorted(map(str, expected.select(*by).collect()))
    assert got.columns == (crowded.columns if "text" in expected.columns else expected.columns)
