import pytest

from gramforge.__main__ import main, pattern_set
from gramforge.functions.patterns import documented_negative, negative_patterns


def test_random_corpus_and_file(spark, tmp_path, capfd):
    main(["--selection", "0", "--min-count", "1", "--rows", "3", "--known", "犬"])
    assert "seqchar" in capfd.readouterr().out
    (tmp_path / "t.tsv").write_text("ABAB\nABAB\n", encoding="utf-8")
    main([str(tmp_path / "t.tsv"), "--min-count", "1", "--min-length", "2", "--max-length", "3", "--selection", "0", "--out", str(tmp_path / "out")])
    assert [r["seqchar"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["ABAB"]


def test_patterns_and_removes(spark, tmp_path):
    assert pattern_set("negative", ["documented"]) == documented_negative()
    assert pattern_set("negative", ["default", "x_own=^Q+$"]) == negative_patterns() | {"x_own": "^Q+$"}
    with pytest.raises(SystemExit):
        pattern_set("positive", ["unknown"])
    (tmp_path / "t.tsv").write_text("AB-AB\nAB-AB\nCDCD\nCDCD\n", encoding="utf-8")
    limits = ["--min-count", "1", "--min-length", "2", "--max-length", "4"]
    main([str(tmp_path / "t.tsv"), *limits, "--removes", "-", "--unnecessary", "CD", "--positive", "own=^A.*B$", "--negative", "x=^Z$", "--out", str(tmp_path / "out")])
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r["seqchar"] for r in rows.collect()} <= {"AB", "ABAB"} and "own" in rows.columns
