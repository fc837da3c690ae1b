"""Sources and sinks of texts and phrase tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("gramforge")

#: Words of the random corpus.
WORDS = (
    "犬 猫 が の を に 歩く 走る 見た データ ベース 検索 エンジン 新しい 速い 遅い "
    "東京 大阪 ロボット クラウド 学習 言語 モデル です でした そして しかし テスト 朝 夜 楽しい カメラ"
).split()


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(sentence): a headerless, tab-separated file, one text per line."""
    return spark.read.csv(path, sep="\t", header=False, lineSep="\n", schema="sentence STRING")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sentence): raw lines of a text file."""
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "sentence")


def from_array(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """(doc_id, text) of an in-process list, in its order."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def flatten_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, col, text): several text columns, row by row, left to right."""
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("col", "text")
    return df.select(F.col(key), cells)


#: Modulus of the numbers that draw words; products of two fit 64 bits.
_PRIME = 2**31 - 1


def draw(sentence: str, place: str, seed: int) -> str:
    """SQL for a pseudo-random number below 2^31 - 1, the same in any engine: twice
    squared, modulo a prime, from a sentence's number and a place in it."""
    x = f"(({sentence}) % {_PRIME} * 7919 + ({place}) * 104729 + {(seed * 15485863 + 271828183) % _PRIME}) % {_PRIME}"
    x = f"(({x}) * ({x}) + ({place}) * 31337 + 1) % {_PRIME}"
    return f"(({x}) * ({x}) + 3) % {_PRIME}"


def random_corpus(spark: SparkSession, sentences: int = 50, words_each: int = 12, words: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, text): uniformly drawn words, joined without spaces."""
    words = list(words or WORDS)
    table = F.array(*[F.lit(w) for w in words])
    drawn = (
        spark.range(sentences)
        .select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(words_each).cast("bigint"))).alias("k"))
        .withColumn("word", F.element_at(table, (1 + F.expr(draw("id", "k", seed)) % len(words)).cast("int")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("k", "word")))
    return drawn.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["word"]), "").alias("text"))


def write_phrases(phrases: DataFrame, path: str, mode: str = "overwrite") -> None:
    phrases.write.mode(mode).parquet(path)


def top_rows(phrases: DataFrame, rows: int = 5, columns: int = 5) -> DataFrame:
    """The display sink's view: first rows and columns by rank."""
    ordered = phrases.orderBy(F.desc("knowns"), F.desc("sc_index"), F.asc("seqchar"))
    return ordered.select(*phrases.columns[:columns]).limit(rows)


def report(phrases: DataFrame, verbose: int = 1) -> None:
    """Log the leading rows, if asked to."""
    if verbose >= 1:
        for row in top_rows(phrases).collect():
            log.info("%s", row)
