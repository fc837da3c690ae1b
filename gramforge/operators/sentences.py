"""Sentence splitting and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import broadcast_upto, cut

#: Carriage return, line feed, ideographic and full-width full stop.
DELIMITERS = "[\r\n。．]"
#: Texts whose first sentence's number is broadcast.
BROADCAST_TEXTS = 1_000_000


def split_sentences(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence): the non-empty pieces of each text, in order.

    pos counts pieces before empty ones are dropped. Null texts have none.
    """
    pieces = F.posexplode(F.split(F.col(text), DELIMITERS)).alias("pos", "sentence")
    return texts.select(F.col(key), pieces).filter("sentence <> ''")


def _bases(placed: DataFrame, size: Column) -> DataFrame:
    """(_part, _base): the sum of ``size`` over the partitions before each."""
    sizes = placed.groupBy("_part").agg(size.alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return broadcast_upto(cut(sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))), 100_000)


def number_rows(df: DataFrame, order: list[str], name: str = "sid") -> DataFrame:
    """``df`` with a 0-based ``name`` in the given order, without a global window.

    Rows are range-partitioned and written once; the partitions' sizes are
    summed up in a table with a row per partition, and rows are numbered within
    their partition. Ties in ``order`` are numbered in an arbitrary order.
    """
    placed = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order)
    numbered = placed.join(_bases(placed, F.count(F.lit(1))), "_part").withColumn(name, F.col("_base") + F.row_number().over(within) - 1)
    return numbered.drop("_part", "_base")


def _pieces(text: str) -> Column:
    return F.filter(F.split(F.col(text), DELIMITERS), lambda p: p != "")


def first_numbers(texts: DataFrame, key: str, text: str) -> DataFrame | None:
    """(_key, _first): the number of each text's first sentence, texts in the order
    of ``key``; None if a key is null or has two texts. No text is shuffled."""
    sizes = texts.select(F.col(key).alias("_key"), F.size(_pieces(text)).cast("bigint").alias("_n")).filter("_n > 0")
    sizes = cut(sizes.groupBy("_key").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts")))
    if not sizes.filter("_texts > 1 OR _key IS NULL").isEmpty():
        return None
    placed = cut(sizes.select("_key", "_n").repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    return cut(placed.join(_bases(placed, F.sum("_n")), "_part").select("_key", first.alias("_first")))


def batch_texts(texts: DataFrame, size_sentence: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch_id, sentence) of the sentences of ``texts``, batched in the order of
    ``key`` and within a text.

    Where each key has one text only the numbers of first sentences are worked
    out, and texts are read again; else sentences themselves are put in order.
    """
    firsts = None if size_sentence is None else first_numbers(texts, key, text)
    if firsts is None:
        return assign_batches(split_sentences(texts, key, text), size_sentence, [key, "pos", "sentence"]).select("batch_id", "sentence")
    known = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(broadcast_upto(firsts, BROADCAST_TEXTS), "_key")
    numbered = known.select("_first", F.posexplode(_pieces("_text")).alias("_pos", "sentence"))
    return numbered.select(F.floor((F.col("_first") + F.col("_pos")) / max(1, size_sentence)).alias("batch_id"), "sentence")


def assign_batches(sentences: DataFrame, size_sentence: int | None, order: list[str]) -> DataFrame:
    """Adds batch_id: floor(position / size_sentence) in the given order.

    None puts everything into batch 0; a size of 0 or less, every sentence into
    a batch of its own.
    """
    if size_sentence is None:
        return sentences.withColumn("batch_id", F.lit(0).cast("bigint"))
    size = max(1, size_sentence)
    return number_rows(sentences, order).withColumn("batch_id", F.floor(F.col("sid") / size)).drop("sid")
